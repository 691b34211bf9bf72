"""Whitening of embeddings by their exact integer scatter (operator 12).

Entries become integers x = floor(scale * c) + offset. Each task subtracts the shift (the offset
again), so that numbers are small, and sums entries and cross-products of its rows in arbitrary
precision: entries are cut into limbs so narrow that products of a batch's limb columns are exact
in doubles, and the limbs' sums are Python integers. Tasks send their sums as limbs of 30 bits, which
Spark adds up as longs, row by row of the matrix. From the totals the driver forms n X'X - S S' exactly:
d * d numbers, whatever the number of rows. Only then are they rounded, once, to doubles and decomposed by eigh.
What is far smaller than the shift, or than the largest entry, is not lost to cancellation.

Defined cases: rows whose vector is null or empty, holds null or non-finite entries, or has another length
than most have (ties: the longer) take no part; entries beyond 2**52 are summed as Python integers,
just as exactly, those beyond 1e100 count as not finite; repeated rows and ids, and null ids, count like others; components without variance
(fewer rows than dimensions, constant or repeated dimensions) have rows with `whitened` null and
`explained` 0, and don't count for `identity_error`; a deviation beyond 38 digits is null; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, MOST_COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb of the sums that travel; tasks' limbs are added as longs, exact for 2**33 tasks.
LIMB = 30
_EXACT = float(1 << 52)
#: Squares of larger entries are beyond doubles; they count as not finite.
LARGEST = 1e100


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a vector that takes part."""
    x = F.col(vector)
    whole = df.where(x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)))
    size = whole.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size(x) == (size["d"] if size else 0))


def integers(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) of each entry, a row for each vector: 64-bit, or Python integers where those don't fit."""
    c = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1) * scale)
    if np.abs(c).max(initial=0) < _EXACT:
        return c.astype(np.int64)
    return np.array([int(x) for x in c.ravel().tolist()], object).reshape(c.shape)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of a batch of rows, as arrays of Python integers."""
    n, d = x.shape
    if x.dtype == object:
        return x.sum(axis=0), np.dot(x.T, x)
    width = max(1, (52 - n.bit_length()) // 2)  # the product of two limbs, n times, stays below 2**52
    sign, rest, limbs = np.sign(x), np.abs(x), []
    while rest.any():
        limbs.append((sign * (rest & ((1 << width) - 1))).astype(np.float64))
        rest = rest >> width
    whole = lambda sums, places: sums.astype(np.int64).astype(object) << (width * places)
    sums, cross = np.array([0] * d, object), np.array([[0] * d] * d, object)
    for i, a in enumerate(limbs):
        sums = sums + whole(a.sum(axis=0), i)
        for j, b in enumerate(limbs[: i + 1]):
            part = whole(a.T @ b, i + j)
            cross = cross + (part if i == j else part + part.T)
    return sums, cross


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, limb) of an integer; limbs have its sign."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if part := value & ((1 << LIMB) - 1):
            yield k, sign * part
        value >>= LIMB
        k += 1


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of x, without the offset
    components: np.ndarray  # a column each, by falling eigenvalue
    eigenvalues: np.ndarray
    total: float  # the trace of the covariance
    scale: int = SCALE

    def _mean(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """S // n, S % n, and whether n (x - S // n) can be handled in 64 bits with room to spare."""
        whole, part = (np.array([f(s, self.n) for s in self.sums], object) for f in (int.__floordiv__, int.__mod__))
        far = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0), *whole)), default=0)
        return whole, part, x.dtype != object and 2 * self.n * (far + 1) < 1 << 46

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)**2, exact Python integers."""
        whole, part, small = self._mean(x)
        if not small:
            y = self.n * (x.astype(object) - whole) - part
            return (y * y).sum(axis=1)
        y = self.n * (x - whole.astype(np.int64)) - part.astype(np.int64)
        high, low = y >> 24, y & ((1 << 24) - 1)
        squares = [(a * b).sum(axis=1).astype(object) for a, b in ((high, high), (high, low), (low, low))]
        return (squares[0] << 48) + (squares[1] << 25) + squares[2]

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - S / n on each component, over the root of its eigenvalue; NaN where that is 0."""
        whole, part, small = self._mean(x)
        centred = (x - whole.astype(np.int64) if small else x.astype(object) - whole).astype(np.float64) - np.array([p / self.n for p in part])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, centred @ self.components / np.sqrt(self.eigenvalues), np.nan)


def fit(df: DataFrame, vector: str = "embedding", components: int = MOST_COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The model of all rows of `df`, which must be `usable`; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, None, None
        for batch in batches:
            if batch.num_rows:
                s, c = scatter(integers(batch.column(0), scale))
                n, sums, cross = n + batch.num_rows, s if sums is None else sums + s, c if cross is None else cross + c
        if n:  # row -1 holds the sums, row -2 the number of rows and of entries
            rows = [(-2, 0, n), (-2, 1, n * len(sums))] + [(-1, j, v) for j, v in enumerate(sums)] + [(i, j, cross[i, j]) for i in range(len(sums)) for j in range(i + 1)]
            flat = [(i, j, k, part) for i, j, v in rows for k, part in _limbs(int(v))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "part"])

    parts = df.select(vector).mapInArrow(run, "i int, j int, k int, part long").groupBy("i", "j", "k").agg(F.sum("part").alias("part"))
    totals: dict[tuple[int, int], int] = {}
    for r in parts.toLocalIterator():
        totals[r["i"], r["j"]] = totals.get((r["i"], r["j"]), 0) + (r["part"] << (LIMB * r["k"]))
    n = totals.get((-2, 0), 0)
    if not n:
        return None
    d = totals[-2, 1] // n
    sums = [totals.get((-1, j), 0) for j in range(d)]
    covariance = np.zeros((d, d))
    trace = 0
    for i in range(d):
        for j in range(i + 1):
            exact = n * totals.get((i, j), 0) - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = exact / (n * n)  # integers: rounded once
            trace += exact if i == j else 0
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    values = np.where(values > d * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    return Whitening(n, sums, np.ascontiguousarray(vectors), values, trace / (n * n), scale)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from a pass over the rows."""
    own = np.flatnonzero(model.eigenvalues > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(own) + 1, len(own)))
        for batch in batches:
            z = model.project(integers(batch.column(0), model.scale))[:, own]
            total[:-1] += z.T @ z
            total[-1] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own) + 1, dtype=np.int32), len(own))), pa.array(np.tile(np.arange(len(own), dtype=np.int32), len(own) + 1)), pa.array(total.ravel())], names=["i", "j", "part"])

    if not len(own):
        return 0.0
    out = np.zeros((len(own) + 1, len(own)))
    for r in df.select(vector).mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).toLocalIterator():
        out[r["i"], r["j"]] = r["part"] / model.n
    return float(np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(len(own))).max())


def whitened(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each row of `df` and component: the key, component (from 1), deviation (decimal), whitened, explained."""
    number = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), model.scale)
            far = [int(v) if v < 10**38 else None for v in model.deviation(x)]
            rows = pa.array(np.repeat(np.arange(len(x)), number))
            z = model.project(x).ravel()
            columns = [batch.column(0).take(rows), pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), len(x))), pa.array(far, pa.decimal128(38, 0)).take(rows), pa.array(z, mask=np.isnan(z)), pa.array(np.tile(model.eigenvalues / model.total if model.total else np.zeros(number), len(x)))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "deviation", "whitened", "explained"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInArrow(run, f"`{key}` {kind}, component int, deviation decimal(38,0), whitened double, explained double")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = MOST_COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Fits on all usable rows and whitens them: `whitened` with n and identity_error. The offset cancels out of every column."""
    rows = usable(df.select(key, vector), vector)
    model = fit(rows, vector, components, scale)
    if model is None:
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    out = whitened(rows, model, key, vector)
    return out.select(key, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(identity_error(rows, model, vector)).alias("identity_error"))


def digest(df: DataFrame) -> DataFrame:
    """`whiten` with deviation as a long, null where it is larger."""
    return whiten(df).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
