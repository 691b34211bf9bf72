"""Sliding windows of records, from blocks with halos: each cell goes to the block of its record, and only those of a block's first records to the block before too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import ArrayFrame

#: Records of a block, for each record of the window; and at least.
BLOCKS, LEAST_BLOCK = 16, 1024
OPERATORS = ("average", "sum", "count", "max", "min")
EXACT = {"tinyint", "smallint", "int", "bigint"}
KINDS = EXACT | {"float", "double"}


def running(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of values[low:high], from running sums. NaN and infinite values are counted apart, as they would spoil all sums behind them."""
    part = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[high] - c[low]
    if values.dtype.kind == "i":
        return part(values)
    odd = ~np.isfinite(values)
    out = part(np.where(odd, 0.0, values))
    if odd.any():
        nan, up, down = (part(x.astype(np.int64)) > 0 for x in (np.isnan(values), values == np.inf, values == -np.inf))
        out = np.where(nan | (up & down), np.nan, np.where(up, np.inf, np.where(down, -np.inf, out)))
    return out


def largest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Maxima of values[low:high], none of them empty, from maxima of runs of 1, 2, 4, ... values. NaN is the largest."""
    size = high - low
    level = np.frexp(size)[1] - 1  # of the longest run that fits
    out, runs = np.empty(len(low), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.maximum(runs[low[own]], runs[high[own] - (1 << k)])
        if len(runs) > 1 << k:
            runs = np.maximum(runs[: -(1 << k)], runs[1 << k :])
    return out


def starts_of(segment: np.ndarray, d: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of all windows that hold a record, each once, from records in order."""
    fresh = np.concatenate([[True], segment[1:] != segment[:-1]])
    before = np.where(fresh, d - window, np.concatenate([[0], d[:-1]]))
    first = np.maximum(d - window + 1, before + 1)
    n = d - first + 1
    at = np.repeat(np.arange(len(d)), n)
    return segment[at], first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def windows(array: ArrayFrame, window: int, op: str) -> DataFrame:
    """start, the other dimensions, result, n_cells: what `tiles.sliding` says, for `OPERATORS` and numbers."""
    d, *rest = array.dims
    value, kind = F.col(array.value), array.df.schema[array.value].dataType.simpleString()
    block = max(LEAST_BLOCK, BLOCKS * window)
    number, result = ("long", kind if op in ("max", "min") else "long") if kind in EXACT else ("double", kind if op in ("max", "min") else "double")
    result = {"average": "double", "count": "long"}.get(op, result)
    use = {"max": F.max, "min": F.min}.get(op, F.sum)
    # repeated cells become one on the map side
    cells = array.df.where(F.col(d).isNotNull()).groupBy(*array.dims).agg(use(value).cast(number).alias("v"), F.count(value).alias("n"), F.count(F.lit(1)).alias("m"))
    own = F.expr(f"(`{d}` - pmod(`{d}`, {block})) div {block}")
    near = F.when(F.pmod(F.col(d), F.lit(block)) < window - 1, F.array(own, own - 1)).otherwise(F.array(own))
    placed = cells.select(F.explode(near).alias("block"), *rest, F.col(d).cast("long").alias("d"), "v", "n", "m")
    keys = ["block", *rest]

    def told(table: pa.Table) -> pa.RecordBatch:
        """The windows of some whole segments, which follow one another."""
        segment = np.cumsum(heads_of(table)) - 1
        at = table.column("d").to_numpy()
        n, m = (table.column(c).to_numpy() for c in ("n", "m"))
        gone = table.column("v").is_null().to_numpy()
        v = table.column("v").fill_null(0).to_numpy()
        seg, start = starts_of(segment, at, window)
        heads = np.flatnonzero(heads_of(table))
        base = table.column("block").to_numpy()[heads][seg] * block
        kept = (start >= np.maximum(base, 0)) & (start < base + block)
        seg, start = seg[kept], start[kept]
        far = int(at.max() - at.min()) + window + 2
        place = lambda s, x: s * far + (x - at.min() + window)
        order = place(segment, at)
        low, high = np.searchsorted(order, place(seg, start)), np.searchsorted(order, place(seg, start + window))
        values, cells = running(n, low, high), running(m, low, high)
        if op == "count":
            out, mask = values, None
        elif op in ("sum", "average"):
            out, mask = running(v, low, high), values == 0
            out = out / np.maximum(values, 1) if op == "average" else out
        else:
            sign = 1 if op == "max" else -1
            least = np.iinfo(np.int64).min + 1 if v.dtype.kind == "i" else -np.inf
            if op == "min" and v.dtype.kind != "i":  # NaN is the largest, so it is the least one only where there is nothing else
                odd = np.isnan(v)
                some = running((~odd & ~gone).astype(np.int64), low, high) > 0
                out = -largest(np.where(gone | odd, least, -v), low, high)
                out = np.where(some, out, np.nan)
            else:
                out = sign * largest(np.where(gone, least, sign * v), low, high)
            mask = values == 0
        others = [table.column(c).take(pa.array(heads[seg])).combine_chunks() for c in rest]
        return pa.RecordBatch.from_arrays([pa.array(start), *others, pa.array(out, mask=mask), pa.array(cells)], names=["start", *rest, "result", "n_cells"])

    def heads_of(table: pa.Table) -> np.ndarray:
        out = np.zeros(table.num_rows, bool)
        out[:1] = True
        for k in keys:
            c = table.column(k)
            x, gone = c.fill_null(0).to_numpy(), c.is_null().to_numpy()
            out[1:] |= (x[1:] != x[:-1]) | (gone[1:] != gone[:-1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            last = int(np.flatnonzero(heads_of(held))[-1]) if held.num_rows else 0
            if last:
                yield told(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield told(held)

    kinds = {c: array.df.schema[c].dataType.simpleString() for c in rest}
    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, "d")
    wide = number if op not in ("average", "count") else {"average": "double", "count": "long"}[op]
    out = dealt.mapInArrow(run, "start long, " + "".join(f"`{c}` {t}, " for c, t in kinds.items()) + f"result {wide}, n_cells long")
    start = array.df.schema[d].dataType.simpleString()
    return out.withColumn("start", F.col("start").cast(start)).withColumn("result", F.col("result").cast(result))
