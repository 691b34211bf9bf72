"""Nearest neighbours by inner product: an inverted file with product-quantised residuals (operator 9).

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample (`TRAIN`
vectors, the smallest by a hash of vec_id). Every vector is filed under its nearest centroid with
the code of its residual, its distance from the centroid and the error of its code. The sample's products with a query give a bound
that its k-th best product can't be below. A query looks into every cell that may hold a product above it (by Cauchy-Schwarz: the product with the
centroid, and the query's length times the cell's radius); there its products with the decoded vectors (asymmetric distance), give or take its length times the code's error,
tell which vectors may be among its k best; these are ranked by the exact product of the original vectors in double precision.
So all the true neighbours are found, whatever the vectors are; the index only decides how much must be looked at. On vectors without clusters
that is nearly all, and the work grows with rows times queries.

Cells are put together in blocks of about equally many vectors, large cells cut; a block and a share of the queries that look into it are a task's
group: a cell with a third of all vectors is many groups. Only counts for each cell and block come to the driver.

Defined cases: vectors that are null, zero, hold a null or non-finite component or have another
length than most take no part; ties go to the smaller vec_id; a query's own row isn't its
neighbour; rows that share a vec_id are each a query with a ranking of its own, and a candidate of the others; with fewer candidates than k all are returned;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import sampled, written

TRAIN, PARTS, WORDS = 20_000, 16, 256
#: Vectors of a block; numbers in a block of vectors, or of the sample that bounds come from (8 bytes each); queries of a group to one vector of a block.
BLOCK_LEAST, BLOCK_NUMBERS, BLOCK_QUERIES = 256, 1 << 20, 2
#: Queries at a time, and pairs of vectors whose exact products are worked out at a time.
QUERIES, PAIRS = 256, 1 << 16
#: Bounds are this share of the lengths' product wider than they are, for rounding.
SLACK = 1e-9


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: as 32-bit floats where they are stored so, else in double precision."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(column)
    if df.schema[column].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    found = df.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0))
    common = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.where(F.size("v") == (common["d"] if common else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        heads = (np.cumsum(n) - n)[full]
        c = c.copy()
        c[full] = np.add.reduceat(x[order], heads, axis=0) / n[full][:, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Model:
    def __init__(self, sample: np.ndarray, rows: int):
        d = sample.shape[1]
        self.cells = kmeans(sample, int(max(1, min(65_536, len(sample) // 8, round(2 * rows**0.5)))))
        self.cuts = [a for a in np.array_split(np.arange(d), min(PARTS, d)) if len(a)]
        rest = sample - self.cells[_nearest(sample, self.cells)]
        self.books = [kmeans(rest[:, cut], WORDS, rounds=8) for cut in self.cuts]
        self.sample = sample[: max(1000, 2 * BLOCK_NUMBERS // d)]

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, distances from the centroids and errors of the codes."""
        cell = _nearest(x, self.cells)
        rest = x - self.cells[cell]
        codes = np.stack([_nearest(rest[:, cut], book) for cut, book in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        return cell, codes, np.linalg.norm(rest, axis=1), np.linalg.norm(x - self.decoded(cell, codes), axis=1)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.cells[cell]
        for j, (cut, book) in enumerate(zip(self.cuts, self.books)):
            out[:, cut] += book[codes[:, j]]
        return out

    def least(self, queries: np.ndarray, k: int) -> np.ndarray:
        """What the k-th best products are at least: the sample's, of which one may be a query's own row."""
        if len(self.sample) <= k:
            return np.full(len(queries), -np.inf)
        at = len(self.sample) - k - 1
        return np.concatenate([np.partition(queries[i : i + QUERIES] @ self.sample.T, at, axis=1)[:, at] for i in range(0, len(queries), QUERIES)])


def largest(about: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest values of each row, in ascending order; of equal values the first ones."""
    if n >= about.shape[1]:
        return np.broadcast_to(np.arange(about.shape[1]), about.shape)
    least = np.partition(about, about.shape[1] - n, axis=1)[:, -n][:, None]
    above, equal = about > least, about == least
    room = n - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))[1].reshape(-1, n)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _few_copies(cell: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places, by cell and id, of the first k + 1 of equal vectors: no others can be among the k best, as one may be the query's own row."""
    order = np.lexsort((ids, cell))
    whole = np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel()
    same = np.unique(whole, return_inverse=True)[1]
    by = np.argsort(same, kind="stable")
    heads = np.flatnonzero(np.diff(same[by], prepend=-1))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by)) - np.repeat(heads, np.diff(heads, append=len(by)))
    return order[place <= k]


def _exact(queries: np.ndarray, v: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Products of pairs, each summed in the same order wherever the pair stands, so that equal vectors have equal ones."""
    return np.concatenate([np.zeros(0), *((queries[q[i : i + PAIRS]] * v[at[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(q), PAIRS))])


def _first(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best pairs."""
    order = np.lexsort((ids, -score, q))
    heads = np.flatnonzero(np.diff(q[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(heads, np.diff(heads, append=len(order))) < k]


def _best(queries: np.ndarray, asks: np.ndarray, least: np.ndarray, k: int, cells: list[tuple], v: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each of some queries: (query's place, vector's place, product). `cells` are (centroid, first and end place,
    decoded vectors, errors, radius). What is left out is below the query's bound, which rises on the way. Comparisons are such that NaN stays in."""
    length, least, found = np.linalg.norm(queries, axis=1), least.copy(), []
    for centroid, a, b, decoded, error, radius in cells:
        wide = SLACK * length * (np.linalg.norm(centroid) + radius)
        some = np.flatnonzero(~(queries @ centroid + length * radius + wide < least))
        if not len(some):
            continue
        may = ~(queries[some] @ decoded.T + length[some, None] * error < (least - wide)[some, None])
        may &= asks[some, None] != rows[a:b]
        if may.sum() > may.size // 16:  # the codes tell little here: plain products first, still as bounds
            plain = np.where(may, queries[some] @ v[a:b].T, -np.inf)
            many = np.flatnonzero((plain >= least[some, None]).sum(axis=1) > k)
            if len(many):
                kth = np.take_along_axis(plain[many], largest(plain[many], k), axis=1).min(axis=1)
                least[some[many]] = np.fmax(least[some[many]], kth - wide[some[many]])
            may &= ~(plain < (least - wide)[some, None])
        q, at = np.nonzero(may)
        q, at = some[q], at + a
        score = _exact(queries, v, q, at)
        top = _first(q, score, ids[at], k)
        q, at, score = q[top], at[top], score[top]
        found.append((q, at, score))
        last = np.flatnonzero(np.diff(q, append=-1))
        full = last[np.bincount(q, minlength=1)[q[last]] == k]
        least[q[full]] = np.fmax(least[q[full]], score[full])
    q, at, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    top = _first(q, score, ids[at], k)
    return q[top], at[top], score[top]


def search(vectors: DataFrame, is_query: Column, k: int = 20, column: str = "embedding") -> DataFrame:
    """The k nearest of every row of `vectors` (vec_id, embedding) where `is_query` (of F.col("vec_id")) holds, among all
    others: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = usable(vectors, column)
    kind = good.schema["v"].dataType.simpleString()
    rows = good.count()
    if rows == 0:
        return spark.createDataFrame([], schema)
    sample = sampled(good, "vec_id", TRAIN, rows).toArrow()["v"]
    model = Model(_matrix(sample.combine_chunks() if isinstance(sample, pa.ChunkedArray) else sample), rows)
    d = model.cells.shape[1]
    shared = spark.sparkContext.broadcast(model)  # at most TRAIN / 8 centroids, 16 * 256 code words and a part of the sample

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, codes, far, error = shared.value.file(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(error)], names=["vec_id", "v", "row", "cell", "code", "far", "error"])

    numbered = good.select("vec_id", "v", F.monotonically_increasing_id().alias("row"))  # ids may be repeated; written once, so the numbers stay
    filed = written(numbered.mapInArrow(file, f"vec_id long, v {kind}, row long, cell int, code binary, far double, error double"), "inverted-file")
    held, radius = np.zeros(len(model.cells), np.int64), np.zeros(len(model.cells))
    for r in filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row for each cell
        held[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    size = int(min(max(BLOCK_LEAST, BLOCK_NUMBERS // d), max(BLOCK_LEAST, rows // 24)))
    ends = np.cumsum(held)
    layout = spark.sparkContext.broadcast((held, radius, (ends - held) // size, (np.maximum(ends, 1) - 1) // size))  # a cell's first and last block

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (held, radius, first, last) = shared.value, layout.value
        lengths, blocks = np.linalg.norm(model.cells, axis=1), int(last.max()) + 1
        step = max(1, min(QUERIES, PAIRS // blocks))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                queries = _matrix(b.column(1))
                least, length = model.least(queries, k), np.linalg.norm(queries, axis=1)[:, None]
                may = ~(queries @ model.cells.T + length * (radius + 2 * SLACK * (lengths + radius)) < least[:, None]) & (held > 0)
                q, cell = np.nonzero(may)
                n = last[cell] - first[cell] + 1
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[cell], n)
                q, block = np.divmod(np.unique(np.repeat(q, n) * blocks + block), blocks)
                taken = b.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(least[q]), pa.array(block.astype(np.int32))], names=["vec_id", "v", "row", "least", "block"])

    asked = written(filed.where(is_query).select("vec_id", "v", "row").mapInArrow(probe, f"vec_id long, v {kind}, row long, least double, block int"), "probes")
    counts = {r["block"]: r["count"] for r in asked.groupBy("block").count().collect()}  # a row for each block
    sizes = F.broadcast(spark.createDataFrame([(int(b), int(-(-n // (BLOCK_QUERIES * size)))) for b, n in sorted(counts.items())], "block int, q_blocks int"))
    places = F.broadcast(spark.createDataFrame([(c, int(ends[c] - held[c]), int(held[c])) for c in np.flatnonzero(held).tolist()], "cell int, start long, n long"))
    at = F.col("start") + F.pmod(F.xxhash64("row"), F.col("n"))
    placed = filed.join(places, "cell").withColumn("block", F.floor(at / size).cast("int")).drop("start", "n")
    vectors_dealt = placed.join(sizes, "block").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).drop("q_blocks")
    queries_dealt = asked.join(sizes, "block").withColumn("q_block", F.pmod(F.xxhash64("row"), F.col("q_blocks")).cast("int")).drop("q_blocks")

    def look(found: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if found.num_rows and queries.num_rows:
            model = shared.value
            cell, ids, v = found["cell"].to_numpy(), found["vec_id"].to_numpy(), _matrix(found["v"].combine_chunks())
            kept = _few_copies(cell, ids, v, k)
            cell, ids, v, rows, error, far = cell[kept], ids[kept], v[kept], *(found[c].to_numpy()[kept] for c in ("row", "error", "far"))
            codes = np.frombuffer(b"".join(found["code"].to_pylist()), np.uint8).reshape(found.num_rows, -1)[kept]
            heads = np.flatnonzero(np.diff(cell, prepend=-1))
            decoded = model.decoded(cell, codes)
            cells = [(model.cells[cell[a]], a, b, decoded[a:b], error[a:b], far[a:b].max()) for a, b in zip(heads, np.append(heads[1:], len(cell)))]
            asking, asks, least, q = queries["vec_id"].to_numpy(), queries["row"].to_numpy(), queries["least"].to_numpy(), _matrix(queries["v"].combine_chunks())
            for i in range(0, len(q), QUERIES):
                own, at, score = _best(q[i : i + QUERIES], asks[i : i + QUERIES], least[i : i + QUERIES], k, cells, v, rows, ids)
                out.append((asks[i + own], asking[i + own], ids[at], score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("query", "query_id", "vec_id", "score"), columns)))

    keys = ["block", "q_block"]
    near = vectors_dealt.groupBy(*keys).cogroup(queries_dealt.groupBy(*keys)).applyInArrow(look, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
