"""Operators over tiles: the index space is cut into boxes of one shape, each gets one row."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tile_key
from ..functions.shapes import checked, strides
from . import windows
from .model import ArrayFrame


def upper_median(value: str) -> Column:
    """The value at place n / 2 (from 0) of the sorted values: the upper of the two middle ones, never a mean. Aggregated in
    parts on the map side."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")


def upper_median_sorted(value: str) -> Column:
    """The same from the whole sorted list, for plans that ship raw values."""
    values = F.sort_array(F.collect_list(value))
    return F.get(values, F.expr(f"cast(count(`{value}`) div 2 as int)"))


OPERATORS: dict[str, Callable[[str], Column]] = {
    "median": upper_median,
    "simplemedian": upper_median,
    "supersimplemedian": upper_median_sorted,
    "average": F.avg,
    "average_int": lambda v: F.avg(v).cast("int"),
    "max": F.max,
    "simplemax": F.max,
    "min": F.min,
    "sum": F.sum,
    "count": F.count,
    "nulltest": lambda v: F.count_if(F.col(v).isNull()),
    "stddev": F.stddev_pop,
    "count_distinct": F.countDistinct,
    "values": lambda v: F.sort_array(F.collect_list(v)),
}


def register_operator(name: str, build: Callable[[str], Column]) -> None:
    """Adds an operator: a function from the value's column name to an aggregate (a grouped pandas UDF will do)."""
    if name.lower() in OPERATORS:
        raise ValueError(f"there is an operator {name}")
    OPERATORS[name.lower()] = build


def operator(name: str) -> Callable[[str], Column]:
    try:
        return OPERATORS[name.lower()]
    except KeyError:
        raise ValueError(f"no operator {name}; there are {', '.join(sorted(OPERATORS))}") from None


#: Cells that one bitmap of Spark's holds, and bitmaps that are made side by side in one aggregation.
BITMAP, BITMAPS = 32_768, 16


def cells_seen(array: ArrayFrame, tile: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """A row for each tile: its key and n_distinct, how many different cells it has, from bitmaps of cells that are combined on the map side."""
    keys = [*by, *(f"g{i}" for i in range(len(tile)))]
    placed = array.df.select(*by, *tile_key(array.dims, tile), _place(array, tile))
    parts = placed.groupBy(*keys, F.bitmap_bucket_number("__at").alias("__bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("__at"))).alias("n"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n_distinct"))


def _place(array: ArrayFrame, tile: Sequence[int]) -> Column:
    """A cell's place in its tile, from 1."""
    terms = [F.pmod(F.col(d).cast("long"), F.lit(e)) * F.lit(s) for d, e, s in zip(array.dims, tile, strides(tile))]
    return (sum(terms[1:], terms[0]) + 1).alias("__at")


def tile_agg(array: ArrayFrame, tile: Sequence[int], op: str | dict[str, str] = "median", by: Sequence[str] = (), drop_partial: bool = False, exact: bool = False) -> DataFrame:
    """A row for each tile: g0, ..., result (or a column for each name of a dict name -> operator), n_cells, is_complete.

    Edge tiles hold what the array has there; is_complete compares n_cells with the tile's full size, so in a sparse array
    with repeated cells it says that there are enough values, not that no cell is missing. With `exact` it says that none is: there is a column
    n_distinct, the number of different cells, which is compared."""
    tile = checked(tile)
    ops = {"result": op} if isinstance(op, str) else op
    keys = tile_key(array.dims, tile)
    grouped = array.df.select(*by, *keys, F.col(array.value)).groupBy(*by, *(f"g{i}" for i in range(len(tile))))
    found = [*(operator(o)(array.value).alias(name) for name, o in ops.items()), F.count(F.lit(1)).alias("n_cells")]
    size, names = math.prod(tile), [*by, *(f"g{i}" for i in range(len(tile)))]
    if exact and size <= BITMAP * BITMAPS:
        placed = array.df.select(*by, *keys, F.col(array.value), _place(array, tile))
        of = lambda b: F.bitmap_count(F.bitmap_construct_agg(F.when(F.bitmap_bucket_number("__at") == b + 1, F.bitmap_bit_position("__at"))))
        seen = sum((of(b) for b in range(1, -(-size // BITMAP))), of(0))
        out = placed.groupBy(*names).agg(*found, seen.alias("n_distinct"))
    elif exact:
        out = grouped.agg(*found).join(cells_seen(array, tile, by), names)
    else:
        out = grouped.agg(*found)
    out = out.withColumn("is_complete", F.col("n_distinct" if exact else "n_cells") >= F.lit(size))
    return out.where("is_complete") if drop_partial else out


def value_filter(array: ArrayFrame, tile: Sequence[int], gt: float | None = None, lt: float | None = None) -> DataFrame:
    """For each tile with a hit the values strictly between the bounds, in order."""
    v, keep = F.col(array.value), F.lit(True)
    if gt is not None:
        keep = keep & (v > gt)
    if lt is not None:
        keep = keep & (v < lt)
    return tile_agg(array.where(keep), tile, {"hits": "values"}).drop("is_complete").withColumnRenamed("n_cells", "n_hits")


def rollup(array: ArrayFrame, tile: Sequence[int], op: str = "average") -> DataFrame:
    """Beyond the tile: the operator for every prefix of the tile's key, in one pass."""
    keys = [f"g{i}" for i in range(len(tile))]
    return array.df.select(*tile_key(array.dims, checked(tile)), F.col(array.value)).rollup(*keys).agg(operator(op)(array.value).alias("result"), F.count(F.lit(1)).alias("n_cells"))


def sliding(array: ArrayFrame, window: int, op: str = "average") -> DataFrame:
    """Windows of `window` records at every record from 0 on: start, the other dimensions, result, n_cells. The common operators over
    numbers work on blocks of records with halos (see `windows`); for any other one a cell counts for each window that covers it, so that the
    shuffle carries at most `window` partial results for it."""
    if window < 1:
        raise ValueError("a window has one record at least")
    d, *rest = array.dims
    if op.lower() in windows.OPERATORS and array.df.schema[array.value].dataType.simpleString() in windows.KINDS and not {"block", "d", "v", "n", "m", "start"} & set(rest):
        return windows.windows(array, window, op.lower())
    spread = array.df.withColumn("start", F.explode(F.sequence(F.col(d) - (window - 1), F.col(d)))).where("start >= 0")
    return spread.groupBy("start", *rest).agg(operator(op)(array.value).alias("result"), F.count(F.lit(1)).alias("n_cells"))


def same_tiles(block: np.ndarray, tile: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tiles of a block, those of one size at once (whole ones, then what each edge cuts off): (keys by dimension, cells by tile)."""
    whole = [n // e for n, e in zip(block.shape, tile)]
    sides = [[(0, w, e)] * (w > 0) + [(w, 1, n - w * e)] * (n > w * e) for n, w, e in zip(block.shape, whole, tile)]
    for part in itertools.product(*sides):
        cells = block[tuple(slice(k * e, k * e + n * size) for (k, n, size), e in zip(part, tile))]
        cells = cells.reshape([x for _, n, size in part for x in (n, size)])
        d = len(part)
        cells = cells.transpose(*range(0, 2 * d, 2), *range(1, 2 * d, 2)).reshape(math.prod(n for _, n, _ in part), -1)
        yield np.indices([n for _, n, _ in part]).reshape(d, -1) + np.array([[k] for k, _, _ in part]), cells


def merge_median(slabs: DataFrame, shape: Sequence[int], tile: Sequence[int], dims: int, value: str = "values", low: str = "low") -> DataFrame:
    """Upper medians without a shuffle, from slabs that hold whole tiles along the first dimension: rows (low, values), the
    records from `low` on, a multiple of the tile's length, as packed values in row-major order. Null slabs give no tiles; null values are
    cells that count but have no rank, as in `tile_agg`: a tile of nulls only has a null median."""
    shape, tile = checked(shape), checked(tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = packed.values
                there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, *shape[1:])
                block = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, *shape[1:])
                if first % tile[0]:
                    raise ValueError(f"the slab at {first} begins inside a tile")
                for (keys, cells), (_, valid) in zip(same_tiles(block, tile), same_tiles(there, tile)):
                    keys[0] += first // tile[0]
                    middle = cells.shape[1] // 2
                    medians = np.partition(cells, middle, axis=1)[:, middle]
                    ranked = valid.sum(axis=1)
                    for k in np.flatnonzero((ranked < cells.shape[1]) & (ranked > 0)):
                        medians[k] = np.partition(cells[k][valid[k]], ranked[k] // 2)[ranked[k] // 2]
                    sizes = pa.repeat(pa.scalar(cells.shape[1], pa.int64()), len(cells))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, keys.astype(np.int32)), pa.array(medians, mask=ranked == 0), sizes], names=[f"c{i}" for i in range(dims + 2)])

    kind = slabs.schema[value].dataType.elementType.simpleString()
    schema = ", ".join(f"g{i} int" for i in range(dims)) + f", result {kind}, n_cells long"
    out = slabs.select(low, value).where(F.col(low).isNotNull() & F.col(value).isNotNull()).mapInArrow(run, schema)
    return out.withColumn("is_complete", F.col("n_cells") >= F.lit(math.prod(tile)))
