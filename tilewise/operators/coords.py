"""Filters by a coordinate variable: a one-dimensional array that names the places along one dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import linear_id, tile_key
from ..functions.shapes import checked
from .model import ArrayFrame

#: A coordinate variable of up to as many rows goes to every executor; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def predicate(coord: Column, eq: float | None = None, gt: float | None = None, lt: float | None = None) -> Column:
    """Compared as 32-bit floats, as stored. Equality comes first; bounds are strict on both sides; None is no bound."""
    c = coord.cast("float")
    if eq is not None:
        return c == F.lit(eq).cast("float")
    keep = c.isNotNull()
    if gt is not None:
        keep = keep & (c > F.lit(gt).cast("float"))
    return keep & (c < F.lit(lt).cast("float")) if lt is not None else keep


def joined(array: ArrayFrame, coord: DataFrame, dim: str, idx: str = "idx", name: str = "coord") -> DataFrame:
    """Cells with the coordinate of their place along `dim`; cells beyond the variable have none."""
    if dim not in array.dims:
        raise ValueError(f"no dimension {dim}")
    side = coord.select(F.col(idx).alias("__idx"), F.col(name).alias("coord"))
    if coord.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return array.df.select(*array.dims, array.value).join(side, F.col(dim) == F.col("__idx"), "left").drop("__idx")


def coordinate_filter(array: ArrayFrame, coord: DataFrame, dim: str, eq: float | None = None, gt: float | None = None, lt: float | None = None, idx: str = "idx", name: str = "coord", counts: Observation | None = None) -> ArrayFrame:
    """The cells whose coordinate along `dim` passes. `counts` gets `hits` and `misses` when the result is read."""
    if counts is None:
        # a bad coordinate drops out before the cells are joined
        side = coord.where(predicate(F.col(name), eq, gt, lt))
        return ArrayFrame.of(joined(array, side, dim, idx, name).where("coord IS NOT NULL"), array.dims, array.value, array.shape)
    hit = F.coalesce(predicate(F.col("coord"), eq, gt, lt), F.lit(False))
    seen = joined(array, coord, dim, idx, name).withColumn("__hit", hit).observe(counts, F.count_if("__hit").alias("hits"), F.count_if(~F.col("__hit")).alias("misses"))
    return ArrayFrame.of(seen.where("__hit").drop("__hit"), array.dims, array.value, array.shape)


def hits_by_tile(found: ArrayFrame, tile: Sequence[int], shape: Sequence[int]) -> DataFrame:
    """For each tile with a hit: its last hit in row-major order, all hits in that order, and their number."""
    number = linear_id(found.dims, shape)
    keyed = found.df.select(*tile_key(found.dims, checked(tile)), F.struct(number.alias("at"), F.col(found.value).alias("v")).alias("hit"))
    out = keyed.groupBy(*(f"g{i}" for i in range(len(tile)))).agg(F.max("hit").getField("v").alias("last_hit"), F.sort_array(F.collect_list("hit")).getField("v").alias("hits"), F.count(F.lit(1)).alias("n_hits"))
    return out
