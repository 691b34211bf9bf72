"""Approximate quantiles and distinct counts of tiles from sketches that merge: coarser tiles come from the finer ones' sketches, without the cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tile_key
from ..functions.shapes import checked
from .model import ArrayFrame

#: Accuracy: a quantile's rank is off by about 1.7 / `QUANTILE_K` of the cells with a probability of a hundredth; a distinct count by
#: about 1.04 / 2 ** (`DISTINCT_BITS` / 2) of itself (one standard deviation).
QUANTILE_K, DISTINCT_BITS = 400, 12


def tile_sketches(array: ArrayFrame, tile: Sequence[int], by: Sequence[str] = (), k: int = QUANTILE_K, bits: int = DISTINCT_BITS) -> DataFrame:
    """A row for each tile: g0, ..., quantiles and distinct (sketches, a few kB whatever the tile's size), n_cells. Sketches are made in parts on the
    map side. Null and NaN cells are counted in n_cells only."""
    keys, v = tile_key(array.dims, checked(tile)), F.col(array.value).cast("double")
    placed = array.df.select(*by, *keys, F.when(~F.isnan(v), v).alias("v"))
    names = [*by, *(f"g{i}" for i in range(len(tile)))]
    return placed.groupBy(*names).agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("quantiles"), F.hll_sketch_agg(F.col("v").cast("string"), F.lit(bits)).alias("distinct"), F.count(F.lit(1)).alias("n_cells"))


def coarser(sketches: DataFrame, factors: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Tiles of `factors` finer ones along each dimension. A coarser tile gathers prod(factors) sketches, so go up by small steps."""
    if math.prod(checked(factors)) > 4096:
        raise ValueError("that many sketches for each tile: go up in several steps")
    keys = tile_key([f"g{i}" for i in range(len(factors))], factors)
    up = sketches.select(*by, *keys, "quantiles", "distinct", "n_cells")
    first = F.element_at("parts", 1)
    merged = F.aggregate(F.slice("parts", 2, F.size("parts")), first, F.kll_sketch_merge_double)
    names = [*by, *(f"g{i}" for i in range(len(factors)))]
    out = up.groupBy(*names).agg(F.collect_list("quantiles").alias("parts"), F.hll_union_agg("distinct").alias("distinct"), F.sum("n_cells").alias("n_cells"))
    return out.select(*names, merged.alias("quantiles"), "distinct", "n_cells")


def estimates(sketches: DataFrame, ranks: Sequence[float] = (0.5,)) -> DataFrame:
    """The sketches' tiles with q0, q1, ... (null for a tile without a number) and n_distinct."""
    some = F.kll_sketch_get_n_double("quantiles") > 0
    found = [F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(r)))).alias(f"q{i}") for i, r in enumerate(ranks)]
    return sketches.select(*(c for c in sketches.columns if c not in ("quantiles", "distinct")), *found, F.hll_sketch_estimate("distinct").alias("n_distinct"))
