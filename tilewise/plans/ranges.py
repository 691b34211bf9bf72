"""Range partitions of the tiles' key space, and which slabs of input each of them needs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import range_partition
from ..functions.shapes import output_space, strides


@dataclass(frozen=True)
class KeyRanges:
    space: tuple[int, ...]
    parts: int
    record_dim: int
    step: int

    def blocks(self) -> list[tuple[int, int]]:
        """Row-major ranges of key numbers, one for each part; the last takes the rest."""
        size = self.step * strides(self.space)[self.record_dim]
        total = math.prod(self.space)
        return [(min(p * size, total), total if p == self.parts - 1 else min((p + 1) * size, total)) for p in range(self.parts)]


def key_ranges(shape: Sequence[int], tile: Sequence[int], parts: int = 1, key_limit: int | None = None, weight: float = 0.5) -> KeyRanges:
    """Cuts the whole tiles of an array into contiguous ranges of whole slices: at most `parts` of about equal size, or with
    `key_limit` as many as keep each range within it. The slices are those of the first dimension in which one slice is at most
    `weight` of a range; in the last dimension a slice is one key, so every range can be kept within any limit."""
    space = output_space(shape, tile)
    total, sizes = math.prod(space), strides(space)
    if total == 0:
        raise ValueError("no whole tile fits")
    if key_limit is not None and key_limit < 1:
        raise ValueError("key_limit is one key at least")
    target = key_limit or -(-total // parts)
    dim = min(i for i, size in enumerate(sizes) if size == 1 or size <= min(1.0, weight) * target)
    slices = total // sizes[dim]
    step = target // sizes[dim] if key_limit else -(-slices // parts)
    return KeyRanges(space, -(-slices // step), dim, step)


def with_partition(df: DataFrame, ranges: KeyRanges) -> DataFrame:
    """`df` (key columns g0, ...) with the number of its range."""
    keys = [f"g{i}" for i in range(len(ranges.space))]
    return df.withColumn("part", range_partition(keys, ranges.space, ranges.record_dim, ranges.step, ranges.parts))


def repartitioned(df: DataFrame, ranges: KeyRanges) -> DataFrame:
    """Partition p holds range p, in order of the keys."""
    keys = [f"g{i}" for i in range(len(ranges.space))]
    return with_partition(df, ranges).repartitionById(ranges.parts, F.col("part")).sortWithinPartitions(*keys)


def record_slabs(records: int, parts: int | None = None, align: int = 1, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
    """Ranges [low, high) of records for a scan: about `parts` of them, each but the ends a multiple of `align` long so that
    tiles don't straddle them, clipped to the filter."""
    if align < 1:
        raise ValueError("align is a positive number of records")
    step = -(-records // (parts or records or 1))
    step = max(align, -(-step // align) * align)
    low, high = max(0, low or 0), records if high is None else min(records, high)
    return [(max(a, low), min(a + step, high)) for a in range(0, records, step) if max(a, low) < min(a + step, high)]


def dependencies(slabs: DataFrame, ranges: KeyRanges, tile: Sequence[int]) -> DataFrame:
    """Which ranges need which slabs: rows (slab, part) from `slabs` (slab, low, high: records). A slab of records covers
    whole slices of the key space, so each slab's keys are one interval; the parts it meets are computed, not joined."""
    st = strides(ranges.space)
    size = ranges.step * st[ranges.record_dim]
    first, last = F.expr(f"low div {tile[0]}"), F.least(F.expr(f"(high - 1) div {tile[0]}"), F.lit(ranges.space[0] - 1))
    most = F.lit(ranges.parts - 1).cast("long")
    meets = F.sequence(F.least(F.floor(first * st[0] / size), most), F.least(F.floor(((last + 1) * st[0] - 1) / size), most))
    return slabs.where("low < high").where(first <= last).select("slab", F.explode(meets.cast("array<int>")).alias("part"))


def tiles_of_boxes(boxes: DataFrame, lows: Sequence[str], highs: Sequence[str], tile: Sequence[int]) -> DataFrame:
    """Each row of `boxes` once for every tile that its box of cells [low, high) meets, with the tile's key g0, ... and n_cells, the
    cells that both share. Empty boxes meet none."""
    clash = {f"g{i}" for i in range(len(tile))} | {"n_cells"}
    if clash & {c.lower() for c in boxes.columns}:
        raise ValueError(f"columns of these names are added: {', '.join(sorted(clash))}")
    out, cells = boxes, F.lit(1).cast("long")
    for low, high in zip(lows, highs, strict=True):
        out = out.where(F.col(low) < F.col(high))
    for i, (low, high, e) in enumerate(zip(lows, highs, tile, strict=True)):
        a, b = F.floor(F.col(low) / e).cast("int"), F.floor((F.col(high) - 1) / e).cast("int")
        out = out.withColumn(f"g{i}", F.explode(F.sequence(a, b)))
        cells = cells * (F.least(F.col(high), (F.col(f"g{i}") + 1) * e) - F.greatest(F.col(low), F.col(f"g{i}") * e))
    return out.withColumn("n_cells", cells.cast("long"))


def by_file(df: DataFrame, parts: int, column: str = "file") -> DataFrame:
    """All rows of a file in one partition of `parts`."""
    return df.repartition(parts, F.col(column))
