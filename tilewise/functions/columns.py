"""The same arithmetic as columns: everything stays inside Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import strides


def tile_key(dims: Sequence[str], tile: Sequence[int]) -> list[Column]:
    """g0, g1, ...: each coordinate divided by the tile's length along it, rounded down: cells before 0 lie in tiles before 0."""
    return [F.expr(f"(`{d}` - pmod(`{d}`, {int(e)})) div {int(e)}").cast("int").alias(f"g{i}") for i, (d, e) in enumerate(zip(dims, tile, strict=True))]


def linear_id(columns: Sequence[str], shape: Sequence[int]) -> Column:
    """Row-major number of a cell or tile, as a long."""
    terms = [F.col(c).cast("long") * F.lit(s) for c, s in zip(columns, strides(shape), strict=True)]
    return sum(terms[1:], terms[0])


def coordinates(number: str, shape: Sequence[int], names: Sequence[str]) -> list[Column]:
    """The coordinates of a row-major number."""
    return [F.expr(f"(`{number}` div {s}L) % {n}").cast("int").alias(d) for d, s, n in zip(names, strides(shape), shape, strict=True)]


def in_records(dim: str, low: int | None, high: int | None) -> Column:
    """low <= record < high; None is no bound."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.col(dim) >= low)
    return keep & (F.col(dim) < high) if high is not None else keep


def range_partition(keys: Sequence[str], space: Sequence[int], record_dim: int, step: int, parts: int) -> Column:
    """Contiguous row-major ranges of keys: blocks of `step` along `record_dim`, the last part taking the rest."""
    st = strides(space)
    number = sum((F.col(k).cast("long") * F.lit(s) for k, s in zip(keys[: record_dim + 1], st)), F.lit(0).cast("long"))
    return F.least(F.floor(number / F.lit(step * st[record_dim])), F.lit(parts - 1)).cast("int")
