"""Index arithmetic of n-dimensional arrays, on the driver: plain integers and tuples."""

from __future__ import annotations

import math
from collections.abc import Sequence

Shape = tuple[int, ...]


def checked(shape: Sequence[int]) -> Shape:
    out = tuple(int(x) for x in shape)
    if any(x < 1 for x in out):
        raise ValueError(f"a shape has positive lengths: {out}")
    return out


def strides(shape: Sequence[int]) -> Shape:
    """Cells that a step along each dimension skips, in row-major order."""
    return tuple(math.prod(shape[i + 1 :]) for i in range(len(shape)))


def linearize(shape: Sequence[int], coordinate: Sequence[int]) -> int:
    return sum(c * s for c, s in zip(coordinate, strides(shape), strict=True))


def delinearize(shape: Sequence[int], number: int) -> Shape:
    return tuple(number // s % n for s, n in zip(strides(shape), shape, strict=True))


def output_space(shape: Sequence[int], tile: Sequence[int], partial: bool = False) -> Shape:
    """Whole tiles along each dimension; with `partial` those cut off by the edge too."""
    return tuple(-(-n // e) if partial else n // e for n, e in zip(shape, tile, strict=True))


def tile_of(coordinate: Sequence[int], tile: Sequence[int]) -> Shape:
    return tuple(c // e for c, e in zip(coordinate, tile, strict=True))


def expected_cells(shape: Sequence[int], tile: Sequence[int], key: Sequence[int], records: tuple[int, int] | None = None) -> int:
    """Cells of the array in a tile, fewer at the edges and outside the range of records."""
    low, high = box_and((tuple(g * e for g, e in zip(key, tile)), tuple(tile)), ((0,) * len(shape), tuple(shape)))
    if records:
        low, high = box_and((low, high), ((records[0], *(0,) * (len(shape) - 1)), (max(0, records[1] - records[0]), *shape[1:])))
    return math.prod(high)


def box_and(a: tuple[Shape, Shape], b: tuple[Shape, Shape]) -> tuple[Shape, Shape]:
    """What two boxes (corner, shape) share; lengths of 0 where they don't meet."""
    corner = tuple(max(x, y) for x, y in zip(a[0], b[0], strict=True))
    end = tuple(min(x + n, y + m) for x, n, y, m in zip(*a, *b, strict=True))
    return corner, tuple(max(0, e - c) for c, e in zip(corner, end))


def tiles_of_box(corner: Sequence[int], shape: Sequence[int], tile: Sequence[int]) -> tuple[Shape, Shape]:
    """The tiles that a box meets, as a box of keys (corner, shape)."""
    first = tile_of(corner, tile)
    last = tile_of([c + n - 1 for c, n in zip(corner, checked(shape), strict=True)], tile)
    return first, tuple(b - a + 1 for a, b in zip(first, last))
