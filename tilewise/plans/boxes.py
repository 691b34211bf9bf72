"""Boxes [low, high) of an array's index space: cut to a size, put together where they abut, packed into partitions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator, Sequence

Box = tuple[tuple[int, ...], tuple[int, ...]]


def cells(box: Box) -> int:
    return math.prod(max(0, b - a) for a, b in zip(*box))


def both(a: Box, b: Box) -> Box:
    """What two boxes share; empty where `cells` is 0."""
    return tuple(max(x, y) for x, y in zip(a[0], b[0])), tuple(min(x, y) for x, y in zip(a[1], b[1]))


def cut(box: Box, shape: Sequence[int], most: int, align: Sequence[int] = (), origin: Sequence[int] = ()) -> Iterator[Box]:
    """`box` of an array of `shape` as boxes in row-major order, each of whose extent in the file is at most `most` cells: ranges of
    the first dimension that are small enough, else single places of it with ranges of the second one, and so on. With `align`
    ranges begin and end at multiples of it (counted with the box's `origin` added) and are one such multiple at least, however many cells that has."""
    low, high = box
    n = len(shape)
    step = [*align, *[1] * n][:n]
    start = [*origin, *[0] * n][:n]
    if cells(box) == 0:
        return
    d = next(i for i in range(n) if i == n - 1 or math.prod(step[: i + 1]) * math.prod(shape[i + 1 :]) <= most)
    step[d] *= max(1, most // max(1, math.prod(step[: d + 1]) * math.prod(shape[d + 1 :])))
    sides = []
    for i in range(n):
        if i > d:
            sides.append([(low[i], high[i])])
            continue
        first = (low[i] + start[i]) // step[i] * step[i] - start[i]
        edges = [low[i], *range(first + step[i], high[i], step[i]), high[i]]
        sides.append(list(zip(edges[:-1], edges[1:])))
    for part in itertools.product(*sides):
        yield tuple(a for a, _ in part), tuple(b for _, b in part)


def joined(a: Box, b: Box) -> Box | None:
    """The box that two boxes make up where the second follows the first along one dimension, else None."""
    differ = [i for i in range(len(a[0])) if (a[0][i], a[1][i]) != (b[0][i], b[1][i])]
    if len(differ) != 1 or a[1][differ[0]] != b[0][differ[0]]:
        return None
    return a[0], b[1]


def compact(boxes: Iterable[Box]) -> list[Box]:
    """The same cells in fewer boxes: neighbours in row-major order that make up a box, again and again."""
    out: list[Box] = []
    for box in sorted(boxes):
        while out and (one := joined(out[-1], box)):
            out.pop()
            box = one
        out.append(box)
    return out


def runs(hits: Sequence[bool], most: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of true places, `most` at most: where there are more, those with the smallest gaps between them are joined."""
    found: list[tuple[int, int]] = []
    for i, hit in enumerate(hits):
        if hit:
            if found and found[-1][1] == i:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i, i + 1))
    if len(found) <= most:
        return found
    gaps = sorted(range(1, len(found)), key=lambda k: found[k][0] - found[k - 1][1])
    kept = sorted({0, *gaps[len(found) - most :]})
    return [(found[a][0], found[b - 1][1]) for a, b in zip(kept, [*kept[1:], len(found)])]


def packed(costs: Sequence[int], most: int) -> list[list[int]]:
    """Numbers of things in order, as groups whose costs add up to `most` at most; one that costs more stands alone."""
    out: list[list[int]] = []
    left = 0
    for k, cost in enumerate(costs):
        if not out or cost > left:
            out.append([])
            left = most
        out[-1].append(k)
        left -= cost
    return out
