"""Operators whose partial results are states that merge, and plans that only ship what isn't final yet.

A tile's answer needs all of its cells. Where one task has them all (a tile that lies whole in a slab, or in neighbouring slabs of one
task) the task itself gives the answer; of tiles that the cuts between tasks go through it sends a state each. What the tasks say is written
once, answers and states apart: answers are read back as they are, and only the states are dealt by their tiles and merged.

    class Mode(Operator):
        def types(self, kind): return f"array<struct<v:{kind},n:bigint>>", kind
        ...
    state_agg(array, tile, Mode())            # from cells
    mixed_agg(boxes, shape, tile, Median())   # from a scan with layout=boxes

Null cells are counted in n_cells and don't reach the operator; a tile of nulls only has a null result. Of packed boxes null
places are absent cells, unless `null_cells` says that they are cells. NaN is the largest value, as in Spark.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.columns import tile_key
from ..functions.shapes import checked
from ..session import new_path
from .model import ArrayFrame

#: Tiles whose states a task holds at a time; then it sends all of them.
MOST_HELD = 50_000
#: Cells that a task puts in order by tile at once: the more, the fewer pieces a tile comes in.
CELLS = 1 << 20
#: States, and cells behind them, that are merged in a group, about: tiles aren't cut.
GROUP_STATES, GROUP_CELLS = 1 << 14, 1 << 20


class Operator:
    """A tile's operator in steps. States are plain Python values or arrays, which `pack` turns into a column and `unpack` back."""

    def types(self, kind: str) -> tuple[str, str]:
        """Spark's types of the state and of the result for values of type `kind`."""
        raise NotImplementedError

    def init(self):
        raise NotImplementedError

    def add(self, state, values: np.ndarray):
        """The state with some more values, which are at least one and have no nulls."""
        raise NotImplementedError

    def add_runs(self, values: np.ndarray, ends: np.ndarray) -> list:
        """A state for each run of values, which are those up to `ends`; runs aren't empty."""
        return [self.add(self.init(), values[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge(self, one, other):
        raise NotImplementedError

    def merge_all(self, states: list):
        """The state of one or more states."""
        return functools.reduce(self.merge, states)

    def is_full(self, n_cells: int, expected: int | None) -> bool:
        """Whether no cell can follow: the tile has as many as the array has there."""
        return expected is not None and n_cells >= expected

    def final(self, state):
        raise NotImplementedError

    def final_of(self, cells: np.ndarray):
        """The results of whole tiles, a row of cells each, without nulls."""
        return [self.final(self.add(self.init(), row)) for row in cells]

    def pack(self, states: list, kind: pa.DataType) -> pa.Array:
        return pa.array(states, kind)

    def unpack(self, column: pa.Array) -> list:
        return column.to_pylist()


class Median(Operator):
    """Upper median; its state is the values so far, so a state is as large as what its task has of the tile."""

    def types(self, kind):
        return f"array<{kind}>", kind

    def init(self):
        return []

    def add(self, state, values):
        return [*state, values]

    def merge(self, one, other):
        return [*one, *other]

    def final(self, state):
        return self.final_of(np.concatenate(state)[None, :])[0].item()

    def final_of(self, cells):
        middle = cells.shape[1] // 2
        return np.partition(cells, middle, axis=1)[:, middle]

    def pack(self, states, kind):
        sizes = [sum(map(len, s)) for s in states]
        flat = np.concatenate([x for s in states for x in s]) if sum(sizes) else []
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind.value_type))

    def unpack(self, column):
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [[values[a:b]] for a, b in zip(ends[:-1], ends[1:])]


class Average(Operator):
    def types(self, kind):
        return "struct<sum:double,n:bigint>", "double"

    def init(self):
        return {"sum": 0.0, "n": 0}

    def add(self, state, values):
        return {"sum": state["sum"] + float(values.sum(dtype=float)), "n": state["n"] + len(values)}

    def merge(self, one, other):
        return {"sum": one["sum"] + other["sum"], "n": one["n"] + other["n"]}

    def final(self, state):
        return state["sum"] / state["n"]

    def final_of(self, cells):
        return cells.mean(axis=1, dtype=float)


class _Extreme(Operator):
    def types(self, kind):
        return kind, kind

    def init(self):
        return None

    def add(self, state, values):
        return self.merge(state, self.final_of(values[None, :])[0].item())

    def merge(self, one, other):
        return other if one is None else one if other is None else self.final_of(np.array([[one, other]]))[0].item()

    def final(self, state):
        return state


class Max(_Extreme):
    def final_of(self, cells):
        return cells.max(axis=1)


class Min(_Extreme):
    def final_of(self, cells):
        return np.fmin.reduce(cells, axis=1)


OPERATORS: dict[str, Operator] = {"median": Median(), "average": Average(), "max": Max(), "min": Min()}


def operator(op: str | Operator) -> Operator:
    if isinstance(op, Operator):
        return op
    if op.lower() not in OPERATORS:
        raise ValueError(f"no operator {op} with states; there are {', '.join(sorted(OPERATORS))}")
    return OPERATORS[op.lower()]


def register_operator(name: str, op: Operator) -> None:
    if name.lower() in OPERATORS:
        raise ValueError(f"there is an operator {name}")
    OPERATORS[name.lower()] = op


class _Layout:
    """The rows that tasks send; made on the driver."""

    def __init__(self, op: Operator, kind: str, shape: Sequence[int] | None, tile: Sequence[int]):
        self.op, self.dims, self.shape, self.tile = op, len(tile), shape, tile
        state, self.result = op.types(kind)
        self.ddl = ", ".join(f"g{i} int" for i in range(self.dims)) + f", state {state}, result {self.result}, n_cells long, final boolean"
        schema = StructType.fromDDL(self.ddl)
        self.kinds, self.names = [to_arrow_type(f.dataType) for f in schema], schema.names


class _Held:
    """A task's states by tile, and what it says about them."""

    def __init__(self, layout: _Layout):
        self.op, self.dims, self.shape, self.tile = layout.op, layout.dims, layout.shape, layout.tile
        self.kinds, self.names = layout.kinds, layout.names
        self.states: dict[tuple, list] = {}

    def expected(self, key: tuple) -> int | None:
        return None if self.shape is None else math.prod(max(0, min((g + 1) * e, n) - g * e) for g, e, n in zip(key, self.tile, self.shape))

    def answers(self, keys: np.ndarray, results, n_cells) -> pa.RecordBatch:
        """Final rows; `keys` by dimension."""
        n = keys.shape[1]
        columns = [*(pa.array(k.astype(np.int32)) for k in keys), pa.nulls(n, self.kinds[self.dims]), pa.array(results, self.kinds[self.dims + 1]), pa.array(n_cells, pa.int64()), pa.array(np.ones(n, bool))]
        return pa.RecordBatch.from_arrays(columns, names=self.names)

    def take(self, key: tuple, state, n_cells: int) -> None:
        """A state of some cells of a tile, None if there is no value among them, and the cells' number."""
        own = self.states.setdefault(key, [self.op.init(), 0, False])
        if state is not None:
            own[0], own[2] = self.op.merge(own[0], state) if own[2] else state, True
        own[1] += n_cells

    def add(self, key: tuple, values: np.ndarray, n_cells: int) -> None:
        """Some cells of a tile: the values among them, and their number."""
        own = self.states.setdefault(key, [self.op.init(), 0, False])
        if len(values):
            own[0], own[2] = self.op.add(own[0], values), True
        own[1] += n_cells

    def send(self, only_full: bool) -> Iterator[pa.RecordBatch]:
        """Rows of the tiles that are full, or of all; they are let go."""
        full = {k for k, (_, n, _) in self.states.items() if self.op.is_full(n, self.expected(k))}
        if full:
            some = [(k, *self.states.pop(k)) for k in full]
            yield self.answers(np.array([k for k, *_ in some], np.int64).reshape(-1, self.dims).T, [self.op.final(s) if valued else None for _, s, _, valued in some], [n for *_, n, _ in some])
        if not only_full and self.states:
            some = list(self.states.items())
            n = len(some)
            states = self.op.pack([s if valued else self.op.init() for _, (s, _, valued) in some], self.kinds[self.dims])
            states = pc.if_else(pa.array([valued for _, (_, _, valued) in some]), states, pa.nulls(n, states.type))
            keys = np.array([k for k, _ in some], np.int32).reshape(-1, self.dims).T
            columns = [*(pa.array(k) for k in keys), states, pa.nulls(n, self.kinds[self.dims + 1]), pa.array([m for _, (_, m, _) in some], pa.int64()), pa.array(np.zeros(n, bool))]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)
            self.states.clear()


def _finished(said: DataFrame, layout: _Layout) -> DataFrame:
    """The answers as they are, and those from the merged states of the other tiles."""
    path = new_path(said.sparkSession, "tiles")
    said.write.partitionBy("final").parquet(path)
    read = said.sparkSession.read.schema(said.schema).parquet(path)
    op, dims, kind = layout.op, layout.dims, layout.kinds[layout.dims + 1]
    keys = layout.names[:dims]

    def merged(table: pa.Table) -> pa.Table:
        own = np.stack([table.column(k).to_numpy() for k in keys])
        order = np.lexsort(own[::-1])
        own = own[:, order]
        heads = np.flatnonzero(np.concatenate([[True], (own[:, 1:] != own[:, :-1]).any(axis=0)]))
        column = table.column("state").combine_chunks().take(pa.array(order))
        there = column.is_valid().to_numpy(zero_copy_only=False)
        states = iter(op.unpack(pa.concat_arrays([column.drop_null()])) if there.any() else ())
        some = [list(itertools.islice(states, n)) for n in np.add.reduceat(there.astype(np.int64), heads).tolist()]
        answer = pa.array([op.final(op.merge_all(x)) if x else None for x in some], kind)
        n_cells = np.add.reduceat(table.column("n_cells").to_numpy()[order], heads)
        return pa.table({**{k: pa.array(x.astype(np.int32)) for k, x in zip(keys, own[:, heads])}, "result": answer, "n_cells": pa.array(n_cells, pa.int64())})

    # a group of Spark's costs about a millisecond, so a group is several tiles: as many as a task may well hold the cells of
    sent, cells = read.where("NOT final").agg(F.count(F.lit(1)), F.sum("n_cells")).first()
    groups = max(1, math.ceil(max((cells or 0) / GROUP_CELLS, sent / GROUP_STATES)))
    dealt = read.where("NOT final").select(*keys, "state", "n_cells").groupBy(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("group"))
    rest = dealt.applyInArrow(merged, ", ".join(f"{k} int" for k in keys) + f", result {layout.result}, n_cells long")
    out = read.where("final").select(*keys, "result", "n_cells").union(rest)
    return out.withColumn("is_complete", F.col("n_cells") >= F.lit(math.prod(layout.tile)))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of about `CELLS` rows at a time."""
    some, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            some.append(batch)
            n += batch.num_rows
        if some and (batch is None or n >= CELLS):
            yield [pa.concat_arrays(c.chunks) for c in pa.Table.from_batches(some).columns]
            some, n = [], 0


def state_agg(array: ArrayFrame, tile: Sequence[int], op: str | Operator) -> DataFrame:
    """A row for each tile, as `tiles.tile_agg`, by an operator with states: each task merges what it has of a tile. If the array's shape
    is known, each cell must be there once at most: tiles that a task has whole aren't sent on."""
    tile, dims = checked(tile), len(array.dims)
    layout = _Layout(operator(op), array.df.schema[array.value].dataType.simpleString(), array.shape, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(layout)
        for columns in gathered(batches):
            keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[:dims]])
            order = np.lexsort(keys[::-1])
            keys = keys[:, order]
            heads = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            column = columns[dims]
            valid = column.is_valid().to_numpy(zero_copy_only=False)[order]
            values = column.fill_null(0).to_numpy(zero_copy_only=False)[order][valid]
            n_cells, n_values = np.diff(heads, append=len(order)), np.add.reduceat(valid.astype(np.int64), heads)
            states = iter(held.op.add_runs(values, np.cumsum(n_values[n_values > 0])) if len(values) else ())
            for key, n, some in zip(keys[:, heads].T.tolist(), n_cells.tolist(), n_values.tolist()):
                held.take(tuple(key), next(states) if some else None, n)
            if len(held.states) > MOST_HELD:
                yield from held.send(only_full=False)
        yield from held.send(only_full=False)

    placed = array.df.where(" AND ".join(f"`{d}` IS NOT NULL" for d in array.dims)).select(*tile_key(array.dims, tile), F.col(array.value))
    return _finished(placed.mapInArrow(run, layout.ddl), layout)


def parts_of(corner: Sequence[int], lengths: Sequence[int], tile: Sequence[int], shape: Sequence[int] | None) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], tuple[slice, ...], tuple[int, ...], bool]]:
    """A box as blocks of equal parts of tiles: (first key, tiles along each dimension, place in the box, cells of a part along each dimension, whether
    the parts are all that the array has of their tiles)."""
    sides = []
    for i, (c, n, e) in enumerate(zip(corner, lengths, tile)):
        end, own = c + n, []
        first, last = -(-c // e), end // e
        if first > last:  # inside one tile
            own.append((c // e, 1, 0, n, False))
        else:
            if c % e:
                own.append((c // e, 1, 0, first * e - c, False))
            if last > first:
                own.append((first, last - first, first * e - c, e, True))
            if end % e:
                own.append((last, 1, last * e - c, end - last * e, shape is not None and end == shape[i]))
        sides.append(own)
    for part in itertools.product(*sides):
        place = tuple(slice(a, a + m * size) for _, m, a, size, _ in part)
        yield tuple(g for g, *_ in part), tuple(m for _, m, *_ in part), place, tuple(size for *_, size, _ in part), all(whole for *_, whole in part)


def by_tile(block: np.ndarray, tiles: Sequence[int], size: Sequence[int]) -> np.ndarray:
    """The cells of a block of equal parts, a row for each part."""
    d = len(tiles)
    split = block.reshape([x for pair in zip(tiles, size) for x in pair])
    return split.transpose(*range(0, 2 * d, 2), *range(1, 2 * d, 2)).reshape(math.prod(tiles), -1)


def mixed_agg(boxes: DataFrame, shape: Sequence[int] | None, tile: Sequence[int], op: str | Operator = "median", null_cells: bool = False) -> DataFrame:
    """A row for each tile, as `tiles.tile_agg`, from rows (corner, lengths, values) of packed boxes that don't overlap. Tiles that lie whole in
    a box, or whole in the boxes of one task, are finished there; only states of the others are dealt."""
    tile = checked(tile)
    shape = None if shape is None else checked(shape)
    op, dims = operator(op), len(tile)
    layout = _Layout(op, boxes.schema["values"].dataType.elementType.simpleString(), shape, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(layout)
        for batch in batches:
            for corner, lengths, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                flat = packed.values
                valid = None if flat.null_count == 0 else flat.is_valid().to_numpy(zero_copy_only=False).reshape(lengths)
                block = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(lengths)
                for first, n, place, size, whole in parts_of(corner, lengths, tile, shape):
                    cells, there = by_tile(block[place], n, size), None if valid is None else by_tile(valid[place], n, size)
                    keys = np.indices(n).reshape(dims, -1) + np.array(first)[:, None]
                    plain = np.ones(len(cells), bool) if there is None else there.all(axis=1)
                    if whole and plain.any():
                        yield held.answers(keys[:, plain], op.final_of(cells[plain]), np.full(int(plain.sum()), cells.shape[1]))
                    for k in np.flatnonzero(~plain) if whole else range(len(cells)):
                        own = cells[k] if there is None else cells[k][there[k]]
                        n_cells = cells.shape[1] if null_cells else len(own)
                        if whole:
                            if n_cells:
                                yield held.answers(keys[:, [k]], [op.final(op.add(op.init(), own)) if len(own) else None], [n_cells])
                        elif n_cells:
                            held.add(tuple(keys[:, k].tolist()), own, n_cells)
                yield from held.send(only_full=True)
            if len(held.states) > MOST_HELD:
                yield from held.send(only_full=False)
        yield from held.send(only_full=False)

    rows = boxes.select("corner", "lengths", "values").where("corner IS NOT NULL AND lengths IS NOT NULL AND values IS NOT NULL")
    return _finished(rows.mapInArrow(run, layout.ddl), layout)
