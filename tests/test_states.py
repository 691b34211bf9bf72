import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewise.operators import states, tiles
from tilewise.operators.model import ArrayFrame
from tilewise.queries import Mode
from tilewise.sources import generator, netcdf3

NAN = float("nan")


def rows(df):
    return sorted((tuple(str(x) if isinstance(x, float) and x != x else x for x in r) for r in df.collect()), key=str)


def rounded(found):
    return [tuple(round(x, 9) for x in r) for r in found]


def packed(spark, values, cuts, parts=2):
    """An array as boxes between the cuts along each dimension, dealt to partitions in order."""
    sides = [list(zip([0, *c], [*c, n])) for c, n in zip(cuts, values.shape)]
    made = []
    for box in itertools.product(*sides):
        part = values[tuple(slice(a, b) for a, b in box)]
        if part.size:
            made.append(([a for a, _ in box], list(part.shape), part.ravel().tolist()))
    return spark.createDataFrame(made, f"corner array<int>, lengths array<int>, values array<{'int' if values.dtype.kind == 'i' else 'double'}>").coalesce(parts)


def cells(spark, values):
    dims = [f"d{i}" for i in range(values.ndim)]
    kind = "int" if values.dtype.kind == "i" else "double"
    found = [(*c, None if values[c] is None else values[c].item() if hasattr(values[c], "item") else values[c]) for c in np.ndindex(values.shape)]
    return ArrayFrame.of(spark.createDataFrame(found, ", ".join(f"{d} int" for d in dims) + f", value {kind}"), dims, shape=values.shape)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=3), st.data())
def test_parts_of_a_box(lengths, data):
    tile = [data.draw(st.integers(1, 5)) for _ in lengths]
    corner = [data.draw(st.integers(0, 6)) for _ in lengths]
    shape = [c + n + data.draw(st.integers(0, 3)) for c, n in zip(corner, lengths)]
    seen = np.zeros(lengths, int)
    block = np.arange(math.prod(lengths)).reshape(lengths)
    for first, n, place, size, whole in states.parts_of(corner, lengths, tile, shape):
        seen[place] += 1
        own = states.by_tile(block[place], n, size)
        for k, offset in enumerate(np.ndindex(*n)):
            key = [a + b for a, b in zip(first, offset)]
            inside = [c for c in np.ndindex(*lengths) if [(x + y) // e for x, y, e in zip(c, corner, tile)] == key]
            assert sorted(own[k]) == sorted(block[c] for c in inside)
            assert whole == (len(inside) == math.prod(min((g + 1) * e, m) - g * e for g, e, m in zip(key, tile, shape)))
    assert (seen == 1).all()


@pytest.mark.parametrize("op", ["median", "average", "max", "min"])
def test_mixed_plan_equals_tile_agg(spark, op):
    rng = np.random.default_rng(1)
    for shape, tile, cuts in (((7, 10), (3, 4), ([2, 5], [1, 9])), ((6, 4, 5), (2, 3, 2), ([1], [2], [])), ((12,), (5,), ([4, 6, 7],)), ((3, 3), (8, 8), ([1], [2]))):
        values = rng.integers(-40, 40, shape).astype("i4")
        want = rows(tiles.tile_agg(cells(spark, values), tile, op))
        for parts in (1, 3):
            got = rows(states.mixed_agg(packed(spark, values, cuts, parts), shape, tile, op))
            assert rounded(got) == rounded(want)
        assert rounded(rows(states.state_agg(cells(spark, values), tile, op))) == rounded(want)


def test_nulls_and_nan_mean_the_same_everywhere(spark):
    """Null cells count and have no rank, NaN is the largest: grouped, from states, from boxes and from aligned slabs."""
    rng = np.random.default_rng(7)
    values = rng.normal(size=(8, 6)).round(2).astype(object)
    for c in np.ndindex(8, 6):
        values[c] = rng.choice([float(values[c]), None, NAN], p=[0.5, 0.3, 0.2])
    values[0:2, 0:3] = None
    values[2, 0], values[2, 1:3], values[3, 0], values[3, 1:3] = 1.0, 2.0, None, None
    array = cells(spark, values)
    for op in ("median", "max", "min"):
        want = rows(tiles.tile_agg(array, (2, 3), op))
        assert rows(states.state_agg(array, (2, 3), op)) == want
        assert rows(states.mixed_agg(packed(spark, values, ([3, 6], [2])), (8, 6), (2, 3), op, null_cells=True)) == want
        if op == "median":
            slabs = packed(spark, values, ([2, 4], [])).select(F.col("corner")[0].alias("low"), "values")
            assert rows(tiles.merge_median(slabs, (2, 6), (2, 3), 2)) == want and (0, 0, None, 6, True) in want and (1, 0, 2.0, 6, True) in want
    absent = ArrayFrame.of(array.df.where("value IS NOT NULL"), array.dims)
    assert rows(states.mixed_agg(packed(spark, values, ([3, 6], [2])), (8, 6), (2, 3))) == rows(tiles.tile_agg(absent, (2, 3)))


def test_only_cut_tiles_are_shuffled(spark, tmp_path, monkeypatch):
    """Files of 10 records, tiles of 4: states are sent of tiles that records 10 and 20 lie inside of, and no others."""
    for k in range(3):
        generator.write_incrementing(f"{tmp_path}/f{k}.nc", (10, 6, 5), ["t", "x", "y"])
    boxes = netcdf3.scan(spark, f"file://{tmp_path}", variable="windspeed1", layout="boxes", numPartitions=1)
    said = {}
    monkeypatch.setattr(states, "_finished", lambda df, layout: said.setdefault("rows", df.collect()))
    states.mixed_agg(boxes, (30, 6, 5), (4, 2, 5))
    monkeypatch.undo()
    assert {r["g0"] for r in said["rows"] if not r["final"]} == {2} and sum(not r["final"] for r in said["rows"]) == 2 * 3
    assert sum(r["final"] for r in said["rows"]) == 7 * 3  # tiles of records 20 to 23 begin with a file
    got = states.mixed_agg(boxes, (30, 6, 5), (4, 2, 5))
    assert rows(got) == rows(tiles.tile_agg(ArrayFrame.of(netcdf3.scan(spark, f"file://{tmp_path}", variable="windspeed1"), ["t", "x", "y"]), (4, 2, 5)))
    one = states.mixed_agg(netcdf3.scan(spark, f"file://{tmp_path}", variable="windspeed1", layout="boxes"), (30, 6, 5), (4, 2, 5))
    assert rows(one) == rows(got)  # all files in one partition: nothing is cut
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("FlatMapGroupsInArrow")


def test_an_operator_of_ones_own(spark):
    rng = np.random.default_rng(2)
    rows_ = [(int(a), int(b), None if v == 5 else int(v)) for a, b, v in rng.integers(0, (20, 9, 6), (600, 3))]
    array = ArrayFrame.of(spark.createDataFrame(rows_, "d0 int, d1 int, value int").repartition(3), ["d0", "d1"])
    want = {}
    for a, b, v in rows_:
        want.setdefault((a // 4, b // 3), []).append(v)
    got = {tuple(r[:2]): (r["result"], r["n_cells"]) for r in states.state_agg(array, (4, 3), Mode()).collect()}
    values = {k: [v for v in own if v is not None] for k, own in want.items()}
    assert got == {k: (min(set(v), key=lambda x: (-v.count(x), x)) if v else None, len(want[k])) for k, v in values.items()}
    with pytest.raises(ValueError, match="there is an operator"):
        states.register_operator("Median", Mode())
    with pytest.raises(ValueError, match="no operator"):
        states.operator("mode")
    states.register_operator("mode", Mode())
    assert states.state_agg(ArrayFrame.of(array.df.limit(0), array.dims), (4, 3), "mode").count() == 0
    del states.OPERATORS["mode"]


def test_full_tiles_of_a_known_shape_are_finished_in_tasks(spark, monkeypatch):
    said = {}
    monkeypatch.setattr(states, "_finished", lambda df, layout: said.setdefault("rows", df.collect()))
    states.state_agg(ArrayFrame.of(generator.incrementing(spark, (8, 4)).df.coalesce(1), ["d0", "d1"], shape=(8, 4)), (3, 2), "max")
    assert len(said["rows"]) == 6 and all(r["final"] for r in said["rows"])


def test_many_tiles_are_sent_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(states, "MOST_HELD", 3)
    array = generator.incrementing(spark, (9, 9))
    assert rows(states.state_agg(ArrayFrame.of(array.df, array.dims), (2, 2), "median")) == rows(tiles.tile_agg(array, (2, 2)))


def test_tiles_are_gathered_before_states_are_made(spark):
    """A tile's cells that lie all over a task make one state, and merging takes a group for many tiles: the work follows the cells, not tiles times batches."""
    df = spark.range(60_000).selectExpr("CAST(id * 7919 % 60000 AS INT) AS d0", "CAST(0 AS INT) AS d1", "IF(id % 11 = 0, NULL, IF(id % 13 = 0, double('NaN'), id % 5)) AS value").coalesce(1)
    array = ArrayFrame.of(df, ["d0", "d1"])
    calls = spark.sparkContext.accumulator(0)

    class Counted(Mode):
        def add_runs(self, values, ends):
            calls.add(len(ends))
            return super().add_runs(values, ends)

    found = states.state_agg(array, (100, 1), Counted())
    want = array.df.where("value IS NOT NULL").groupBy(F.expr("d0 div 100").cast("int").alias("g0"), "value").count()
    want = {r["g0"]: str(r["v"]) for r in want.groupBy("g0").agg(F.min(F.struct((-F.col("count")).alias("n"), "value"))["value"].alias("v")).collect()}
    assert {r["g0"]: str(r["result"]) for r in found.collect()} == want and found.where("n_cells = 100 AND is_complete").count() == 600
    assert calls.value == 600
