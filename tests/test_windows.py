import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.operators import tiles, windows
from tilewise.operators.model import ArrayFrame

NAN, INF = float("nan"), float("inf")


def rows(df):
    return sorted((tuple("nan" if isinstance(x, float) and x != x else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def exploded(array, window, op):
    """Each cell once for every window that covers it."""
    d, *rest = array.dims
    spread = array.df.withColumn("start", F.explode(F.sequence(F.col(d) - (window - 1), F.col(d)))).where("start >= 0")
    return spread.groupBy("start", *rest).agg(tiles.operator(op)(array.value).alias("result"), F.count(F.lit(1)).alias("n_cells"))


@pytest.mark.parametrize("op", windows.OPERATORS)
@pytest.mark.parametrize("kind", ["int", "double"])
def test_windows_equal_exploded_ones(spark, monkeypatch, op, kind):
    """Sparse cells, repeated cells, nulls, NaN, cells before 0, blocks of a few records, small batches."""
    monkeypatch.setattr(windows, "LEAST_BLOCK", 8)
    monkeypatch.setattr(windows, "BLOCKS", 2)
    rng = np.random.default_rng(3)
    pick = [None, 1, -7, 4, 1 << 30] if kind == "int" else [None, NAN, INF, -INF, 1.5, -2.25, 0.0, 3.0]
    odds = [0.2] * 5 if kind == "int" else [0.2, 0.03, 0.02, 0.02, 0.2, 0.2, 0.2, 0.13]
    made = [(int(d), int(x), None if (v := rng.choice(np.array(pick, object), p=odds)) is None else v) for d, x in rng.integers((-5, 0), (120, 4), (260, 2))]
    df = spark.createDataFrame(made + [(None, 1, pick[-1]), (7, None, pick[-1])], f"t int, x int, value {kind}").repartition(3)
    array = ArrayFrame.of(df, ["t", "x"])
    for window in (1, 5, 17):
        got = tiles.sliding(array, window, op)
        want = exploded(array, window, op)
        assert rows(got) == rows(want) and got.dtypes == [(n, t) for n, t in want.dtypes]


def test_each_cell_is_sent_once_but_for_halos(spark):
    array = ArrayFrame.of(spark.range(20_000).selectExpr("CAST(id AS INT) AS t", "CAST(id AS INT) AS value"), ["t"])
    got = tiles.sliding(array, 50, "sum")
    assert got.where("result <> 50 * start + 1225 AND start <= 19950").count() == 0 and got.count() == 20_000
    node, sent = got._jdf.queryExecution().optimizedPlan().toString(), "Generate explode"
    assert node.count(sent) == 1 and "sequence(" not in node
    block = max(windows.LEAST_BLOCK, windows.BLOCKS * 50)
    assert 49 / block < 0.05


def test_other_operators_and_no_rows(spark):
    array = ArrayFrame.of(spark.createDataFrame([(0, 3), (1, 5), (2, 4)], "t int, value int"), ["t"])
    assert rows(tiles.sliding(array, 2, "median")) == [(0, 5, 2), (1, 5, 2), (2, 4, 1)]
    assert rows(tiles.sliding(ArrayFrame.of(array.df.limit(0), ["t"]), 2)) == []
    with pytest.raises(ValueError, match="one record"):
        tiles.sliding(array, 0)


def test_no_hole_is_made_up_for(spark, monkeypatch):
    """Repeated cells beside holes: as many values as the tile has cells, but not all of its cells."""
    cells = [(a, b, 1) for a in range(4) for b in range(4)]
    cells[5] = cells[6]  # tile (0, 1) now has (1, 2) twice and tile (0, 0) lacks (1, 1)
    cells += [(0, 0, None), (-1, 0, 2)]
    array = ArrayFrame.of(spark.createDataFrame(cells, "d0 int, d1 int, value int"), ["d0", "d1"])
    want = {(0, 0): (4, 3, False), (0, 1): (5, 4, True), (1, 0): (4, 4, True), (1, 1): (4, 4, True), (-1, 0): (1, 1, False)}
    read = lambda df: {(r["g0"], r["g1"]): (r["n_cells"], r["n_distinct"], r["is_complete"]) for r in df.collect()}
    assert read(tiles.tile_agg(array, (2, 2), exact=True)) == want
    assert {k: v[1] for k, v in want.items()} == {(r["g0"], r["g1"]): r["n_distinct"] for r in tiles.cells_seen(array, (2, 2)).collect()}
    monkeypatch.setattr(tiles, "BITMAPS", 0)  # larger tiles: bitmaps one after another
    assert read(tiles.tile_agg(array, (2, 2), exact=True)) == want
    monkeypatch.undo()
    long = ArrayFrame.of(spark.range(100_000).selectExpr("CAST(id AS INT) AS d0", "id AS value"), ["d0"])
    assert read_one(tiles.tile_agg(long, (100_000,), "sum", exact=True)) == [(100_000, 100_000, True)]
    assert read_one(tiles.tile_agg(long.where(F.col("d0") != 70_000), (100_000,), "sum", exact=True)) == [(99_999, 99_999, False)]


def read_one(df):
    return [(r["n_cells"], r["n_distinct"], r["is_complete"]) for r in df.collect()]
