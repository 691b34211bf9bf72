import numpy as np
import pytest

from tilewise.operators import sketches
from tilewise.operators.model import ArrayFrame

RANKS = (0.05, 0.5, 0.9)


def test_levels_from_the_sketches_alone(spark):
    """Ranks within 1 % of the cells and distinct counts within 6 % at each of three levels, each made from the one before."""
    df = spark.range(64 * 4000).selectExpr("CAST(id div 4000 AS INT) AS d0", "CAST(id % 4000 AS INT) AS d1", "floor(pow(rand(5), 3) * 20000) AS value").repartition(4).cache()
    cells = df.toPandas()
    level, size = sketches.tile_sketches(ArrayFrame.of(df, ["d0", "d1"]), (8, 2000)), (8, 2000)
    for factors in (None, (2, 2), (4, 1)):
        if factors:
            level, size = sketches.coarser(level, factors), tuple(a * b for a, b in zip(size, factors))
        plan = level._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("kll_sketch_agg") == 1 and plan.count("inmemoryrelation") == 1 and "join" not in plan
        rows = sketches.estimates(level, RANKS).collect()
        assert len(rows) == -(-64 // size[0]) * -(-4000 // size[1])
        for r in rows:
            own = np.sort(cells[(cells.d0 // size[0] == r["g0"]) & (cells.d1 // size[1] == r["g1"])].value.to_numpy())
            assert r["n_cells"] == len(own) and abs(r["n_distinct"] / len(np.unique(own)) - 1) < 0.06
            for i, rank in enumerate(RANKS):
                low, high = np.searchsorted(own, r[f"q{i}"], "left") / len(own), np.searchsorted(own, r[f"q{i}"], "right") / len(own)
                assert low - 0.01 <= rank <= high + 0.01
    df.unpersist()


def test_nulls_and_few_cells(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, None), (3, float("nan")), (5, None), (-1, 7.0)], "d0 int, value double")
    fine = sketches.tile_sketches(ArrayFrame.of(df, ["d0"]), (4,))
    read = lambda s: sorted(tuple(r) for r in sketches.estimates(s, (0.5,)).collect())
    assert read(fine) == [(-1, 1, 7.0, 1), (0, 4, 1.0, 2), (1, 1, None, 0)]
    assert read(sketches.coarser(fine, (2,))) == [(-1, 1, 7.0, 1), (0, 5, 1.0, 2)]
    with pytest.raises(ValueError, match="several steps"):
        sketches.coarser(fine, (5000,))
    assert read(sketches.tile_sketches(ArrayFrame.of(df.limit(0), ["d0"]), (4,))) == []
