import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewise.operators import coords, tiles
from tilewise.operators.model import ArrayFrame
from tilewise.plans import boxes, ranges
from tilewise.sources import generator, netcdf3


def places(box):
    return set(itertools.product(*(range(a, b) for a, b in zip(*box))))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 7), min_size=1, max_size=4), st.integers(1, 60), st.data())
def test_boxes_are_cut_and_put_together(shape, most, data):
    low = tuple(data.draw(st.integers(0, n)) for n in shape)
    high = tuple(data.draw(st.integers(a, n)) for a, n in zip(low, shape))
    align = [data.draw(st.integers(1, 4)) for _ in shape] if data.draw(st.booleans()) else []
    origin = [data.draw(st.integers(0, 5)) for _ in shape]
    found = list(boxes.cut((low, high), shape, most, align, origin))
    assert sum(boxes.cells(b) for b in found) == len(places((low, high))) == len(set().union(*map(places, found)) & places((low, high)))
    for a, b in found:
        if not align:  # one run of the file, but for what a filter cuts from inner dimensions
            d = next(i for i in range(len(shape)) if i == len(shape) - 1 or math.prod(shape[i + 1 :]) <= most)
            assert all(y - x == 1 for x, y in zip(a[:d], b[:d])) and (b[d] - a[d]) * math.prod(shape[d + 1 :]) <= max(most, math.prod(shape[d + 1 :]))
        else:  # each end is a multiple, or the end of what was given
            assert all(x in (lo,) or (x + o) % e == 0 for x, lo, o, e in zip(a, low, origin, align))
    merged = boxes.compact(found)
    assert sum(boxes.cells(b) for b in merged) == boxes.cells((low, high)) and len(merged) <= len(found)
    if not align and found:
        assert merged == [(low, high)]


@given(st.lists(st.booleans(), max_size=60), st.integers(1, 6))
def test_runs_hold_every_hit(hits, most):
    found = boxes.runs(hits, most)
    inside = {i for a, b in found for i in range(a, b)}
    assert len(found) <= most and inside >= {i for i, h in enumerate(hits) if h} and all(hits[a] and hits[b - 1] for a, b in found)
    if len(boxes.runs(hits, 100)) <= most:
        assert inside == {i for i, h in enumerate(hits) if h}


@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 50))
def test_packing(costs, most):
    groups = boxes.packed(costs, most)
    assert list(itertools.chain(*groups)) == list(range(len(costs)))
    assert all(sum(costs[k] for k in g) <= most or len(g) == 1 for g in groups)
    assert all(sum(costs[k] for k in a) + costs[b[0]] > most for a, b in zip(groups, groups[1:]))


def scan(spark, folder, **options):
    return netcdf3.scan(spark, f"file://{folder}", **{"variable": "windspeed1", **options})


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("unlimited", [True, False])
def test_slabs_inside_records(spark, tmp_path, monkeypatch, unlimited):
    """Records of 24 kB in partitions of 4 kB, and no read of more than that."""
    shape = (3, 20, 300)
    generator.write_incrementing(f"{tmp_path}/a.nc", shape, ["t", "x", "y"], unlimited=unlimited)
    cut = netcdf3.describe_partitions(spark, f"{tmp_path}/a.nc", inside=True, variable="windspeed1", maxPartitionBytes="4000").collect()
    assert len({r["partition"] for r in cut}) == len(cut) == 21 and max(r["cells"] for r in cut) == 900 and {tuple(r["lengths"]) for r in cut} == {(1, 3, 300), (1, 2, 300)}
    assert [tuple(r["corner"]) for r in cut[:3]] == [(0, 0, 0), (0, 3, 0), (0, 6, 0)]
    whole = rows(scan(spark, tmp_path, numPartitions=1))
    assert whole == [(t, x, y, t * 6000 + x * 300 + y) for t in range(3) for x in range(20) for y in range(300)]
    assert rows(scan(spark, tmp_path, maxPartitionBytes=4000)) == whole
    assert rows(scan(spark, tmp_path, maxPartitionBytes=1024).where("x > 17 AND y < 2")) == [r for r in whole if r[1] > 17 and r[2] < 2]
    assert scan(spark, tmp_path, maxPartitionBytes=4000).where("x = 4").rdd.getNumPartitions() == 3
    # what a task holds is bounded too: blocks of 500 cells
    monkeypatch.setattr(netcdf3, "BATCH_CELLS", 500)
    source = netcdf3.NetCDF3({"path": f"{tmp_path}/a.nc", "variable": "windspeed1,y,t", "maxPartitionBytes": "100000"})
    reader = source.reader(source.schema())
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) <= 500
    assert sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))) == [(*r, float(r[2]), r[0]) for r in whole]


def test_boxes_of_a_layout(spark, tmp_path, monkeypatch):
    generator.write_incrementing(f"{tmp_path}/a.nc", (5, 6, 7), ["t", "x", "y"])
    generator.write_incrementing(f"{tmp_path}/b.nc", (4, 6, 7), ["t", "x", "y"])
    found = scan(spark, tmp_path, layout="boxes", align="2,3", maxPartitionBytes=1024, numPartitions=2).collect()
    cells = {}
    for r in found:
        assert r["corner"][0] % 2 == 0 or r["corner"][0] == 5
        for k, at in enumerate(np.ndindex(*r["lengths"])):
            cells[tuple(a + b for a, b in zip(at, r["corner"]))] = r["values"][k]
    assert cells == {tuple(r[:3]): r[3] for r in scan(spark, tmp_path).collect()}
    with pytest.raises(Exception, match="not of several"):
        scan(spark, tmp_path, layout="boxes", variable="windspeed1,t").count()


def test_small_files_share_partitions(spark, tmp_path):
    """A thousand files of a few hundred bytes: few partitions, the same cells, slabs put together in none over files."""
    for k in range(1000):
        generator.write_incrementing(f"{tmp_path}/f{k:04d}.nc", (2, 3), ["t", "x"], unlimited=k % 2 == 0)
    found = scan(spark, tmp_path)
    assert found.rdd.getNumPartitions() == 2  # of 32 MB, where opening a file counts for 64 kB
    assert scan(spark, tmp_path, maxPartitionBytes=1000, openCostBytes=76).rdd.getNumPartitions() == 100
    assert found.count() == 6000 and found.agg(F.max("t")).first()[0] == 1999
    assert found.groupBy("t").count().where("count <> 3").count() == 0
    one = scan(spark, tmp_path, variable="windspeed1", fileColumn="file").where("t = 1001").select("file", "value").collect()
    assert [(r["file"].rpartition("/")[2], r["value"]) for r in sorted(one, key=lambda r: r["value"])] == [("f0500.nc", v) for v in (3, 4, 5)]


def test_adjacent_slabs_are_one_read(spark, tmp_path):
    """Ranges of a coordinate in one partition are put together again where they abut."""
    generator.write_incrementing(f"{tmp_path}/a.nc", (40, 3), ["t", "x"])
    cut = netcdf3.describe_partitions(spark, f"{tmp_path}/a.nc", variable="windspeed1", maxPartitionBytes="1000000", coordinate="t", coordinateGt="3", coordinateLt="30").collect()
    assert [(r["low"], r["high"]) for r in cut] == [(4, 30)]


def test_patterns_in_every_part(spark, tmp_path):
    for name in ("2001/a", "2001/b", "2002/a", "other/a"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        generator.write_incrementing(f"{tmp_path}/{name}.nc", (1, 2), ["t", "x"])
    names = lambda p: [f.removeprefix(f"file://{tmp_path}/") for f in netcdf3.find_files(f"file://{tmp_path}/{p}")]
    assert names("200?/a.nc") == ["2001/a.nc", "2002/a.nc"] and names("200[13]/*.nc") == ["2001/a.nc", "2001/b.nc"]
    assert names("*/b.nc") == ["2001/b.nc"] and names("20*") == ["2001/a.nc", "2001/b.nc", "2002/a.nc"] and names("x*/a.nc") == []
    assert netcdf3.find_files(f"{tmp_path}/2001/a.nc") == [f"{tmp_path}/2001/a.nc"] and len(netcdf3.find_files(f"{tmp_path}/2001")) == 2
    assert netcdf3.scan(spark, f"file://{tmp_path}/*/a.nc", variable="windspeed1").count() == 6


def test_coordinate_of_each_file(spark, tmp_path):
    """Only places that pass are read, along any dimension; as the filter over all cells says."""
    rng = np.random.default_rng(4)
    for k in range(6):
        depth = np.array([k * 10, k * 10 + 1, 5.5, np.nan], "f8")
        data = {"w": (["t", "x", "y"], rng.integers(0, 99, (4, 3, 5)).astype("i4"), {}), "depth": (["t"], depth, {}), "y": (["y"], np.array([3, 1, 2, 16777217, 2], "f8"), {}), "two": (["x", "y"], np.zeros((3, 5)), {})}
        netcdf3.write_file(f"{tmp_path}/f{k}.nc", [("t", 4), ("x", 3), ("y", 5)], data, record="t" if k % 2 else None)
    load = lambda **o: scan(spark, tmp_path, variable="w", **o)
    for name, dim, options in (("depth", "t", {"gt": 19.5, "lt": 31}), ("depth", "t", {"eq": 5.5}), ("y", "y", {"eq": 2}), ("y", "y", {"eq": 16777216}), ("y", "y", {"gt": 1}), ("depth", "t", {"gt": 1000}), ("depth", "t", {})):
        found = load(coordinate=name, **{f"coordinate{k.title()}": v for k, v in options.items()})
        keep = coords.predicate(F.col(f"{name}_value" if name == dim else name), **options)
        want = scan(spark, tmp_path, variable=f"w,{name}").where(keep if options else F.lit(True)).select("t", "x", "y", "w")
        assert rows(found) == rows(want), (name, options)
    cut = netcdf3.describe_partitions(spark, f"{tmp_path}", variable="w", coordinate="depth", coordinateGt="19.5", coordinateLt="31").collect()
    assert sum(r["cells"] for r in cut) == 3 * 15 and {r["file"][-5:] for r in cut} == {"f2.nc", "f3.nc"}
    with pytest.raises(Exception, match="isn't a coordinate"):
        load(coordinate="two").count()


def test_many_ranges_are_checked_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(netcdf3, "MOST_RUNS", 2)
    data = {"w": (["t"], np.arange(50, dtype="i4"), {}), "side": (["t"], np.arange(50) % 3.0, {})}
    netcdf3.write_file(f"{tmp_path}/a.nc", [("t", 50)], data)
    source = netcdf3.NetCDF3({"path": f"{tmp_path}/a.nc", "variable": "w", "coordinate": "side", "coordinateEq": "1"})
    reader = source.reader(source.schema())
    found = reader.partitions()
    assert sum(len(p.slabs) for p in found) <= 2
    assert [v for p in found for b in reader.read(p) for v in b.column(1).to_pylist()] == list(range(1, 50, 3))


def save(df, folder, **options):
    df.sparkSession.dataSource.register(netcdf3.NetCDF3)
    df.write.format("netcdf3").options(**options).mode("append").save(f"file://{folder}")


@pytest.mark.parametrize("batch", [None, 7])
def test_sink_in_key_order(spark, tmp_path, monkeypatch, batch):
    """Sparse tiles in ranges of keys: what is written comes back, with gaps between and inside records, from several variables."""
    if batch:
        monkeypatch.setattr(netcdf3, "BATCH_CELLS", batch)
    rng = np.random.default_rng(3)
    cells = {(int(a), int(b), int(c)) for a, b, c in rng.integers(0, (30, 4, 5), (220, 3))} | {(29, 3, 4)}
    rows_ = [(*c, float(n), n) for n, c in enumerate(sorted(cells))]
    df = spark.createDataFrame(rows_, "g0 int, g1 int, g2 int, mean double, n int")
    plan = ranges.key_ranges((30, 4, 5), (1, 1, 1), parts=4)
    dealt = ranges.repartitioned(df, plan).drop("part")
    save(dealt, tmp_path / "two", variable="mean,n", shape="4,5")
    assert rows(netcdf3.scan(spark, f"file://{tmp_path}/two", variable="mean,n")) == rows_
    save(dealt.select("g0", "g1", "g2", F.col("mean").alias("value")), tmp_path / "one", variable="mean", shape="4,5")
    assert rows(netcdf3.scan(spark, f"file://{tmp_path}/one", variable="mean")) == [r[:4] for r in rows_]
    files = netcdf3.find_files(f"{tmp_path}/two")
    heads = [netcdf3.read_header(f) for f in files]
    assert len(files) == 4 and all(h.dimensions[0] == ("g0", 0) and set(h.variables) == {"mean", "n"} for h in heads) and sum(h.records for h in heads) <= 30
    null = netcdf3.scan(spark, f"file://{tmp_path}/two", variable="mean,n", fillAsNull="true")
    assert null.where("mean IS NULL AND n IS NULL").count() + len(rows_) == null.count()
    assert netcdf3.scan(spark, f"file://{tmp_path}/two", variable="n", fillAsNull="false").where("value = -2147483647").count() == null.where("n IS NULL").count()


def test_sink_variables_of_a_record(spark, tmp_path):
    df = spark.range(40).selectExpr("CAST(id div 4 AS INT) AS t", "CAST(id % 4 AS INT) AS x", "CAST(id AS SMALLINT) AS w", "CAST(id div 4 * 2.5 AS FLOAT) AS depth", "id div 4 AS label").coalesce(1)
    save(df, tmp_path / "o", variable="w", recordVariable="depth,label", shape=4)
    assert rows(netcdf3.scan(spark, f"file://{tmp_path}/o", variable="w,depth,label")) == [(k // 4, k % 4, k, k // 4 * 2.5, k // 4) for k in range(40)]
    assert rows(netcdf3.scan(spark, f"file://{tmp_path}/o", variable="depth")) == [(k, k * 2.5) for k in range(10)]


def test_sink_refuses(spark, tmp_path):
    df = spark.range(12).selectExpr("CAST(id div 3 AS INT) AS t", "CAST(id % 3 AS INT) AS x", "CAST(id AS INT) AS value").coalesce(1)
    for frame, options, message in (
        (df.orderBy(F.desc("t")).coalesce(1), {"shape": 3}, "in order"), (df, {"shape": 2}, "outside of the shape"), (df, {"shape": "3,3"}, "each dimension but the first"), (df, {"variable": "value,x"}, "need the option shape"),
        (df, {"variable": "value,other", "shape": 3}, "a column `other`"), (df.withColumn("value", F.lit("x")), {}, "no numbers for string"), (df.withColumn("t", F.when(F.col("t") > 1, F.col("t"))), {"shape": 3}, "no nulls"),
        (df.withColumn("t", F.col("t").cast("long") * 900_000_000), {"shape": 3}, "too many absent|32-bit"),
    ):
        with pytest.raises(Exception, match=message):
            save(frame, tmp_path / "o", **{"variable": "w", **options})
        assert not list((tmp_path / "o").glob("*.nc"))


def test_absent_cells_stay_absent(spark, tmp_path):
    cells = [(0, 0, 1), (0, 2, 2), (2, 1, 3), (2, 2, None)]
    df = spark.createDataFrame(cells, "d0 int, d1 int, value int").coalesce(1)
    save(df, tmp_path / "o", variable="w")
    load = lambda **o: netcdf3.scan(spark, f"file://{tmp_path}/o", variable="w", **o)
    assert rows(load()) == cells[:3]
    assert load(fillAsNull="true").where("value IS NULL").count() == 6 and load(fillAsNull="false").where("value < 0").count() == 6
    boxes_ = load(layout="boxes").collect()
    assert [(r["corner"], r["lengths"], r["values"]) for r in boxes_] == [([0, 0], [3, 3], [1, None, 2, None, None, None, None, 3, None])]
    with pytest.raises(Exception, match="absent cells"):
        load(layout="slabs").count()
    data = {"w": (["t"], np.array([1.0, np.nan, 3.0]), {"_FillValue": np.array([np.nan])}), "plain": (["t"], np.array([1.0, netcdf3.FILLS["f8"], np.nan]), {})}
    netcdf3.write_file(f"{tmp_path}/n.nc", [("t", 3)], data)
    assert rows(netcdf3.scan(spark, f"file://{tmp_path}/n.nc", variable="w")) == [(0, 1.0), (2, 3.0)]
    assert netcdf3.scan(spark, f"file://{tmp_path}/n.nc", variable="plain").count() == 3  # no fill value of its own


def test_places_of_own_and_foreign_files(spark, tmp_path):
    save(spark.range(4).selectExpr("CAST(id + 3 AS INT) AS t", "CAST(0 AS INT) AS x", "CAST(id AS INT) AS value").coalesce(1), tmp_path, variable="w")
    data = {"w": (["t", "x"], np.array([[7], [8]], "i4"), {})}
    netcdf3.write_file(f"{tmp_path}/z.nc", [("t", 2), ("x", 1)], data, attributes={"corner": "north", netcdf3.CORNER + "x": np.array([5], "i4")})
    assert rows(scan(spark, tmp_path, variable="w")) == [(3, 0, 0), (4, 0, 1), (5, 0, 2), (6, 0, 3), (7, 0, 7), (8, 0, 8)]
    assert rows(scan(spark, tmp_path, variable="w", multiFileMode="combine")) == [(0, 0, 0), (0, 0, 7), (1, 0, 1), (1, 0, 8), (2, 0, 2), (3, 0, 3)]


def test_cells_before_zero(spark):
    """Tiles of keys, of boxes and of shapes agree on one rule: rounded down."""
    df = spark.createDataFrame([(a, b, 1) for a in range(-5, 5) for b in range(-3, 4)], "d0 int, d1 int, value int")
    got = {(r["g0"], r["g1"]): r["n_cells"] for r in tiles.tile_agg(ArrayFrame.of(df, ["d0", "d1"]), (3, 4), "count").collect()}
    box = spark.createDataFrame([(-5, 5, -3, 4)], "a int, b int, c int, d int")
    assert got == {(r["g0"], r["g1"]): r["n_cells"] for r in ranges.tiles_of_boxes(box, ["a", "c"], ["b", "d"], (3, 4)).collect()}
