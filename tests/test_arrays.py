import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tilewise.functions import shapes
from tilewise.operators import coords, tiles
from tilewise.operators.model import ArrayFrame, concat
from tilewise.plans import ranges
from tilewise.sources import generator, netcdf3, text
from tilewise.streaming.early import early_medians

SHAPES = st.lists(st.integers(1, 6), min_size=1, max_size=5)


@given(SHAPES, st.data())
def test_linear_numbers_and_back(shape, data):
    n = data.draw(st.integers(0, math.prod(shape) - 1))
    assert shapes.linearize(shape, shapes.delinearize(shape, n)) == n
    assert shapes.delinearize(shape, n) == tuple(int(x) for x in np.unravel_index(n, shape))


@given(SHAPES, st.data())
def test_expected_cells_add_up(shape, data):
    tile = [data.draw(st.integers(1, 4)) for _ in shape]
    keys = itertools.product(*(range(n) for n in shapes.output_space(shape, tile, partial=True)))
    low = data.draw(st.integers(0, shape[0]))
    sums = [0, 0]
    for k in keys:
        sums[0] += shapes.expected_cells(shape, tile, k)
        sums[1] += shapes.expected_cells(shape, tile, k, (low, shape[0]))
    assert sums == [math.prod(shape), math.prod(shape[1:]) * (shape[0] - low)]


def brute(shape, tile, values, pick):
    out = {}
    for c in itertools.product(*map(range, shape)):
        out.setdefault(tuple(x // e for x, e in zip(c, tile)), []).append(values[c])
    return {k: pick(v) for k, v in out.items()}


@pytest.mark.parametrize("shape,tile", [((7, 10), (3, 4)), ((5,), (2,)), ((2, 3, 4, 2, 3), (2, 2, 3, 1, 2)), ((4, 4), (1, 1)), ((4, 6), (4, 6)), ((3, 5), (10, 10))])
def test_median_against_brute_force(spark, shape, tile):
    rng = np.random.default_rng(1)
    values = rng.integers(-50, 50, shape)
    rows = [(*c, int(values[c])) for c in itertools.product(*map(range, shape))]
    dims = [f"d{i}" for i in range(len(shape))]
    array = ArrayFrame.of(spark.createDataFrame(rows, ", ".join(f"{d} int" for d in dims) + ", value int"), dims, shape=shape)
    want = brute(shape, tile, values, lambda v: (sorted(v)[len(v) // 2], len(v)))
    for op in ("median", "supersimplemedian"):
        got = {tuple(r[: len(shape)]): (r["result"], r["n_cells"]) for r in tiles.tile_agg(array, tile, op).collect()}
        assert got == want
    assert {r["n_cells"] for r in tiles.tile_agg(array, tile, drop_partial=True).collect()} <= {math.prod(tile)}


def test_known_medians(spark):
    shape, tile = (10, 36, 36, 50), (2, 6, 6, 10)
    got = tiles.tile_agg(generator.incrementing(spark, shape), tile).orderBy("g0", "g1", "g2", "g3").collect()
    assert [r["result"] for r in got[:3]] == [64800, 64810, 64820]
    assert all(r["result"] == generator.known_median(shape, tile, r[:4]) for r in got)


def test_operators_are_checked(spark):
    with pytest.raises(ValueError):
        tiles.operator("mode")
    with pytest.raises(ValueError):
        tiles.register_operator("median", F.max)
    tiles.register_operator("spread", lambda v: F.max(v) - F.min(v))
    got = tiles.tile_agg(generator.incrementing(spark, (4, 4)), (2, 2), "spread").collect()
    assert {r["result"] for r in got} == {5}


def test_coordinates(spark):
    array = generator.incrementing(spark, (3, 4))
    coord = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 16777217.0), (3, None)], "idx int, coord double")
    both = lambda **k: sorted(r["value"] for r in coords.coordinate_filter(array, coord, "d1", **k).cells().collect())
    assert both(eq=16777216.0) == [2, 6, 10]  # alike as 32-bit floats
    assert both(gt=-1) == [1, 2, 5, 6, 9, 10] and both(lt=0.5) == [0, 1, 4, 5, 8, 9]
    seen = Observation()
    found = coords.coordinate_filter(array, coord, "d1", gt=-0.5, lt=1, counts=seen)
    hits = coords.hits_by_tile(found, (2, 2), (3, 4)).orderBy("g0").collect()
    assert [(r["g0"], r["last_hit"], r["hits"], r["n_hits"]) for r in hits] == [(0, 5, [1, 5], 2), (1, 9, [9], 1)]
    assert seen.get == {"hits": 3, "misses": 9}


def test_concat_and_combine(spark):
    a, b = generator.incrementing(spark, (2, 3)), generator.incrementing(spark, (3, 3))
    one = concat([a, b])
    assert one.shape == (5, 3) and one.df.where("d0 = 2 AND d1 = 1").first()["value"] == 1
    over = tiles.tile_agg(concat([a, b], "combine"), (2, 3), "count")
    assert sorted(r["result"] for r in over.collect()) == [3, 12]
    with pytest.raises(ValueError):
        concat([a, b], "other")


def test_range_plan_of_four_dimensions():
    plan = ranges.key_ranges((80, 180, 360, 50), (2, 36, 36, 10), key_limit=2001)
    assert (plan.space, plan.parts, plan.record_dim, plan.step) == ((40, 5, 10, 5), 5, 0, 8)
    assert plan.blocks() == [(2000 * p, 2000 * (p + 1)) for p in range(5)]


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(2, 9), min_size=1, max_size=4), st.data())
def test_ranges_cover_all_keys_once(shape, data):
    tile = [data.draw(st.integers(1, n)) for n in shape]
    blocks = ranges.key_ranges(shape, tile, parts=data.draw(st.integers(1, 5))).blocks()
    assert [a for a, _ in blocks[1:]] == [b for _, b in blocks[:-1]] and blocks[0][0] == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=4), st.integers(1, 60), st.floats(0.01, 1))
def test_ranges_keep_within_the_limit(shape, limit, weight):
    plan = ranges.key_ranges(shape, [1] * len(shape), key_limit=limit, weight=weight)
    blocks = plan.blocks()
    assert all(0 < b - a <= limit for a, b in blocks) and blocks[0][0] == 0 and blocks[-1][1] == math.prod(shape)
    assert [a for a, _ in blocks[1:]] == [b for _, b in blocks[:-1]]


def test_partitions_hold_their_ranges(spark):
    plan = ranges.key_ranges((40, 6), (2, 3), parts=4)
    dealt = ranges.repartitioned(tiles.tile_agg(generator.incrementing(spark, (40, 6)), (2, 3), "count"), plan)
    got = dealt.withColumn("at", F.spark_partition_id()).collect()
    assert all(r["at"] == r["part"] for r in got) and len({r["part"] for r in got}) == 4


def test_dependencies_hold_every_true_one(spark):
    tile, plan = (3, 2), ranges.key_ranges((30, 6), (3, 2), parts=3)
    slabs = ranges.record_slabs(30, parts=7)
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(slabs)], "slab int, low int, high int")
    got = {tuple(r) for r in ranges.dependencies(df, plan, tile).collect()}
    want = set()
    for k, (a, b) in enumerate(slabs):
        for d0, d1 in itertools.product(range(a, b), range(6)):
            n = d0 // 3 * 3 + d1 // 2
            want |= {(k, p) for p, (lo, hi) in enumerate(plan.blocks()) if lo <= n < hi}
    assert got == want


def test_slabs():
    assert ranges.record_slabs(10, parts=3, align=4) == [(0, 4), (4, 8), (8, 10)]
    assert ranges.record_slabs(10, parts=2, low=3, high=8) == [(3, 5), (5, 8)]
    assert ranges.record_slabs(10, low=10) == [] and ranges.record_slabs(0) == []


def test_netcdf_files(spark, tmp_path):
    spark.dataSource.register(netcdf3.NetCDF3)
    dims = ["time", "lat", "lon"]
    for k, n in enumerate((4, 3)):
        generator.write_incrementing(f"{tmp_path}/f{k}.nc", (n, 3, 5), dims)
    (tmp_path / "bad.nc").write_bytes(b"no array")
    raw = (tmp_path / "f0.nc").read_bytes()
    assert raw[:4] == b"CDF\x02" and raw[4:8] == (4).to_bytes(4, "big")
    assert netcdf3.describe(f"{tmp_path}/f0.nc")["windspeed1"] == (4, 3, 5)
    load = lambda **o: spark.read.format("netcdf3").options(variable="windspeed1", ignoreInvalid="true", **o).load(f"file://{tmp_path}")
    got = sorted(map(tuple, load().collect()))
    assert got == [(t, a, b, (t if t < 4 else t - 4) * 15 + a * 5 + b) for t in range(7) for a in range(3) for b in range(5)]
    assert load(multiFileMode="combine").where("time = 0").count() == 30
    assert {r["time"] for r in load(records="3,6", numPartitions="3").select("time").distinct().collect()} == {3, 4, 5}
    lat = spark.read.format("netcdf3").option("variable", "lat").load(f"{tmp_path}/f0.nc").collect()
    assert [tuple(r) for r in lat] == [(0, 0.0), (1, 1.0), (2, 2.0)]
    with pytest.raises(Exception, match="not a NetCDF"):
        spark.read.format("netcdf3").option("variable", "windspeed1").load(f"file://{tmp_path}").count()
    with pytest.raises(Exception, match="no variable"):
        spark.read.format("netcdf3").option("variable", "other").load(f"{tmp_path}/f0.nc").count()
    load().where("lat <> 1").coalesce(1).write.format("netcdf3").option("variable", "w").mode("append").save(f"file://{tmp_path}/out")
    back = spark.read.format("netcdf3").options(variable="w", fillAsNull="true").load(f"file://{tmp_path}/out")
    assert back.where("value IS NULL").count() == 7 * 5 and back.where("value IS NOT NULL").exceptAll(load().where("lat <> 1")).count() == 0


def test_two_record_variables(tmp_path):
    data = {"a": (["t", "x"], np.arange(6, dtype="i2").reshape(2, 3), {}), "b": (["t"], np.array([1.5, 2.5]), {"_FillValue": np.array([9.0])})}
    netcdf3.write_file(f"{tmp_path}/two.nc", [("t", 2), ("x", 3)], data, record="t", attributes={"title": "two"})
    head = netcdf3.read_header(f"{tmp_path}/two.nc")
    assert head.record_size == 8 + 8 and head.attributes == {"title": "two"} and head.variable("b").attributes == {"_FillValue": [9.0]}
    for name in data:
        reader = netcdf3.NetCDF3({"path": f"{tmp_path}/two.nc", "variable": name})
        opened = reader.reader(reader.schema())
        rows = [r for p in opened.partitions() for b in opened.read(p) for r in b.to_pylist()]
        assert [r["value"] for r in rows] == data[name][1].ravel().tolist()


def test_early_results(spark, tmp_path):
    shape, tile = (7, 10), (3, 4)
    array = generator.incrementing(spark, shape)
    for r in range(7):
        array.df.where(F.col("d0") == r).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(array.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = {}

    def keep(df, number):
        for r in df.collect():
            batches[(r["g0"], r["g1"])] = batches.get((r["g0"], r["g1"]), []) + [(number, r["result"], r["n_cells"])]

    q = early_medians(stream, array.dims, shape, tile).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {(r["g0"], r["g1"]): (r["result"], r["n_cells"]) for r in tiles.tile_agg(array, tile).collect()}
    assert {k: v[0][1:] for k, v in batches.items()} == want and all(len(v) == 1 for v in batches.values())
    assert max(n for n, *_ in (batches[(0, j)][0] for j in range(3))) < min(n for n, *_ in (batches[(2, j)][0] for j in range(3)))


def test_slabs_inside_tiles_are_refused(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4])], "low int, values array<int>")
    with pytest.raises(Exception, match="begins inside a tile"):
        tiles.merge_median(df, (4, 1), (2, 1), 2).collect()


def test_netcdf_appends_overwrites_and_corners(spark, tmp_path):
    spark.dataSource.register(netcdf3.NetCDF3)
    folder = f"file://{tmp_path}/cells"
    cells = lambda a, b: spark.range(a, b).selectExpr("CAST(id AS INT) AS d0", "CAST(id % 4 + 5 AS INT) AS d1", "CAST(id * 2 AS INT) AS value").coalesce(1)
    save = lambda df, mode: df.write.format("netcdf3").option("variable", "w").mode(mode).save(folder)
    load = lambda: sorted(tuple(r) for r in spark.read.format("netcdf3").options(variable="w", fillAsNull="true").load(folder).where("value IS NOT NULL").collect())
    rows = lambda a, b: [(i, i % 4 + 5, 2 * i) for i in range(a, b)]
    save(cells(16, 32), "append")
    save(cells(0, 16), "append")
    assert load() == rows(0, 32)
    save(cells(40, 44), "overwrite")
    assert load() == rows(40, 44) and not list(tmp_path.glob("cells/_*"))
    part = spark.read.format("netcdf3").options(variable="w", fillAsNull="true", records="41,43").load(folder).where("value IS NOT NULL")
    assert sorted(tuple(r) for r in part.collect()) == rows(41, 43)
    with pytest.raises(Exception, match="2\\*\\*53"):
        save(spark.range(1).selectExpr("CAST(0 AS INT) AS d0", "9007199254740993L AS value").coalesce(1), "append")
    assert load() == rows(40, 44) and not list(tmp_path.glob("cells/_*"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparisons_of_records_reach_the_scan(spark, tmp_path):
    for k in range(3):
        generator.write_incrementing(f"{tmp_path}/f{k}.nc", (10, 3), ["t", "x"])
    scan = lambda **o: netcdf3.scan(spark, f"file://{tmp_path}", variable="windspeed1", numPartitions=5, **o)
    whole = scan()
    assert whole.rdd.getNumPartitions() == 15
    for text, n in (("t >= 3 AND t < 5", 2), ("t = 12", 1), ("t > 27", 1), ("t <= 1", 1), ("t IN (13, 15)", 2), ("t = 3 AND x > 1", 1), ("x = 1", 15), ("t = 7 OR t = 29", 15), ("t <> 4", 15)):
        part = scan().where(text)
        assert part.rdd.getNumPartitions() == n, text
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, spark.createDataFrame(whole.collect()).where(text).collect()))
    assert scan().where("t > 100").count() == scan().where("t = NULL").count() == 0
    assert scan(records="2,9").where("t > 4").agg(F.min("t"), F.max("t")).first()[:] == (5, 8)


def test_several_variables_and_file_names(spark, tmp_path):
    for k, n in enumerate((4, 3)):
        generator.write_incrementing(f"{tmp_path}/f{k}.nc", (n, 3, 5), ["t", "x", "y"], unlimited=k == 0)
    found = netcdf3.scan(spark, f"{tmp_path}", variable="windspeed1,y,t", fileColumn="file")
    assert found.columns == ["t", "x", "y", "windspeed1", "y_value", "t_value", "file"]
    local = lambda t: t if t < 4 else t - 4
    want = [(t, x, y, local(t) * 15 + x * 5 + y, float(y), local(t), f"f{t // 4}.nc") for t in range(7) for x in range(3) for y in range(5)]
    assert sorted((*r[:6], r["file"].rpartition("/")[2]) for r in found.collect()) == want
    assert ranges.by_file(found, 3).withColumn("p", F.spark_partition_id()).groupBy("file").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    for options, message in (({"variable": "y,windspeed1"}, "other dimensions"), ({"variable": "windspeed1", "fileColumn": "X"}, "one name"), ({"variable": " "}, "is needed")):
        with pytest.raises(Exception, match=message):
            netcdf3.scan(spark, f"{tmp_path}", **options).count()


def test_partitions_by_bytes(spark, tmp_path):
    generator.write_incrementing(f"{tmp_path}/a.nc", (10, 3, 5), ["t", "x", "y"])  # 60 bytes a record
    cut = lambda **o: [tuple(r)[2:] for r in netcdf3.describe_partitions(spark, f"{tmp_path}/a.nc", variable="windspeed1", **o).collect()]
    assert cut(maxPartitionBytes="300") == [(0, 5, 0, 75), (5, 10, 5, 75)]
    assert cut(maxPartitionBytes="1") == [(t, t + 1, t, 15) for t in range(10)]
    assert cut(maxPartitionBytes="1", align="4", records="1,9") == [(1, 4, 1, 45), (4, 8, 4, 60), (8, 9, 8, 15)]


@pytest.mark.parametrize("shape,tile", [((7, 10), (3, 4)), ((6, 4, 5), (2, 2, 5)), ((5,), (2,)), ((3, 4), (5, 9))])
def test_aligned_medians_without_a_shuffle(spark, tmp_path, shape, tile):
    dims = [f"d{i}" for i in range(len(shape))]
    generator.write_incrementing(f"{tmp_path}/a.nc", shape, dims)
    slabs = netcdf3.scan(spark, f"{tmp_path}", variable="windspeed1", layout="slabs", align=tile[0], numPartitions=2)
    got = tiles.merge_median(slabs, (tile[0], *shape[1:]), tile, len(shape))
    assert "Exchange" not in plan_of(got)
    want = tiles.tile_agg(netcdf3_cells(spark, tmp_path, dims), tile)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def netcdf3_cells(spark, folder, dims):
    return ArrayFrame.of(netcdf3.scan(spark, f"{folder}", variable="windspeed1"), dims)


def test_slabs_of_files_that_cut_tiles_are_refused(spark, tmp_path):
    for k in range(2):
        generator.write_incrementing(f"{tmp_path}/f{k}.nc", (3, 2), ["t", "x"])
    scan = lambda **o: netcdf3.scan(spark, f"{tmp_path}", variable="windspeed1", layout="slabs", **o)
    assert scan(align=3).count() == 2
    for options, message in (({"align": 2}, "inside a tile"), ({"multiFileMode": "combine"}, "over each other"), ({"fillAsNull": "true"}, "without nulls")):
        with pytest.raises(Exception, match=message):
            scan(**options).count()


def test_tiles_of_boxes(spark):
    rows = [(0, 2, 7, 0, 1), (1, -3, 1, 4, 9), (2, 5, 5, 0, 3), (3, None, 4, 0, 1)]
    boxes = spark.createDataFrame(rows, "id int, a int, b int, c int, d int")
    want = {}
    for k, a, b, c, d in rows[:3]:
        for x, y in itertools.product(range(a, b), range(c, d)):
            want[(k, x // 3, y // 4)] = want.get((k, x // 3, y // 4), 0) + 1
        if a < b:
            first, n = shapes.tiles_of_box((a, c), (b - a, d - c), (3, 4))
            assert {g[1:] for g in want if g[0] == k} == set(itertools.product(*(range(f, f + m) for f, m in zip(first, n))))
    got = ranges.tiles_of_boxes(boxes, ["a", "c"], ["b", "d"], (3, 4)).collect()
    assert {(r["id"], r["g0"], r["g1"]): r["n_cells"] for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError, match="these names"):
        ranges.tiles_of_boxes(boxes.withColumn("G0", F.lit(1)), ["a"], ["b"], (3,))


def test_text_lines(spark):
    df = spark.createDataFrame([(0, 1, 5, "a.nc"), (2, 3, None, None)], "g0 int, g1 int, result int, file string")
    lines = [r["value"] for r in text.text_lines(df, (2, 36), "w", file=F.col("file")).collect()]
    assert lines == ["a.nc@w@[0, 1],[2, 36]\tvalues = 5", "@w@[2, 3],[2, 36]\tvalues = null"]
