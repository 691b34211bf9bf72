import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.operators import tiles
from tilewise.operators.model import ArrayFrame
from tilewise.sources import generator, netcdf3
from tilewise.streaming.early import early_medians, scan_stream


def run(df, tmp_path, name="a"):
    """One run over what has come; returns the rows of all runs so far."""
    out = df.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / f"out-{name}"))
    query = out.option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, sorted(map(tuple, df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / f"out-{name}")).collect()), key=str)


def test_files_that_arrive_one_after_another(spark, tmp_path):
    """Each run reads the new files only, after a restart too, and emits the tiles that they complete; all in all the batch query's rows."""
    shape, tile = (21, 6), (4, 4)
    (tmp_path / "in").mkdir()
    whole = np.arange(21 * 6, dtype="i4").reshape(21, 6) % 17
    parts = [(0, 5), (5, 7), (7, 15), (15, 21)]
    seen = []
    for k, (a, b) in enumerate(parts):
        netcdf3.write_file(f"{tmp_path}/in/f{k}.nc", [("t", b - a), ("x", 6)], {"w": (["t", "x"], whole[a:b], {})}, record="t" if k % 2 else None)
        cells = scan_stream(spark, f"file://{tmp_path}/in", variable="w")  # a new query each time, from the checkpoint
        query, found = run(early_medians(cells, ["t", "x"], shape, tile), tmp_path)
        seen.append(len(found))
        assert sum(p["numInputRows"] for p in query.recentProgress) == (b - a) * 6
    want = tiles.tile_agg(ArrayFrame.of(netcdf3.scan(spark, f"file://{tmp_path}/in", variable="w"), ["t", "x"]), tile)
    assert [r[:4] for r in found] == sorted((r["g0"], r["g1"], float(r["result"]), r["n_cells"]) for r in want.collect())
    assert seen == [2, 2, 6, 12]
    _, again = run(early_medians(scan_stream(spark, f"file://{tmp_path}/in", variable="w"), ["t", "x"], shape, tile), tmp_path)
    assert again == found  # nothing new
    netcdf3.write_file(f"{tmp_path}/in/e.nc", [("t", 1), ("x", 6)], {"w": (["t", "x"], whole[:1], {})})
    netcdf3.write_file(f"{tmp_path}/in/g.nc", [("t", 1), ("x", 6)], {"w": (["t", "x"], whole[:1], {})})
    with pytest.raises(Exception, match="in order of their names"):
        run(early_medians(scan_stream(spark, f"file://{tmp_path}/in", variable="w"), ["t", "x"], shape, tile), tmp_path)


def test_nulls_and_nan_as_in_tile_agg(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(a, b, rng.choice([1.5, 2.5, -4.0, None, float("nan")], p=[0.3, 0.2, 0.1, 0.3, 0.1])) for a in range(9) for b in range(6)]
    rows = [(a, b, None if a < 3 and b < 2 else None if v is None else float(v)) for a, b, v in rows]
    df = spark.createDataFrame(rows, "d0 int, d1 int, value double")
    for k in range(3):
        df.where(F.col("d0") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _, found = run(early_medians(stream, ["d0", "d1"], (9, 6), (3, 2)), tmp_path)
    want = tiles.tile_agg(ArrayFrame.of(df, ["d0", "d1"]), (3, 2)).drop("is_complete")
    assert list(map(str, found)) == sorted(map(str, map(tuple, want.collect()))) and (0, 0, None, 6) in found


def written_by_batch(folder):
    """Bytes of the state's change logs by version."""
    out = {}
    for f in folder.rglob("*.changelog"):
        out[int(f.stem.split("_")[0])] = out.get(int(f.stem.split("_")[0]), 0) + f.stat().st_size
    return out


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    """One tile, 12 batches of equal size: the last ones write no more than the first ones."""
    for k in range(12):
        spark.range(4000).selectExpr(f"CAST({k} AS INT) AS d0", "CAST(id AS INT) AS d1", "rand(3) AS value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("d0 int, d1 int, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(early_medians(stream, ["d0", "d1"], (13, 4000), (13, 4000)), tmp_path)
    sizes = written_by_batch(tmp_path / "state-a")
    assert len(sizes) >= 10 and max(sizes.values()) < 1.5 * sorted(sizes.values())[len(sizes) // 2]
    shutil.rmtree(tmp_path / "in")


def test_slabs_of_a_stream(spark, tmp_path):
    """Options of the scan hold for the stream: small partitions inside records, absent cells."""
    generator.write_incrementing(f"{tmp_path}/a.nc", (2, 500), ["t", "x"])
    cells = scan_stream(spark, f"file://{tmp_path}", variable="windspeed1", maxPartitionBytes=1024)
    _, found = run(cells, tmp_path, "b")
    assert found == sorted(((t, x, t * 500 + x) for t in range(2) for x in range(500)), key=str)


def test_neighbouring_tiles_share_a_state(spark, tmp_path):
    """Small tiles that wait for cells are few states, whatever their number; each comes out in the batch that completes it."""
    cells = spark.range(160 * 40).selectExpr("CAST(id div 40 AS INT) AS d0", "CAST(id % 40 AS INT) AS d1", "IF(id % 7 = 0, NULL, id * 31 % 101 / 4) AS value")
    for part in ("d0 % 4 < 2", "d0 % 4 = 3", "d0 % 4 = 2"):
        cells.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query, found = run(early_medians(stream, ["d0", "d1"], (160, 40), (4, 4)), tmp_path)
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    want = tiles.tile_agg(ArrayFrame.of(cells, ["d0", "d1"]), (4, 4)).drop("is_complete")
    assert list(map(str, found)) == sorted(map(str, map(tuple, want.collect()))) and len(found) == 400
    assert 0 < max(states) < 20
