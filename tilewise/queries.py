"""The array queries over the driver's tables: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import coords, sketches, states, tiles
from .operators.model import ArrayFrame, concat
from .plans import ranges
from .session import importable, new_path
from .sources import netcdf3
from .sources.text import write_text
from .streaming.early import early_medians, scan_stream

TILE = (100, 2)
#: Extents of the views; coordinates beyond them make no whole tile.
WIDE = (1 << 20, 64)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """Sparse, with repeated cells: (order, line) -> quantity."""
    df = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d0"), (F.col("l_linenumber") - 1).alias("d1"), F.col("l_quantity").alias("value"))
    return ArrayFrame.of(df, ["d0", "d1"])


def priced(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """Sparse: (part, line) -> extended price."""
    df = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("d0"), (F.col("l_linenumber") - 1).alias("d1"), F.col("l_extendedprice").alias("value"))
    return ArrayFrame.of(df, ["d0", "d1"])


def embeddings(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """Dense: (vector, component) -> float."""
    df = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("d0"), F.posexplode("embedding").alias("d1", "value"))
    return ArrayFrame.of(df, ["d0", "d1"])


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate variable: part -> retail price."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("coord"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LINEITEM = "SELECT (l_orderkey // 100)::INT AS g0, ((l_linenumber - 1) // 2)::INT AS g1"
_COUNTED = "count(*) AS n_cells, count(*) >= 200 AS is_complete FROM lineitem GROUP BY ALL"


def _plain(op: str, result: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = tiles.tile_agg(lineitem(spark, sf_dir), TILE, op)
        return out.withColumn("result", F.round("result", 4)) if op == "average" else out

    run.__name__ = f"tiled_{op}"
    query(f"{_LINEITEM}, {result} AS result, {_COUNTED}")(run)


_UPPER = "list_sort(list(l_quantity))[count(*)::INT // 2 + 1]"
_plain("median", _UPPER)
_plain("simplemedian", _UPPER)
_plain("supersimplemedian", _UPPER)
_plain("average", "round(avg(l_quantity), 4)")
_plain("average_int", "trunc(avg(l_quantity))::INT")
_plain("max", "max(l_quantity)")
_plain("simplemax", "max(l_quantity)")
_plain("min", "min(l_quantity)")
_plain("sum", "sum(l_quantity)")
_plain("count", "count(l_quantity)")
_plain("nulltest", "count(*) FILTER (l_quantity IS NULL)")
_plain("count_distinct", "count(DISTINCT l_quantity)")


@query(f"{_LINEITEM}, round(stddev_pop(l_quantity), 4) AS result, {_COUNTED}")
def tiled_stddev(spark, sf_dir):
    return tiles.tile_agg(lineitem(spark, sf_dir), TILE, "stddev").withColumn("result", F.round("result", 4))


@query(f"{_LINEITEM}, to_json(list_sort(list(l_quantity::INT))) AS result, {_COUNTED}")
def tiled_values(spark, sf_dir):
    out = tiles.tile_agg(lineitem(spark, sf_dir), TILE, "values")
    return out.withColumn("result", F.to_json(F.col("result").cast("array<int>")))


@query("SELECT l_orderkey AS d0, l_linenumber - 1 AS d1, l_quantity AS value FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 900")
def identity_of_records(spark, sf_dir):
    return lineitem(spark, sf_dir).records(100, 900).cells()


@query("SELECT l_orderkey AS d0, l_linenumber - 1 AS d1 FROM lineitem WHERE l_quantity IS NULL OR l_quantity = 50")
def null_and_fill_cells(spark, sf_dir):
    return lineitem(spark, sf_dir).null_cells(fill=50.0)


@query(f"{_LINEITEM}, {_UPPER} AS result, count(*) AS n_cells, count(*) >= 200 AS is_complete FROM lineitem WHERE l_orderkey >= 250 AND l_orderkey < 3050 GROUP BY ALL")
def median_of_records(spark, sf_dir):
    return tiles.tile_agg(lineitem(spark, sf_dir).records(250, 3050), TILE)


@query(f"{_LINEITEM}, to_json(list_sort(list(l_quantity::INT))) AS hits, count(*) AS n_hits FROM lineitem WHERE l_quantity > 45 AND l_quantity < 49 GROUP BY ALL")
def value_filter(spark, sf_dir):
    found = tiles.value_filter(lineitem(spark, sf_dir), TILE, gt=45, lt=49)
    return found.withColumn("hits", F.to_json(F.col("hits").cast("array<int>")))


_COORD = "FROM lineitem JOIN part ON l_partkey = p_partkey"
_KEYS = "(l_partkey // 50)::INT AS g0, ((l_linenumber - 1) // 4)::INT AS g1"


@query(f"SELECT l_partkey AS d0, l_linenumber - 1 AS d1, l_extendedprice AS value {_COORD} WHERE p_retailprice::FLOAT = 910.1::FLOAT")
def coordinate_equal(spark, sf_dir):
    return coords.coordinate_filter(priced(spark, sf_dir), prices(spark, sf_dir), "d0", eq=910.1).cells()


@query(f"SELECT {_KEYS}, round(avg(l_extendedprice), 4) AS result, count(*) AS n_cells, count(*) >= 200 AS is_complete {_COORD} WHERE p_retailprice::FLOAT > 905::FLOAT AND p_retailprice::FLOAT < 960.5::FLOAT GROUP BY ALL")
def coordinate_range_average(spark, sf_dir):
    found = coords.coordinate_filter(priced(spark, sf_dir), prices(spark, sf_dir), "d0", gt=905, lt=960.5)
    return tiles.tile_agg(found, (50, 4), "average").withColumn("result", F.round("result", 4))


@query(f"""SELECT {_KEYS}, max(struct_pack(at := l_partkey * 64 + l_linenumber - 1, v := l_extendedprice)).v AS last_hit, count(*) AS n_hits
{_COORD} WHERE p_retailprice::FLOAT > 905::FLOAT GROUP BY ALL""")
def coordinate_last_hit(spark, sf_dir):
    found = coords.coordinate_filter(priced(spark, sf_dir), prices(spark, sf_dir), "d0", gt=905)
    return coords.hits_by_tile(found, (50, 4), WIDE).drop("hits")


@query(f"""SELECT {_KEYS}, to_json(list_transform(list_sort(list(struct_pack(at := l_partkey * 64 + l_linenumber - 1, v := l_extendedprice))), lambda x: round(x.v * 100)::BIGINT)) AS hits
{_COORD} WHERE p_retailprice::FLOAT > 905::FLOAT AND p_retailprice::FLOAT < 960.5::FLOAT GROUP BY ALL""")
def coordinate_all_hits(spark, sf_dir):
    found = coords.coordinate_filter(priced(spark, sf_dir), prices(spark, sf_dir), "d0", gt=905, lt=960.5)
    hits = coords.hits_by_tile(found, (50, 4), WIDE).drop("last_hit", "n_hits")
    return hits.withColumn("hits", F.to_json(F.transform("hits", lambda x: F.round(x * 100).cast("long"))))


@query("""SELECT (l_partkey // 50)::INT AS g0, count(*) FILTER (p_retailprice::FLOAT > 950::FLOAT) AS hits,
count(*) FILTER (p_retailprice IS NULL OR p_retailprice::FLOAT <= 950::FLOAT) AS misses FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def hit_and_miss_counts(spark, sf_dir):
    array = priced(spark, sf_dir)
    hit = F.coalesce(coords.predicate(F.col("coord"), gt=950), F.lit(False))
    seen = coords.joined(array, prices(spark, sf_dir), "d0").withColumn("hit", hit)
    return seen.groupBy(F.expr("d0 div 50").cast("int").alias("g0")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("""SELECT (vec_id // 8)::INT AS g0, (i // 10)::INT AS g1, list_sort(list(v))[count(*)::INT // 2 + 1]::DOUBLE AS result, count(*) AS n_cells, count(*) >= 80 AS is_complete
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL""")
def dense_tiles_with_edges(spark, sf_dir):
    return tiles.tile_agg(embeddings(spark, sf_dir), (8, 10))


def _halves(spark, sf_dir):
    """The vectors as two files, the first half and the rest."""
    whole = embeddings(spark, sf_dir)
    n = _vectors(spark, sf_dir)
    low = ArrayFrame.of(whole.records(0, n // 2).df, whole.dims, shape=(n // 2, 64))
    high = ArrayFrame.of(whole.records(n // 2, n).df.withColumn("d0", F.col("d0") - n // 2), whole.dims, shape=(n - n // 2, 64))
    return [low, high]


def _vectors(spark, sf_dir) -> int:
    return (_read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


_CELLS = """(SELECT vec_id, v, i, h, (vec_id >= h)::INT AS file, vec_id - CASE WHEN vec_id >= h THEN h ELSE 0 END AS r FROM
(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), (SELECT (max(vec_id) + 1) // 2 AS h FROM embeddings))"""


@query(f"SELECT (vec_id // 100)::INT AS g0, (i // 16)::INT AS g1, max(v) AS result, count(*) AS n_cells, count(*) >= 1600 AS is_complete FROM {_CELLS} GROUP BY ALL")
def files_one_after_another(spark, sf_dir):
    return tiles.tile_agg(concat(_halves(spark, sf_dir)), (100, 16), "max")


@query(f"SELECT (r // 100)::INT AS g0, (i // 16)::INT AS g1, max(v) AS result, count(*) AS n_cells, count(*) >= 1600 AS is_complete FROM {_CELLS} GROUP BY ALL")
def files_over_each_other(spark, sf_dir):
    return tiles.tile_agg(concat(_halves(spark, sf_dir), "combine"), (100, 16), "max")


@query(f"SELECT file, (r // 100)::INT AS g0, (i // 16)::INT AS g1, min(v) AS result, count(*) AS n_cells, count(*) >= 1600 AS is_complete FROM {_CELLS} GROUP BY ALL")
def tiles_by_file(spark, sf_dir):
    return tiles.tile_agg(concat(_halves(spark, sf_dir), "combine", "file"), (100, 16), "min", by=["file"])


_PLAN = "(SELECT n // 2 AS slices, (n // 2 + 3) // 4 AS step FROM (SELECT max(vec_id) + 1 AS n FROM embeddings))"
_PART = "least((vec_id // 2) // step, (slices + step - 1) // step - 1)::INT"


@query(f"""SELECT part, count(*) AS n_keys, min(g0) AS first_g0, max(g0) AS last_g0 FROM (
SELECT DISTINCT (vec_id // 2)::INT AS g0, (i // 16)::INT AS g1, {_PART} AS part
FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), {_PLAN}) GROUP BY part""")
def range_partitions(spark, sf_dir):
    plan = ranges.key_ranges((_vectors(spark, sf_dir), 64), (2, 16), parts=4)
    keyed = ranges.with_partition(tiles.tile_agg(embeddings(spark, sf_dir), (2, 16), "count"), plan)
    return keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n_keys"), F.min("g0").alias("first_g0"), F.max("g0").alias("last_g0"))


@query(f"SELECT DISTINCT (vec_id // 40)::INT AS slab, {_PART} AS part FROM embeddings, {_PLAN}")
def slab_dependencies(spark, sf_dir):
    slabs = _read(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 40").cast("int").alias("slab")).agg(F.min("vec_id").alias("low"), (F.max("vec_id") + 1).alias("high"))
    return ranges.dependencies(slabs, ranges.key_ranges((_vectors(spark, sf_dir), 64), (2, 16), parts=4), (2, 16))


@query("""SELECT coalesce(g0, -1) AS g0, coalesce(g1, -1) AS g1, result, n_cells FROM (SELECT (l_orderkey // 100)::INT AS g0, ((l_linenumber - 1) // 2)::INT AS g1,
round(avg(l_quantity), 4) AS result, count(*) AS n_cells FROM lineitem GROUP BY ROLLUP (g0, g1))""")
def tiles_of_every_level(spark, sf_dir):
    out = tiles.rollup(lineitem(spark, sf_dir), TILE)
    return out.select(*(F.coalesce(g, F.lit(-1)).alias(g) for g in ("g0", "g1")), F.round("result", 4).alias("result"), "n_cells")


@query("""SELECT s AS start, i AS d1, round(avg(v), 5) AS result, count(*) AS n_cells FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) c,
generate_series(0, 4) AS o(k), (SELECT 1), LATERAL (SELECT (vec_id - k)::INT AS s) WHERE s >= 0 GROUP BY ALL""")
def sliding_average(spark, sf_dir):
    array = embeddings(spark, sf_dir)
    array = ArrayFrame.of(array.df.withColumn("value", F.col("value").cast("double")), array.dims)
    out = tiles.sliding(array, 5)
    return out.select("start", F.col("d1").cast("long").alias("d1"), F.round("result", 5).alias("result"), "n_cells")


@query("""SELECT o_orderkey AS order_key, g0::INT AS g0, g1::INT AS g1, (least(o_orderkey + 250, (g0 + 1) * 100) - greatest(o_orderkey, g0 * 100)) * (least(b, (g1 + 1) * 3) - greatest(a, g1 * 3)) AS n_cells
FROM (SELECT o_orderkey, o_custkey % 5 AS a, o_custkey % 5 + 4 AS b FROM orders),
LATERAL (SELECT unnest(generate_series(o_orderkey // 100, (o_orderkey + 249) // 100)) AS g0), LATERAL (SELECT unnest(generate_series(a // 3, (b - 1) // 3)) AS g1)""")
def tiles_of_boxes(spark, sf_dir):
    """A box of 250 by 4 cells at every order."""
    order = F.col("o_orderkey")
    boxes = _read(spark, sf_dir, "orders").select(order.alias("order_key"), (order + 250).alias("end"), (F.col("o_custkey") % 5).alias("a"), (F.col("o_custkey") % 5 + 4).alias("b"))
    return ranges.tiles_of_boxes(boxes, ["order_key", "a"], ["end", "b"], (100, 3)).drop("end", "a", "b")


#: Bytes of a NetCDF-3 file of the queries, about.
FILE_BYTES = 32 << 20


def _save(df: DataFrame, **options) -> str:
    """`df` as NetCDF-3 files, one for each partition; returns their folder."""
    folder = new_path(df.sparkSession, "netcdf")
    df.sparkSession.dataSource.register(netcdf3.NetCDF3)
    df.write.format("netcdf3").options(**options).mode("append").save(folder)
    return folder


def _in_files(df: DataFrame, first: str, n: int, files: int) -> DataFrame:
    """Partition p holds the p-th of about `files` equal ranges of the first dimension, of multiples of 8."""
    step = max(1, -(-n // files // 8)) * 8
    return df.withColumn("part", F.expr(f"cast(`{first}` div {step} AS int)")).repartitionById(-(-n // step), F.col("part")).drop("part")


def _embedding_files(spark: SparkSession, sf_dir: str) -> str:
    """The embeddings as NetCDF-3 files of equal ranges of vectors, four at least; returns their folder."""
    array, n = embeddings(spark, sf_dir), _vectors(spark, sf_dir)
    dealt = _in_files(array.df, "d0", n, max(4, -(-n * 64 * 4 // FILE_BYTES)))
    return _save(dealt.sortWithinPartitions("d0", "d1"), variable="embedding", shape=64)


@query("""SELECT (vec_id // 8)::INT AS g0, (i // 16)::INT AS g1, list_sort(list(v))[count(*)::INT // 2 + 1] AS result, count(*) AS n_cells, count(*) >= 128 AS is_complete
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL""")
def aligned_median_without_shuffle(spark, sf_dir):
    """From a scan of slabs of 8 records: whole tiles lie in one row each, and nothing is dealt."""
    slabs = netcdf3.scan(spark, _embedding_files(spark, sf_dir), variable="embedding", layout="slabs", align=8)
    return tiles.merge_median(slabs, (8, 64), (8, 16), 2)


@query("SELECT vec_id::INT AS d0, i::INT AS d1, v AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE vec_id >= 130 AND vec_id < 310")
def netcdf_records(spark, sf_dir):
    """Only these records are read: the comparison reaches the scan."""
    cells = netcdf3.scan(spark, _embedding_files(spark, sf_dir), variable="embedding")
    return ArrayFrame.of(cells, ["d0", "d1"]).records(130, 310).cells()


@query("""SELECT d0, count(*) AS n_cells, round(sum(v), 3) AS embedding, any_value(norm) AS norm FROM (SELECT vec_id::INT AS d0, unnest(embedding)::DOUBLE AS v, (vec_id * 3)::INT AS norm FROM embeddings) GROUP BY d0""")
def netcdf_two_variables(spark, sf_dir):
    """An array and a coordinate variable of its first dimension as columns of one scan."""
    array, n = embeddings(spark, sf_dir), _vectors(spark, sf_dir)
    cells = array.df.select("d0", "d1", F.col("value").alias("embedding"), (F.col("d0") * 3).alias("norm"), F.col("d0").alias("id"))
    dealt = _in_files(cells, "d0", n, max(4, -(-n * 64 * 4 // FILE_BYTES))).sortWithinPartitions("d0", "d1")
    folder = _save(dealt, variable="embedding", recordVariable="norm,id", shape=64)
    cells = netcdf3.scan(spark, folder, variable="embedding,norm,id")
    return cells.groupBy(F.col("id").alias("d0")).agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum(F.col("embedding").cast("double")), 3).alias("embedding"), F.max("norm").alias("norm"))


@query("""SELECT '@l_quantity@[' || l_orderkey // 100 || ', ' || (l_linenumber - 1) // 2 || '],[100, 2]' || chr(9) || 'values = ' || count(*) AS value FROM lineitem GROUP BY l_orderkey // 100, (l_linenumber - 1) // 2""")
def tiles_as_text(spark, sf_dir):
    folder = new_path(spark, "text")
    write_text(tiles.tile_agg(lineitem(spark, sf_dir), TILE, "count"), folder, TILE, "l_quantity")
    return spark.read.text(folder)


@query("""SELECT (vec_id // 8)::INT AS g0, (i // 10)::INT AS g1, list_sort(list(v))[count(*)::INT // 2 + 1]::DOUBLE AS result, count(*) AS n_cells
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL""")
def early_tile_medians(spark, sf_dir):
    """The cells as a stream of files; each tile's median is emitted when its last cell has come."""
    array, n, folder = embeddings(spark, sf_dir), _vectors(spark, sf_dir), new_path(spark, "stream")
    array.df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(array.df.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/in")
    return _streamed(early_medians(stream, array.dims, (n, 64), (8, 10)), folder)


def _streamed(df: DataFrame, folder: str) -> DataFrame:
    """What a stream has emitted from all that has come; run again with the same folder, it goes on behind its checkpoint."""
    out = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


@query("""SELECT (vec_id // 8)::INT AS g0, (i // 16)::INT AS g1, list_sort(list(v))[count(*)::INT // 2 + 1]::DOUBLE AS result, count(*) AS n_cells
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL""")
def early_medians_of_arriving_files(spark, sf_dir):
    """NetCDF-3 files that arrive in two lots, read as a stream without a copy; the second run goes on from the first one's checkpoint."""
    folder, n, files = new_path(spark, "stream"), _vectors(spark, sf_dir), _embedding_files(spark, sf_dir)
    come = netcdf3.find_files(files)
    for lot in filter(None, (come[: len(come) // 2], come[len(come) // 2 :])):
        for file in lot:
            netcdf3.move_file(file, f"{folder}/in/{file.rpartition('/')[2]}")
        cells = scan_stream(spark, f"{folder}/in", variable="embedding")
        found = _streamed(early_medians(cells, ["d0", "d1"], (n, 64), (8, 16)), folder)
    return found


@query("SELECT vec_id::INT AS d0, (i)::INT AS d1, v AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def netcdf_round_trip(spark, sf_dir):
    """Cells written as NetCDF-3 files, a range of records in each, and read back. A file's own corner is its first record."""
    return spark.read.format("netcdf3").option("variable", "embedding").option("align", 8).load(_embedding_files(spark, sf_dir))


def _long_records(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The embeddings the other way round, a record for each of the 64 components; returns the folder and the length of a record."""
    n = _vectors(spark, sf_dir)
    turned = embeddings(spark, sf_dir).df.select(F.col("d1").alias("d0"), F.col("d0").alias("d1"), "value")
    return _save(_in_files(turned, "d0", 64, 2).sortWithinPartitions("d0", "d1"), variable="embedding", shape=n), n


@query("""SELECT (i // 16)::INT AS g0, (vec_id // 100)::INT AS g1, max(v) AS result, count(*) AS n_cells, count(*) >= 1600 AS is_complete
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL""")
def slabs_inside_records(spark, sf_dir):
    """Few long records: partitions and what a task holds are parts of one."""
    folder, n = _long_records(spark, sf_dir)
    cells = netcdf3.scan(spark, folder, variable="embedding", maxPartitionBytes=min(FILE_BYTES, max(1024, 2 * n)), openCostBytes=0)
    return tiles.tile_agg(ArrayFrame.of(cells, ["d0", "d1"]), (16, 100), "max")


_BOXED = """SELECT (vec_id // 12)::INT AS g0, (i // 10)::INT AS g1, {result} AS result, count(*) AS n_cells, count(*) >= 120 AS is_complete
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL"""


def _mixed(op: str, result: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        boxes = netcdf3.scan(spark, _embedding_files(spark, sf_dir), variable="embedding", layout="boxes", maxPartitionBytes=1 << 20)
        out = states.mixed_agg(boxes, (_vectors(spark, sf_dir), 64), (12, 10), op)
        return out.withColumn("result", F.round("result", 5)) if op == "average" else out

    run.__name__ = f"mixed_plan_{op}"
    query(_BOXED.format(result=result))(run)


_mixed("median", "list_sort(list(v))[count(*)::INT // 2 + 1]")
_mixed("average", "round(avg(v::DOUBLE), 5)")
_mixed("max", "max(v)")


@query("""SELECT (vec_id // 8)::INT AS g0, (i // 16)::INT AS g1, round(avg(v::DOUBLE), 5) AS average, count(*)::INT AS n_cells FROM
(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL""")
def tile_averages_through_the_sink(spark, sf_dir):
    """Tiles dealt by ranges of keys, each range written as a file of two variables while its rows arrive, and read back."""
    n = _vectors(spark, sf_dir)
    found = tiles.tile_agg(embeddings(spark, sf_dir), (8, 16), "average").select("g0", "g1", F.round("result", 5).alias("average"), F.col("n_cells").cast("int").alias("n_cells"))
    plan = ranges.key_ranges((-(-n // 8), 4), (1, 1), parts=max(4, -(-n // 8 * 4 * 12 // FILE_BYTES)))
    folder = _save(ranges.repartitioned(found, plan).drop("part"), variable="average,n_cells", shape=4)
    return netcdf3.scan(spark, folder, variable="average,n_cells")


class Mode(states.Operator):
    """The most frequent value, of equally frequent ones the smallest: an operator of a user's own. Its state is two arrays, the distinct values in
    order and how often each is there."""

    def types(self, kind):
        return f"array<struct<v:{kind},n:bigint>>", kind

    def init(self):
        return np.zeros(0, np.int8), np.zeros(0, np.int64)

    def add(self, state, values):
        own = np.unique(values, return_counts=True)
        return self.merge(state, own) if len(state[0]) else own

    def add_runs(self, values, ends):
        if values.dtype == object:
            return super().add_runs(values, ends)
        run = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        order = np.lexsort((values, run))
        v, run = values[order], run[order]
        same = (v[1:] == v[:-1]) | ((v[1:] != v[1:]) & (v[:-1] != v[:-1]))  # NaN is one value
        heads = np.flatnonzero(np.concatenate([[True], ~same | (run[1:] != run[:-1])]))
        v, n, cuts = v[heads], np.diff(heads, append=len(v)), np.searchsorted(heads, ends).tolist()
        return [(v[a:b], n[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]

    def merge(self, one, other):
        return self.merge_all([one, other])

    def merge_all(self, some):
        if len(some) == 1:
            return some[0]
        v, at = np.unique(np.concatenate([v for v, _ in some if len(v)]), return_inverse=True)
        n = np.zeros(len(v), np.int64)
        np.add.at(n, at, np.concatenate([n for v, n in some if len(v)]))
        return v, n

    def final(self, state):
        v, n = state
        first = v[n.argmax()]  # of the largest the first, which is the smallest value
        return first.item() if hasattr(first, "item") else first

    def pack(self, some, kind):
        ends = np.cumsum([0, *(len(v) for v, _ in some)])
        v = np.concatenate([v for v, _ in some if len(v)] or [np.zeros(0)])
        n = np.concatenate([n for _, n in some])
        v = pa.array(v, kind.value_type.field("v").type)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([v, pa.array(n, pa.int64())], fields=list(kind.value_type)))

    def unpack(self, column):
        ends, flat = column.offsets.to_numpy(), column.values
        v, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        return [(v[a:b], n[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@query("""SELECT g0, g1, v AS result, t::BIGINT AS n_cells, t >= 200 AS is_complete FROM (
SELECT g0, g1, v, sum(n) OVER (PARTITION BY g0, g1) AS t, row_number() OVER (PARTITION BY g0, g1 ORDER BY n DESC, v) AS r FROM (
SELECT (l_orderkey // 100)::INT AS g0, ((l_linenumber - 1) // 2)::INT AS g1, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1""")
def tiled_mode(spark, sf_dir):
    return states.state_agg(lineitem(spark, sf_dir), TILE, Mode())


@query("""SELECT vec_id::INT AS d0, i::INT AS d1, v AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
WHERE (vec_id * 3)::FLOAT > 300::FLOAT AND (vec_id * 3)::FLOAT < 960.5::FLOAT""")
def coordinate_range_of_files(spark, sf_dir):
    """Each file's own coordinate variable says which of its records are read."""
    array, n = embeddings(spark, sf_dir), _vectors(spark, sf_dir)
    cells = array.df.withColumn("norm", F.col("d0") * 3)
    dealt = _in_files(cells, "d0", n, max(4, -(-n * 64 * 4 // FILE_BYTES))).sortWithinPartitions("d0", "d1")
    folder = _save(dealt, variable="value", recordVariable="norm", shape=64)
    return netcdf3.scan(spark, folder, variable="value", coordinate="norm", coordinateGt=300, coordinateLt=960.5)


@query(f"SELECT (vec_id // 100)::INT AS g0, (i // 16)::INT AS g1, min(v) AS result, count(*) AS n_cells, count(*) >= 1600 AS is_complete FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def many_small_files(spark, sf_dir):
    """A hundred files, several to a partition."""
    array, n = embeddings(spark, sf_dir), _vectors(spark, sf_dir)
    folder = _save(_in_files(array.df, "d0", n, 100).sortWithinPartitions("d0", "d1"), variable="embedding", shape=64)
    return tiles.tile_agg(ArrayFrame.of(netcdf3.scan(spark, folder, variable="embedding"), ["d0", "d1"]), (100, 16), "min")


@query(f"""{_LINEITEM}, {_UPPER} AS result, count(*) AS n_cells, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct,
count(DISTINCT (l_orderkey, l_linenumber)) >= 200 AS is_complete FROM lineitem GROUP BY ALL""")
def median_of_tiles_without_holes(spark, sf_dir):
    """Completeness from bitmaps of the cells seen: repeated cells don't make up for missing ones."""
    return tiles.tile_agg(lineitem(spark, sf_dir), TILE, exact=True)


@query("""SELECT s AS start, i AS d1, max(v) AS result, count(*) AS n_cells FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) c,
generate_series(0, 29) AS o(k), LATERAL (SELECT (vec_id - k)::INT AS s) WHERE s >= 0 GROUP BY ALL""")
def sliding_maximum(spark, sf_dir):
    """Windows of 30 records."""
    out = tiles.sliding(embeddings(spark, sf_dir), 30, "max")
    return out.withColumn("d1", F.col("d1").cast("long"))


@query("""SELECT g0, g1, n AS n_cells, true AS median_within, true AS distinct_within FROM (SELECT (l_orderkey // 400)::INT AS g0, ((l_linenumber - 1) // 4)::INT AS g1, count(*) AS n FROM lineitem GROUP BY ALL)""")
def approximate_tiles(spark, sf_dir):
    """Medians and distinct counts of coarse tiles from the sketches of fine ones, held against the cells: a median's rank is within a
    fiftieth of the cells, a distinct count within an eighth or two."""
    array = lineitem(spark, sf_dir)
    found = sketches.estimates(sketches.coarser(sketches.tile_sketches(array, TILE), (4, 2)))
    keys = ["g0", "g1"]
    cells = array.df.select(*tiles.tile_key(array.dims, (400, 4)), "value").join(found, keys)
    exact = cells.groupBy(*keys).agg(F.first("n_cells").alias("n_cells"), F.count_if(F.col("value") < F.col("q0")).alias("below"), F.count_if(F.col("value") <= F.col("q0")).alias("upto"), F.countDistinct("value").alias("d"), F.first("n_distinct").alias("e"))
    half, room = F.col("n_cells") / 2, F.col("n_cells") / 50 + 1
    return exact.select(*keys, "n_cells", ((F.col("below") <= half + room) & (F.col("upto") >= half - room)).alias("median_within"), (F.abs(F.col("d") - F.col("e")) <= F.greatest(F.col("d") / 8, F.lit(2))).alias("distinct_within"))
