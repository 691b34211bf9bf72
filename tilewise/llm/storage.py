"""Written tables that cut lineage: in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

#: Tables written on the way to what `settled` makes; None outside of it.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What `make` returns, written once. The tables that `make` itself has written, which only that result was read from, are
    removed then: a long job holds what it still needs. `make` must not hand such a table to anything else."""
    own: list[str] = []
    outer = _made.set(own)
    try:
        df = make()
        path = new_path(df.sparkSession, label)
        df.write.parquet(path)
    finally:
        _made.reset(outer)
    for each in own:
        _remove(df.sparkSession, each)
    if _made.get() is not None:
        _made.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """`df`, written once as Parquet to the shared folder and read again, in a folder for each value of the columns `by`. Later
    steps, retries and lost executors read those files and don't run what made them again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    if _made.get() is not None:
        _made.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """At most `most` rows of `df`, which has about `rows`: those with the smallest hashes of `key`. A threshold on the hash
    comes first, so that all partitions together send about twice as many rows to the driver, however many there are."""
    of = 1 << 40
    share = min(of, 2 * most * of // max(1, rows) + 1)
    few = df.where(F.pmod(F.xxhash64(key), F.lit(of)) < share) if share < of else df
    return few.orderBy(F.pmod(F.xxhash64(key), F.lit(of)), key).limit(most)
