"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows that go to a Python worker at once, where the session doesn't say: texts and arrays are large rows.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers started from now on import this package from where the driver has it. A cluster whose machines
    don't share that folder gets the package by --py-files, as usual. Sets `BATCH` where it is unset."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}")
        found = _own[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
