"""Intermediate tables, written to the folder that driver and executors share.

The folder is the one named in ``spark.checkpoint.dir``.  Only where that is unset and Spark runs
on this machine a temporary folder is used.  A written table is computed once however often it
is read, a lost executor costs a re-read, and Spark knows its size in bytes, so that it broadcasts
small ones and shuffles large ones by itself.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Spark deletes a query's shuffle files when the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="termloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Writes within leave no shuffle files behind: what they wrote is read from its own files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(table: DataFrame, name: str) -> DataFrame:
    """The rows of ``table``, read from where they were written once."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/termloom-{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        table.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(table.schema).parquet(path)
