"""Tables written to the folder that driver and executors share.

The folder is the one named in ``spark.checkpoint.dir``.  Only where that is unset
(tests, a laptop) a temporary folder of this machine is used and set.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that Spark can open."""
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


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name under the shared one; nothing is made yet."""
    return f"{root(spark)}/termloom-{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Writes within leave no shuffle files behind: Spark deletes them when the query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written rows.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation,
    and values that depend on the partitioning keep what was written.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, tag)
    with cleaned(spark):
        df.write.option("compression", "snappy").parquet(path)  # zstd's buffers outside the heap outlive many small files
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Give memory back to the machine: workers outlive their tasks, and the C heap keeps freed pages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def owned(run: Callable) -> Callable:
    """A batch function whose caches end with its task."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return outer


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _resolved(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if re.match(r"\w+:", path) else "file://" + path)


def open_file(path: str) -> FileSystem:
    """The file system of a path in the shared folder, for tasks that write files of their own."""
    return _resolved(path)[0]


def file_path(path: str) -> str:
    """The path as its file system names it."""
    return _resolved(path)[1]
