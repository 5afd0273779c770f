"""The folder that the driver and all executors share, and bounds on Arrow batches."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_FALLBACK: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in local tests, a folder of this
    process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _FALLBACK.append(tempfile.mkdtemp(prefix="docweave-"))
    return "file://" + _FALLBACK[0]


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of what has been run. It does so when the driver collects
    the garbage that held them, which one with memory to spare seldom does: a run of many steps would
    keep them all on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def files_in(spark: SparkSession, path: str) -> list[str]:
    """The full paths of the files in a folder, none if there is no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in system.listStatus(at) if x.isFile()] if system.exists(at) else []


def file_count(spark: SparkSession, path: str) -> int:
    """How many files lie below a folder, hidden ones too. They are counted a folder at a time."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getFileCount()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the Python process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def close() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, path)

    atexit.register(close)
    return path


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Within, what is run reads many small files a task: Spark else counts each as 4 MB, and a
    folder of documents becomes a task for every 32 of them."""
    key, cost = "spark.sql.files.openCostInBytes", 64 << 10
    before = spark.conf.get(key)
    if _bytes(before) > cost:
        spark.conf.set(key, str(cost))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_path(path: str) -> str:
    return os.path.normpath(path.removeprefix("file://").removeprefix("file:"))


#: Rows and bytes of a batch of documents: parsed, one takes many times its bytes in a worker.
BATCH_ROWS, BATCH_BYTES = 200, 2 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lowers the session's bounds on Arrow batches, which hold whole texts, to so many
    rows and bytes; one longer text is a batch of its own."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not 0 < _bytes(now) <= bound:
            spark.conf.set(key, str(bound))


def _bytes(text: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.strip().lower().removesuffix("b") or "0"
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
