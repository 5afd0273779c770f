"""Tables in the folder that the driver and all executors share.

An operator that needs a result twice, or iterates, writes it as Parquet below
``spark.checkpoint.dir`` and reads it again: lineage is cut there, and a lost
executor costs no more than the tasks it ran. Where the setting is missing, as
in local tests, a folder of this process is used.
"""

from __future__ import annotations

import atexit
import pickle
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from docweave.functions.session import bounded_batches, remove, shared_folder

#: Rows and bytes in an Arrow batch; its texts lie in a worker's memory twice.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    bounded_batches(spark, BATCH_ROWS, BATCH_BYTES)


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``df.mapInArrow`` whose workers give their memory back when a task ends; Spark keeps
    them for later tasks, whose executors count what they hold."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Shipped:
    """A broadcast object whose classes travel with it, so that executors need no
    copy of this package. ``get`` keeps nothing in the worker but what it returns."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        small_batches(spark)
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        value = pickle.loads(self.bytes.value)
        if hasattr(self.bytes, "_value"):
            del self.bytes._value
        return value


class Tables:
    """Tables of one run of an operator. ``drop`` deletes one that nothing reads
    any more; the rest goes when the Python process ends, as the lazy result of
    the operator may still read it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def keep(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")

    def _close(self) -> None:
        context = self.spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            remove(self.spark, self.root)
