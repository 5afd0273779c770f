"""A folder watched as a stream: texts that arrive are planned and translated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.functions.text import ends_normalised
from docweave.sources.scan import plan_items


def inbox(spark: SparkSession, folder: str, *, per_batch: int = 1000) -> DataFrame:
    """(source_path, text, arrived) of files as they arrive, each once."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(per_batch)).load(folder)
    return files.select(F.col("_metadata.file_path").alias("source_path"), ends_normalised(F.col("value")).alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def planned(stream: DataFrame, fallback: str) -> DataFrame:
    return plan_items(stream, fallback)


def directions_by_window(stream: DataFrame, fallback: str, *, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, resolved_direction, n): arrivals by event time; what comes later than
    ``late`` is left out."""
    return planned(stream, fallback).withWatermark("arrived", late).groupBy(F.window("arrived", width), "resolved_direction").agg(F.count(F.lit(1)).alias("n"))


def run_inbox(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every batch to ``handle`` with its number; the checkpoint folder keeps which
    files are done, so a restart goes on where it stopped."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
