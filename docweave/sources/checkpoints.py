"""Stored translations of documents, as an append-only table that runs may share.

Rows lie in folders by the first digits of a hash of (path, direction, fingerprint), so
reads of some documents prune the rest. Appending a row that is stored adds nothing, so a
round that is stored twice counts once. A document is cleared by a row that tells when:
what was stored before it no longer counts, and nothing of other documents or runs is
touched. ``compact_checkpoints`` rewrites the table without what no longer counts, by
overwriting folders; it is for times when no run uses the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.session import exists, remove

KEYS = ["source_path", "direction", "fingerprint"]
#: Hexadecimal digits that name a folder of the table.
DIGITS = 1
_SCHEMA = "source_path string, direction string, fingerprint string, seg_id string, translated_text string, written timestamp, shard string"


def _shard() -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *KEYS), 256), 1, DIGITS)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(path)


def _live(stored: DataFrame) -> DataFrame:
    """The latest row of each segment that was stored after its document was cleared."""
    cleared = F.max(F.when(F.col("seg_id").isNull(), F.col("written"))).over(W.partitionBy(*KEYS))
    rows = stored.withColumn("cleared", cleared).where("seg_id is not null and (cleared is null or written > cleared)")
    latest = W.partitionBy(*KEYS, "seg_id").orderBy(F.desc("written"), "translated_text")
    return rows.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n", "cleared")


def read_checkpoints(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Stored translations of the documents in wanted(source_path, direction,
    fingerprint), the latest of each segment; none if there is no table."""
    asked = wanted.select(*KEYS).distinct().withColumn("shard", _shard())
    shards = [r.shard for r in asked.select("shard").distinct().collect()]  # 16 ** DIGITS at most
    stored = _stored(spark, path).where(F.col("shard").isin(shards))
    return _live(stored.join(asked, [*KEYS, "shard"], "left_semi")).drop("shard")


def _append(rows: DataFrame, path: str) -> None:
    named = rows.withColumns({"written": F.current_timestamp(), "shard": _shard()})
    named.repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def write_checkpoints(rows: DataFrame, path: str) -> None:
    """Appends translations(source_path, direction, fingerprint, seg_id, translated_text);
    those that are the latest of their segment already are left out."""
    new = rows.select(*KEYS, "seg_id", "translated_text").where("seg_id is not null")
    if exists(rows.sparkSession, path):
        new = new.join(read_checkpoints(rows.sparkSession, path, rows), [*KEYS, "seg_id", "translated_text"], "left_anti")
    _append(new, path)


def clear_checkpoints(documents: DataFrame, path: str) -> None:
    """Clears documents(source_path, direction, fingerprint); all others stay."""
    if exists(documents.sparkSession, path):
        none = F.lit(None).cast("string")
        _append(documents.select(*KEYS).distinct().select(*KEYS, none.alias("seg_id"), none.alias("translated_text")), path)


def compact_checkpoints(spark: SparkSession, path: str) -> None:
    """Rewrites the table's folders with what counts; a folder without any goes."""
    if not exists(spark, path):
        return
    live = _live(_stored(spark, path))
    shards = {r.shard for r in _stored(spark, path).select("shard").distinct().collect()}
    left = {r.shard for r in live.select("shard").distinct().collect()}
    live.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for shard in shards - left:
        remove(spark, f"{path}/shard={shard}")
