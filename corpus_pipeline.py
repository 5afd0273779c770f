"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import toxicity as toxic
from docweave.llm._shared import Tables
from docweave.llm.decontaminate import decontaminate
from docweave.llm.mixing import mixed
from docweave.llm.near_dups import deduplicate
from docweave.llm.shards import assign_shards

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay."""
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic.clean(docs, model, threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as the mix takes it."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return assign_shards(docs, SHARDS, keep=True)


SHARDS = 24
STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL cannot express the trained, iterative stages; tests hold the ids that each stage keeps to
#: brute force or plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = tables.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            tables.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
