"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.session import shared_folder
from docweave.llm.buckets import Side, co_bucket, crc_bucket
from docweave.llm.chat import chat_digest
from docweave.llm.clusters import k_means
from docweave.llm.decontaminate import contamination
from docweave.llm.licenses import license_scan
from docweave.llm.mixing import mix
from docweave.llm.near_dups import near_duplicates
from docweave.llm.quality import quality
from docweave.llm.shards import assign_shards
from docweave.llm.tokens import load_pieces, token_counts
from docweave.llm.topk import top_k
from docweave.llm.toxicity import toxicity
from docweave.llm.warc import page_of, read_archives, write_archives

#: A vocabulary of pieces with scores; its scores are taken as a unigram model's.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A conversation whose texts hold control strings.
CONTROL_CONVERSATION = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match", "longest_start")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), load_pieces(vocabulary))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), 24)


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(rows.unionByName(spark.sql(CONTROL_CONVERSATION)))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(_table(spark, sf_dir, "pages"), folder, least=0)
    found = read_archives(spark, folder).where("gap is null")
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


def op12_co_buckets(spark: SparkSession, sf_dir: str, buckets: int = 150, salt: str = "pair") -> DataFrame:
    sales, lines = _table(spark, sf_dir, "sales"), _table(spark, sf_dir, "sale_lines")
    b = F.coalesce(crc_bucket(F.col("sale_id"), salt, buckets), F.lit(buckets + 1))
    by_sale = Side("sales", sales, F.when(b % 5 == 1, b - 1).otherwise(b), buckets + 2)
    by_item = Side("sale_lines", lines, F.coalesce(crc_bucket(F.col("item_id"), "", buckets), F.lit(0)), buckets)
    return co_bucket(by_sale, by_item, f"{shared_folder(spark)}/co-buckets-{uuid.uuid4().hex}", key="sale_id", buckets=buckets, salt=salt)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k_means(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64)


_ALL = (op1_decontaminate, op2_mix_sources, op3_token_counts, op4_shards, op5_near_dups, op6_toxicity, op7_quality, op8_chat, op9_top_k, op10_licenses, op11_warc, op12_co_buckets, op13_clusters)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
