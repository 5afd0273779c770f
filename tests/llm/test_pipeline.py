"""The pipeline's stages, and the registered queries against SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import oracles, queries
from docweave.llm.decontaminate import contamination
from docweave.llm.near_dups import near_duplicates

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in os.listdir(DATA):
        made.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{DATA}/{name}'")
    return made


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, sql = queries.QUERIES[name](spark, DATA), duck.sql(oracles.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), sql.columns)


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == documents.columns, name
    assert 0 < docs.count() < documents.count()
    assert docs.count() == docs.select("doc_id").distinct().count()
    found = near_duplicates(docs)
    assert found.where("not kept").isEmpty()
    assert contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").isEmpty()


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    gaps = out.groupBy("shard").agg((F.max("slot") + 1 - F.count("slot")).alias("g")).where("g <> 0")
    assert gaps.isEmpty() and out.groupBy("doc_id").count().where("count > 2").isEmpty()
