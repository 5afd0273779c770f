"""The driver's contract, and every engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from docweave import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in os.listdir(DATA):
        made.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{DATA}/{name}'")
    return made


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    sql = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
