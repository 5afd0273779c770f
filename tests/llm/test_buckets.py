"""The co-bucketed pair against brute force: files, order, digests, lineage, what stays."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docweave.functions.session import shared_folder
from docweave.llm import buckets, queries


def crc(x, n):
    return zlib.crc32(x.encode()) % n


def key_of(row):
    """Sorts rows whose first column is the key: it descends, the rest ascends, nulls first."""
    head = (0, 0) if row[0] is None else (1, -row[0])
    return head, tuple((0, b"") if x is None else (1, x.encode() if isinstance(x, str) else x) for x in row[1:])


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(tables, numbers, n, salt):
    """{(table, bucket): (rows in order, starting numbers, joined, stayed)}"""
    sales = {r[0] for r in tables["sales"]}
    out, rows, starts = {}, defaultdict(list), defaultdict(list)
    for name, table in tables.items():
        for r in table:
            b = n + 1 if r[0] is None else n if name != "sales" and r[0] not in sales else crc(f"{salt}{r[0]}", n)
            rows[name, b].append((r, numbers[name](r)))
            starts[name, numbers[name](r)].append(b)
    per = {name: Counter(r[0] for r in table if r[0] is not None) for name, table in tables.items()}
    for (name, b), found in rows.items():
        keys = {r[0] for r, _ in found if r[0] is not None}
        joined = sum(per["sales"][k] * per["sale_lines"][k] for k in keys)
        lineage = Counter(s for _, s in found)
        stayed = len(lineage) == 1 and len(starts[name, next(iter(lineage))]) == len(found)
        out[name, b] = (sorted((r for r, _ in found), key=key_of), lineage, joined, stayed)
    return out


def check(report, folder, tables, numbers, n, salt, columns):
    expected = brute(tables, numbers, n, salt)
    assert sorted((r.table_name, r.bucket) for r in report) == sorted(expected)
    for r in report:
        rows, lineage, joined, stayed = expected[r.table_name, r.bucket]
        file = pq.read_table(r.path.removeprefix("file:"))
        assert file.column_names == columns[r.table_name] == r.columns.split(",")
        assert [tuple(x.values()) for x in file.to_pylist()] == rows
        assert (r.n_rows, r.n_joined, r.rewritten) == (len(rows), joined, not stayed)
        assert r.ids_sha256 == sha(",".join("" if x[0] is None else str(x[0]) for x in rows))
        assert r.lineage_sha256 == sha(",".join(f"{s}:{k}" for s, k in sorted(lineage.items())))
    for name in tables:
        there = {f for f in os.listdir(f"{folder}/{name}") if not f.endswith(".crc")} if os.path.isdir(f"{folder}/{name}") else set()
        assert there == {os.path.basename(r.path) for r in report if r.table_name == name}


SALES, LINES = "sale_id long, there string, bucket string, start int", "sale_id long, item_id long, number string"


def both(spark, sales, lines, n, salt, name):
    folder = f"{shared_folder(spark)}/{name}"
    b = F.coalesce(buckets.crc_bucket(F.col("sale_id"), salt, n), F.lit(n + 1))
    left = buckets.Side("sales", spark.createDataFrame(sales, SALES), F.when(b % 5 == 1, b - 1).otherwise(b), n + 2)
    right = buckets.Side("sale_lines", spark.createDataFrame(lines, LINES), F.coalesce(buckets.crc_bucket(F.col("item_id"), "", n), F.lit(0)), n)
    report = buckets.co_bucket(left, right, folder, key="sale_id", buckets=n, salt=salt).collect()

    def at(r):
        b = n + 1 if r[0] is None else crc(f"{salt}{r[0]}", n)
        return b - 1 if b % 5 == 1 else b

    numbers = {"sales": at, "sale_lines": lambda r: 0 if r[1] is None else crc(str(r[1]), n)}
    check(report, folder.removeprefix("file://"), {"sales": sales, "sale_lines": lines}, numbers, n, salt, {"sales": ["sale_id", "there", "bucket", "start"], "sale_lines": ["sale_id", "item_id", "number"]})
    return report


def test_pair(spark):
    sales = [(i, f"t{i % 3}", "é" * (i % 4), i % 2) for i in range(0, 120, 2)] + [(None, None, "x", 1), (None, None, None, None), (8, "t2", "", 0), (8, "t2", "", 0), (10, None, "z" * 20_000, 3)]
    lines = [(i % 130, i % 17, f"n{i % 5}") for i in range(400)] + [(8, 3, "hot")] * 900 + [(None, 2, None), (None, None, ""), (4, None, "y"), (4, None, "y")]
    report = both(spark, sales, lines, 11, "pair", "pair")
    assert {r.rewritten for r in report} == {True, False}


def test_files_that_stay(spark):
    """Every number: a file that holds a bucket's rows stays whatever its own number."""
    n = 6
    ids = [next(i for i in range(1000) if crc(f"s{i}", n) == b) for b in range(n)]
    items = [next(i for i in range(1000) if crc(str(i), n) == b) for b in range(n)]
    # bucket 0 of sales is empty, so bucket 1 starts in file 0; lines of bucket b start in file b + 1
    sales = [(ids[b], "a", "b", b) for b in range(1, n)]
    lines = [(ids[b], items[(b + 1) % n], "c") for b in range(1, n)] * 3 + [(ids[0], items[1], "orphan")]
    report = both(spark, sales, lines, n, "s", "stay")
    assert not any(r.rewritten for r in report)
    assert {(r.table_name, r.bucket) for r in report} >= {("sale_lines", n), ("sales", 1)}


def test_empty_tables(spark):
    assert both(spark, [], [], 3, "", "none") == []
    only = both(spark, [], [(1, 1, "a"), (None, 2, "b")], 3, "", "no-sales")
    assert [(r.table_name, r.bucket) for r in only] == [("sale_lines", 3), ("sale_lines", 4)]
    assert [r.table_name for r in both(spark, [(1, "a", "b", 0)], [], 3, "", "no-lines")] == ["sales"]


def test_surrogates(spark):
    for parts in (1, 7, 152):
        keys = buckets.surrogates(spark, parts)
        rows = spark.createDataFrame([(k,) for k in keys], "k int").repartition(parts, "k").select("k", F.spark_partition_id().alias("p")).collect()
        assert sorted((r.p, r.k) for r in rows) == list(enumerate(keys))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    report = queries.op12_co_buckets(spark, sf).collect()
    tables = {name: [tuple(r.values()) for r in pq.read_table(f"{sf}/{name}.parquet").to_pylist()] for name in ("sales", "sale_lines")}

    def at(r):
        b = 151 if r[0] is None else crc(f"pair{r[0]}", 150)
        return b - 1 if b % 5 == 1 else b

    numbers = {"sales": at, "sale_lines": lambda r: 0 if r[2] is None else crc(str(r[2]), 150)}
    folder = os.path.dirname(os.path.dirname(report[0].path.removeprefix("file:")))
    check(report, folder, tables, numbers, 150, "pair", {name: pq.read_schema(f"{sf}/{name}.parquet").names for name in tables})
