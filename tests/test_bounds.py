"""What a worker or the driver holds at once, and how often files are touched."""

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.operators import dita
from docweave.operators import segments as G
from docweave.plans.run import prepared
from docweave.sources.sink import write_documents

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture
def wide(spark):
    """The session with wide bounds on batches, as Spark has them."""
    before = [spark.conf.get(k) for k in KEYS]
    for k, v in zip(KEYS, ("10000", "64m"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in zip(KEYS, before, strict=True):
        spark.conf.set(k, v)


def bounds(spark):
    return [int(spark.conf.get(k)) for k in KEYS]


def test_xml_goes_to_workers_in_small_batches(wide):
    docs = wide.range(700).select(F.col("id").alias("doc_id"), F.lit("<topic><p>one</p></topic>").alias("text"))
    ready = prepared(docs, "dita").withColumn("missing", F.lit(0).cast("long"))
    rows, size = bounds(wide)
    assert rows <= 200 and size <= 2 << 20
    done = dita.rebuild_documents(ready)
    assert done.where("output = '<topic><p>one</p></topic>'").count() == 700


def test_sink_works_out_each_output_once_and_tells_of_rows_without_a_name(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(n):
        seen.add(1)
        return None if n == 3 else f"text {n}"

    name = F.when(F.col("id") == 5, F.lit(None)).when(F.col("id") == 7, F.lit("6.md")).otherwise(F.concat(F.col("id").cast("string"), F.lit(".md")))
    rows = spark.range(40).select(F.format_string("s%02d", "id").alias("source_path"), name.alias("file_name"), made("id").alias("output"))
    told = {r.source_path: r for r in write_documents(rows, str(tmp_path)).collect()}
    assert seen.value == 40
    assert len(told) == 40 and {k: r.error for k, r in told.items() if r.error} == {"s03": "write_output: no output", "s05": "write_output: no file name", "s07": "write_output: another document has this file name"}
    assert sorted(p.name for p in tmp_path.glob("*.md")) == sorted(f"{n}.md" for n in range(40) if n not in (3, 5, 7))


def test_markdown_goes_to_workers_in_small_batches(wide):
    done = prepared(wide.range(700).select(F.col("id").alias("doc_id"), F.lit("# one\n\ntwo\n").alias("text")), "markdown")
    rows, size = bounds(wide)
    assert rows <= 200 and size <= 2 << 20
    assert done.where("size(blocks) = 3").count() == 700


def test_long_rows_of_tables_are_whole_when_joined(spark):
    """Also where a row ends in a line break, of any kind, or holds the mark of the cutter."""
    rows = ["| " + body + "<br>" + "z" * 30 + end for body in ("word " * 9, "é😀" * 20, "a<BR />b" * 8, "x\x01" * 20, "@@PROTECT_0001@@" * 3) for end in (" |\n", " |\r\n", "\x85", "\u2028\n", "\n")]
    frame = spark.createDataFrame([(r, 2) for r in rows] + [(r, 1) for r in rows], "t string, n int").withColumn("t", F.repeat("t", F.col("n")))
    for r in frame.select("t", G.chunked(F.lit("table"), F.col("t"), 20).alias("c")).collect():
        assert "".join(r.c) == r.t and all(len(x) <= 20 for x in r.c)


def test_slices_are_cut_in_one_scan(spark):
    text = "é😀\n" * 7
    frame = spark.createDataFrame([(text,), ("",), (None,), ("abcd",)], "t string").select(X.hard_split(F.col("t"), 4).alias("x"))
    assert [r.x for r in frame.collect()] == [[text[i : i + 4] for i in range(0, 21, 4)], [], [], ["abcd"]]
    assert "substr" not in frame._jdf.queryExecution().optimizedPlan().toString().lower()
