"""What a run leaves on disk while it goes on and when it is done."""

import json
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle

from docweave import queries
from docweave.operators import translate as R
from docweave.operators import translators as T
from docweave.plans.folder import translate_folder
from docweave.plans.reporter import Reporter

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_a_run_keeps_no_texts_but_its_outputs(spark, tmp_path):
    for name in ("in", "out"):
        (tmp_path / name).mkdir()
    for k in range(30):
        (tmp_path / f"in/{k}.md").write_text("\n\n".join(f"文字内容 needle 示例 {k} {i}" for i in range(20)))
    (tmp_path / "in/x.dita").write_text("<topic><p>需要翻译的文字内容</p></topic>")
    (tmp_path / "in/bad.dita").write_text("<topic>")
    seen = []

    def told(at, said):
        seen.append(sum(1 for p in (tmp_path / "work").rglob("notes/*/*") if p.name != "limited"))

    got = translate_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), T.MockTranslator, R.Policy("zh_to_en"), f"file://{tmp_path}/work", batch=2, reporter=Reporter(lambda line: None, told))
    assert got.rollup["files"] == 32 and got.rollup["failed"] == 1 and got.metrics["translated"] == 601
    assert max(seen) == 0  # each round's notes are gone when it is written
    left = {p.relative_to(tmp_path / "work").parts[0] for p in (tmp_path / "work").rglob("*.parquet")}
    assert not left & {"texts", "plan", "markdown-zh_to_en", "dita-zh_to_en"}
    columns = {c for p in (tmp_path / "work").rglob("*.parquet") for c in pq.read_schema(p).names}
    assert not columns & {"text", "translated_text", "blocks", "output", "content"}
    assert got.plan.count() == 32 and {r.stage for r in got.failures.collect()} == {"parse_document"}


def test_notes_are_few_files_and_a_torn_line_is_called_again(tmp_path):
    notes = R.Notes(f"file://{tmp_path}", 3)
    for k in range(500):
        assert notes.done(1, k) is None
        notes.note(1, k, [(f"s{k}", "é\nx", None, None, 0, 0, 0)])
    notes.close()
    files = sorted((tmp_path / "00003").iterdir())
    assert len(files) < 50
    with files[-1].open("a") as file:
        file.write(json.dumps([1, 500, []])[:5])
    again = R.Notes(f"file://{tmp_path}", 3)
    assert [again.done(1, k) == [[f"s{k}", "é\nx", None, None, 0, 0, 0]] for k in (0, 7, 499)] == [True] * 3
    assert again.done(1, 500) is None and again.done(2, 0) is None
    again.note(1, 500, [("t", "x", None, None, 0, 0, 0)])
    again.close()
    third = R.Notes(f"file://{tmp_path}", 3)
    assert third.done(1, 3) and third.done(1, 500) == [["t", "x", None, None, 0, 0, 0]]
    assert R.Notes(f"file://{tmp_path}", 4).done(1, 3) is None


def test_folder_run_equals_sql_on_long_and_empty_texts(spark, tmp_path):
    texts = ["Plain words. " * 60, "", "a & b < c", "x" * 1203]
    pq.write_table(pa.table({"doc_id": pa.array(range(4), pa.int64()), "text": texts, "lang": ["en"] * 4, "source": ["s"] * 4}), tmp_path / "documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    got, want = queries.folder_run(spark, str(tmp_path)), duck.sql(queries.ORACLES["folder_run"])
    assert "wholetext" not in got._jdf.queryExecution().optimizedPlan().toString()  # no listing on the driver
    columns = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))
