"""Scanning, planning, configuration, checkpoints, sinks and the inbox."""

import json

import pytest
from pyspark.sql import functions as F

from docweave.sources import config as C
from docweave.sources import checkpoints as K
from docweave.sources import outputs as O
from docweave.sources.sink import write_documents
from docweave.sources import scan as S
from docweave.sources.registry import Registry, default_registry
from docweave.streaming.inbox import directions_by_window, inbox, planned, run_inbox


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"B.md": "这是一个中文文档示例\r\nx", "a.md": "plain english text with words enough", "a_en.md": "x", "z_en.md": "y", "n.txt": "t", "bad.md": b"\xff\xfe", "sub/c.dita": "<p>x</p>"}.items():
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    return tmp_path


def test_scan_and_generated(spark, folder):
    flat = S.scan(spark, str(folder))
    assert [r.n for r in S.in_order(flat.where("supported")).select(S.file_name(F.col("path")).alias("n")).collect()] == ["a.md", "a_en.md", "B.md", "bad.md", "z_en.md"]
    assert S.scan(spark, str(folder), recursive=True).where("document_type = 'dita'").count() == 1
    assert [r.n for r in S.generated(flat).select(S.file_name(F.col("path")).alias("n")).collect()] == ["a_en.md"]
    with pytest.raises(S.PlanError):
        S.checked_plan(flat.where("path like '%.txt'"))


def test_read_and_plan(spark, folder):
    docs, failures = S.read_documents(spark, str(folder), limit=40)
    assert {r.text for r in docs.collect()} >= {"这是一个中文文档示例\nx"}
    assert failures.where("message = 'not UTF-8'").count() == 1
    plan = {S_name(r.source_path): r.resolved_direction for r in S.plan_items(docs, "en_to_zh").collect()}
    assert plan["B.md"] == "zh_to_en" and plan["z_en.md"] == "en_to_zh"
    _, big = S.read_documents(spark, str(folder), limit=3)
    assert big.where("message like 'larger%'").count() == 2


def S_name(path):
    return path.rsplit("/", 1)[-1]


def test_registry():
    made = default_registry()
    assert made.extensions() == [".dita", ".md"] and "*.md" in made.file_filter()
    with pytest.raises(ValueError):
        made.register("other", ("MD",), "x")
    made.register("other", ("MD ", "txt", ".txt"), "x", replace=True)
    assert made.extensions() == [".dita", ".md", ".txt"] and made.unregister("other").display_name == "x"
    with pytest.raises(ValueError):
        Registry().register("e", (" ",), "")


def test_settings_precedence(tmp_path):
    (tmp_path / "settings.json").write_text(json.dumps({"llm": {"model": "a", "timeout": 30, "batch_size": 999}, "markdown": {"front_matter_translatable_fields": ["Title", " "]}}))
    C.edit_env_file(tmp_path / ".env", {"DOCWEAVE_MODEL": "b c", "DOCWEAVE_API_KEY": "k"})
    found = C.load_settings(tmp_path, {"DOCWEAVE_API_KEY": "env"})
    assert (found.model, found.api_key, found.timeout, found.batch_size, found.front_matter_fields) == ("b c", "env", 30, 8, ("title",))
    assert found.missing() == ["base_url"]
    C.edit_env_file(tmp_path / ".env", {"DOCWEAVE_MODEL": "d"})
    assert C.read_env_file(tmp_path / ".env") == {"DOCWEAVE_MODEL": "d", "DOCWEAVE_API_KEY": "k"}
    with pytest.raises(ValueError):
        C.field_list(" , ")


def test_glossary(spark, tmp_path):
    at = tmp_path / "g.json"
    assert C.load_glossary(at) == []
    C.save_glossary(at, [{"source": " a ", "target": "b"}])
    assert C.load_glossary(at) == [{"source": "a", "target": "b"}]
    assert [tuple(r) for r in C.glossary_table(spark, str(at)).collect()] == [("a", "b")]
    at.write_text('[{"source": "a"}]')
    with pytest.raises(ValueError, match="item 0"):
        C.load_glossary(at)


def test_input_checks(tmp_path):
    (tmp_path / "a.md").write_text("x")
    good = C.check_input([f" {tmp_path}/a.md ", f"{tmp_path}/a.md"], "")
    assert good.valid and good.filled_output and len(good.paths) == 1
    assert len(C.check_input([str(tmp_path / "no.md"), str(tmp_path)], "/nowhere").errors) == 3
    assert C.check_input([str(tmp_path)], str(tmp_path), folder=True).valid


CHECKPOINT = "source_path string, direction string, fingerprint string, seg_id string, translated_text string"


def stored(spark, at, rows):
    asked = spark.createDataFrame([(p, "zh_to_en", f) for p, f in rows], "source_path string, direction string, fingerprint string")
    return sorted((r.source_path, r.seg_id, r.translated_text) for r in K.read_checkpoints(spark, at, asked).collect())


def test_checkpoints(spark, tmp_path):
    at = str(tmp_path / "c")
    rows = lambda *found: spark.createDataFrame([(p, "zh_to_en", f"f{p}", s, t) for p, s, t in found], CHECKPOINT)
    both = [("p", "fp"), ("q", "fq")]
    assert stored(spark, at, both) == []
    K.write_checkpoints(rows(("p", "s", "old"), ("q", "s", "x"), ("p", "t", "y")), at)
    K.write_checkpoints(rows(("p", "s", "new"), ("q", "s", "x")), at)  # the second one is stored already
    assert spark.read.parquet(at).count() == 4
    assert stored(spark, at, both) == [("p", "s", "new"), ("p", "t", "y"), ("q", "s", "x")]
    assert stored(spark, at, [("p", "other")]) == []
    K.clear_checkpoints(rows(("p", "", "")), at)
    assert stored(spark, at, both) == [("q", "s", "x")]
    K.write_checkpoints(rows(("p", "s", "new")), at)  # again, after it was cleared
    assert stored(spark, at, both) == [("p", "s", "new"), ("q", "s", "x")]
    K.compact_checkpoints(spark, at)
    assert stored(spark, at, both) == [("p", "s", "new"), ("q", "s", "x")] and spark.read.parquet(at).count() == 2
    K.clear_checkpoints(rows(("p", "", ""), ("q", "", "")), at)
    K.compact_checkpoints(spark, at)
    assert stored(spark, at, both) == [] and not list((tmp_path / "c").glob("shard=*"))


SINK = "source_path string, file_name string, output string"


def test_sink(spark, tmp_path):
    (tmp_path / "dir.md").mkdir()
    (tmp_path / "file").write_text("x")
    (tmp_path / "old.md").write_text("old")
    given = [(f"file:{tmp_path}/a.md", "a_en.md", "é\n"), (f"{tmp_path}/b.md", "b.md", "x"), ("s", "dir.md", "x"), ("s", "file/below.md", "x"), ("s", "sub/deep/c.md", ""), ("s", "old.md", "new"), ("s", "null.md", None), ("x/2", "same.md", "two"), ("x/1", "same.md", "one")]
    got = {(r.source_path, r.file_name): r for r in write_documents(spark.createDataFrame(given, SINK), str(tmp_path)).collect()}
    assert len(got) == len(given)
    errors = {k[1]: v.error for k, v in got.items() if v.error}
    assert set(errors) == {"b.md", "dir.md", "file/below.md", "null.md", "same.md"} and all(x.startswith("write_output: ") for x in errors.values())
    assert "replace its source" in errors["b.md"] and "a folder" in errors["dir.md"] and got["x/2", "same.md"].error and not got["x/1", "same.md"].error
    there = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert there == {"a_en.md": "é\n", "file": "x", "sub/deep/c.md": "", "old.md": "new", "same.md": "one"}
    assert got[f"file:{tmp_path}/a.md", "a_en.md"].bytes_written == 3 and got["s", "sub/deep/c.md"].output_path == f"{tmp_path}/sub/deep/c.md"
    missing = write_documents(spark.createDataFrame(given, SINK), f"{tmp_path}/nowhere").collect()
    assert len(missing) == len(given) and all("does not exist" in r.error for r in missing) and not (tmp_path / "nowhere").exists()


def test_a_sink_that_fails_publishes_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("string").alias("source_path"), F.concat("id", F.lit(".md")).alias("file_name"), F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise("x").alias("output")).repartition(4)
    with pytest.raises(Exception, match="stop"):
        write_documents(rows, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_output_name_refuses_unknown_directions(spark):
    name = lambda way: spark.range(1).select(O.output_name(F.lit("/x/a.b.md"), F.lit(way)).alias("n")).first().n
    assert name("en_to_zh") == "a.b_zh.md"
    with pytest.raises(Exception, match="unknown direction"):
        name("x")


def test_inbox(spark, folder, tmp_path_factory):
    work, seen = tmp_path_factory.mktemp("stream"), []
    stream = planned(inbox(spark, f"{folder}/[aB]*.md"), "zh_to_en")
    for _ in range(2):
        run_inbox(stream, lambda df, n: seen.extend(df.select("resolved_direction").collect()), str(work)).awaitTermination()
    assert len(seen) == 3
    assert directions_by_window(inbox(spark, str(folder)), "zh_to_en").isStreaming
