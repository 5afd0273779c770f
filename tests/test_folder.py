"""Whole runs over folders and lists of files."""

import re
import sys

import pytest
from pyspark import cloudpickle

from docweave.operators import translate as R
from docweave.operators import translators as T
from docweave.plans.folder import translate_files, translate_folder
from docweave.plans.reporter import LogFile, Reporter
from docweave.sources.scan import PlanError

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ZH = "# 标题\n\n这是一个中文文档示例，见 `code` 与 docs/a.md。\n"
EN = "# Heading\n\nPlain words here.\n\nMore of them.\n\nThat is it.\n"
DITA = "<topic id='d'><title>标题示例文档</title><body><p>请查看以下内容</p><codeblock>plain english words that would be counted as english text here</codeblock></body></topic>"


class Counted(T.MockTranslator):
    """Writes down what it is sent; fails on a word until a file is there."""

    def __init__(self, at):
        self.at = at

    def translate(self, items, direction, glossary):
        import os
        import uuid

        if any("BOOM" in t for _, t in items) and not os.path.exists(f"{self.at}/mended"):
            raise T.TranslatorError("broken")
        with open(f"{self.at}/{uuid.uuid4().hex}.sent", "w") as file:
            file.write("\n".join(i for i, _ in items))
        return super().translate(items, direction, glossary)


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "in"
    (made / "sub").mkdir(parents=True)
    for name, body in {"a.md": ZH, "a_en.md": "x", "b.md": EN, "c.dita": DITA, "d.dita": "<broken", "e.md": b"\xff\xfe", "f.txt": "t", "sub/g.md": ZH}.items():
        (made / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    (tmp_path / "out").mkdir()
    (tmp_path / "calls").mkdir()
    return tmp_path


def run(spark, folder, name, **more):
    at = str(folder / "calls")
    return translate_folder(spark, str(folder / "in"), str(folder / "out"), lambda: Counted(at), R.Policy("zh_to_en", retries=0), f"file://{folder}/work-{name}", **more)


def names(folder):
    return sorted(p.name for p in (folder / "out").iterdir() if not p.name.startswith("."))


def test_folder(spark, folder):
    lines, steps = [], []
    got = run(spark, folder, "x", reporter=Reporter(lines.append, lambda at, said: steps.append(at)))
    assert names(folder) == ["a_en.md", "b_zh.md", "c_en.dita"]
    assert (folder / "out/a_en.md").read_text() == "# mock\n\nmock，mock `code` mock docs/a.md[MOCK EN] 。\n"
    assert re.search("<title>mock</title>.*<p>mock</p>.*plain english", (folder / "out/c_en.dita").read_text())
    failed = {r.source_path.rsplit("/", 1)[1]: r.stage for r in got.failures.collect()}
    assert failed == {"d.dita": "parse_document", "e.md": "read_source"}
    assert got.counts == {"total": 4, "zh_to_en": 3, "en_to_zh": 1, "fallback": 1, "skipped_generated": 1}
    files = {r.source_path.rsplit("/", 1)[1]: r for r in got.files.collect()}
    assert {k: (v.ok, v.segments, v.batches, v.cached) for k, v in files.items()} == {"a.md": (True, 2, 1, 0), "b.md": (True, 4, 1, 0), "c.dita": (True, 2, 1, 0), "d.dita": (False, 0, 0, 0), "e.md": (False, 0, 0, 0)}
    assert (got.rollup["files"], got.rollup["succeeded"], got.rollup["total_segments"]) == (5, 3, 8) and got.metrics["translated"] == 8
    assert any(x.startswith("[translate] ") for x in lines) and steps[-1] == 100
    assert {r.source_path.rsplit("/", 1)[1]: r.resolved_direction for r in got.plan.collect()}["c.dita"] == "zh_to_en"


def test_recursive(spark, folder):
    """Outputs of subfolders keep their folder, so equal names do not meet."""
    (folder / "in/sub/deep").mkdir()
    (folder / "in/sub/deep/g.md").write_text(EN)
    (folder / "in/sub/a.md").write_text(EN)
    told = {}
    got = run(spark, folder, "r", recursive=True, reporter=Reporter(file=lambda path, why: told.update({path.rsplit("/", 1)[1]: why})))
    assert {str(p.relative_to(folder / "out")) for p in (folder / "out").rglob("*.[dm]*") if ".doc" not in str(p)} == {"a_en.md", "b_zh.md", "c_en.dita", "sub/a_zh.md", "sub/g_en.md", "sub/deep/g_zh.md"}
    assert got.counts["total"] == 7 and got.rollup["succeeded"] == 6 == got.written.where("error is null").count() and got.written.count() == 6
    assert told["e.md"] == "read_source: not UTF-8" and told["b.md"] is None and len(told) == 6


def test_clashes_and_broken_targets(spark, folder):
    """Files of one name from two folders, and a target that is a folder: rows, not a stop."""
    (folder / "in/sub/b.md").write_text(EN)
    (folder / "out/a_en_en.md").mkdir()
    paths = [str(folder / "in" / n) for n in ("a_en.md", "b.md", "sub/b.md")]
    got = translate_files(spark, paths, str(folder / "out"), T.MockTranslator, R.Policy("zh_to_en"), f"file://{folder}/work")
    failed = {r.source_path.rsplit("/in/", 1)[1]: (r.stage, r.message) for r in got.failures.collect()}
    assert failed == {"a_en.md": ("write_output", "write_output: the target is a folder"), "sub/b.md": ("write_output", "write_output: another document has this file name")}
    assert got.rollup["succeeded"] == 1 and got.rollup["failed"] == 2


def test_runs_into_one_folder_keep_their_checkpoints(spark, folder):
    """A run that succeeds leaves what another one has stored."""
    for name in ("a.md", "a_en.md", "b.md", "c.dita", "d.dita", "e.md"):
        (folder / "in" / name).unlink()
    (folder / "in/h.md").write_text("\n\n".join(f"第{i}段文字内容示例" for i in range(9)) + "\n\n最后一段 BOOM 在这里\n")
    assert run(spark, folder, "1", batch=2).rollup["failed"] == 1
    other = folder / "other"
    other.mkdir()
    (other / "i.md").write_text(ZH)
    at = str(folder / "calls")
    assert translate_folder(spark, str(other), str(folder / "out"), lambda: Counted(at), R.Policy("zh_to_en", retries=0), f"file://{folder}/work-2").rollup["succeeded"] == 1
    (folder / "calls/mended").touch()
    third = run(spark, folder, "3", batch=2)
    assert third.failures.isEmpty() and [r.cached for r in third.files.collect()] == [8]


def test_a_broken_run_goes_on(spark, folder):
    for name in ("c.dita", "d.dita", "e.md"):
        (folder / "in" / name).unlink()
    (folder / "in/h.md").write_text("\n\n".join(f"第{i}段文字内容示例" for i in range(9)) + "\n\n最后一段 BOOM 在这里\n")
    first = run(spark, folder, "1", batch=2)
    assert [r.stage for r in first.failures.collect()] == ["translate"] and "h_en.md" not in names(folder)
    for p in (folder / "calls").iterdir():
        p.unlink()
    (folder / "calls/mended").touch()
    second = run(spark, folder, "2", batch=2)
    sent = sorted(x for p in (folder / "calls").glob("*.sent") for x in p.read_text().split("\n"))
    assert sent == ["seg-0008", "seg-0009"] and second.failures.isEmpty() and "h_en.md" in names(folder)
    assert {r.source_path.rsplit("/", 1)[1]: r.cached for r in second.files.collect()} == {"a.md": 2, "b.md": 4, "h.md": 8}
    (folder / "in/h.md").write_text("别的文字内容示例\n")
    assert run(spark, folder, "3").files.agg({"cached": "sum"}).first()[0] == 0


def test_selected_files(spark, folder):
    paths = [str(folder / "in" / n) for n in ("a_en.md", "b.md", "f.txt")]
    got = translate_files(spark, paths, str(folder / "out"), T.MockTranslator, R.Policy("zh_to_en"), f"file://{folder}/work")
    assert names(folder) == ["a_en_en.md", "b_en.md"] and got.counts["zh_to_en"] == 2 and got.counts["fallback"] == 0
    assert [(r.stage, r.message) for r in got.failures.collect()] == [("scan_source", "unknown format")]
    with pytest.raises(PlanError):
        translate_files(spark, [], str(folder), T.MockTranslator, R.Policy("zh_to_en"), str(folder))


def test_nothing_to_do(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(PlanError):
        translate_folder(spark, str(tmp_path), str(tmp_path), T.MockTranslator, R.Policy("zh_to_en"), str(tmp_path / "w"))


def test_log_file(tmp_path):
    one, two = LogFile(str(tmp_path), "a", "20260101_000000"), LogFile(str(tmp_path), "a", "20260101_000000")
    Reporter(one)("read_source", "中")
    Reporter(two, lambda *x: 1 / 0)("start", "x")
    assert one.path.read_text() == "[read_source] 中\n" and two.path.name == "a_20260101_000000_1.log"
