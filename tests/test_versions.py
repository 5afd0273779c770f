"""Files that change, as a stream."""

import os
import sys

from pyspark import cloudpickle

from docweave.operators import translate as R
from docweave.operators import translators as T
from docweave.streaming import versions
from docweave.streaming.versions import file_versions, run_versions, translate_changes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ZH = "# 标题\n\n这是一个中文文档示例。\n"


class Capital(T.MockTranslator):
    def translate(self, items, direction, glossary):
        return [(i, f"translated {len(t)}") for i, t in items]


def taken(spark, folder, work, limit=100, fail=False):
    got = []

    def handle(files, number):
        if fail:
            raise ValueError("no")
        got.extend((r.path.rpartition("/")[2], r.length, r.content) for r in files.collect())

    stream = run_versions(file_versions(spark, str(folder), recursive=True, limit=limit), handle, f"file://{work}")
    try:
        stream.awaitTermination()
    except Exception:
        assert fail
    return sorted((n, size, None if c is None else bytes(c)) for n, size, c in got)


def test_versions(spark, tmp_path):
    made = tmp_path / "in"
    (made / "sub" / "deep").mkdir(parents=True)
    (made / ".staging").mkdir()
    for hidden in (".staging/h.md", "_h.md", "sub/deep/.h.md"):
        (made / hidden).write_bytes(b"h")
    (made / "a.md").write_bytes(b"one")
    (made / "sub" / "b.md").write_bytes(b"")
    (made / "sub" / "deep" / "c d%20.md").write_bytes(b"\xff")
    (made / "big.md").write_bytes(b"x" * 101)
    work = tmp_path / "work"
    first = [("a.md", 3, b"one"), ("b.md", 0, b""), ("big.md", 101, None), ("c d%20.md", 1, b"\xff")]
    assert taken(spark, made, work, fail=True) == []  # handed on again after the failure
    assert taken(spark, made, work) == first
    assert taken(spark, made, work) == []
    (made / "a.md").write_bytes(b"two")  # of the same length
    os.utime(made / "sub" / "b.md", ns=(1, 1))  # touched only
    (made / "big.md").write_bytes(b"y" * 102)
    (made / "sub" / "new.md").write_bytes(b"n")
    (made / "sub" / "deep" / "c d%20.md").unlink()
    assert taken(spark, made, work) == [("a.md", 3, b"two"), ("big.md", 102, None), ("new.md", 1, b"n")]
    assert taken(spark, made, work) == []


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert taken(spark, tmp_path / "in", tmp_path / "work") == []


def test_translated_once(spark, tmp_path):
    made, out = tmp_path / "in", tmp_path / "out"
    made.mkdir()
    out.mkdir()
    (made / "a.md").write_text(ZH)
    (made / "b.txt").write_text("not of a known format")
    reports = []

    def go():
        translate_changes(spark, str(made), str(out), Capital, R.Policy("zh_to_en", retries=0), f"file://{tmp_path}/work", told=lambda n, r: reports.append([x.file_name for x in r.written.collect()])).awaitTermination()

    go()
    was = (out / "a_en.md").read_text()
    go()
    assert reports == [["a_en.md"]]
    (made / "a.md").write_text(ZH + "\n再加一句更长的话。\n")
    go()
    assert reports == [["a_en.md"]] * 2
    assert (out / "a_en.md").read_text() != was and (out / "a_en.md").read_text().count("translated") == 3


def test_paths_share_state_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "BUCKETS", 3)
    made = tmp_path / "in"
    made.mkdir()
    for n in range(30):
        (made / f"{n}.md").write_text(f"text {n}")
    taken = []

    def go():
        stream = versions.run_versions(versions.file_versions(spark, str(made)), lambda files, _: taken.append(sorted(int(r.path.rpartition("/")[2][:-3]) for r in files.collect())), f"file://{tmp_path}/work")
        stream.awaitTermination()
        return stream.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert go() <= 3 and taken == [list(range(30))]
    (made / "4.md").write_text("TEXT 4")
    (made / "30.md").write_text("new")
    os.utime(made / "5.md", ns=(1, 1))
    (made / "6.md").unlink()
    assert go() <= 3 and taken[1:] == [[4, 30]]
    (made / "6.md").write_text("text 6")
    assert go() <= 3 and len(taken) == 2
