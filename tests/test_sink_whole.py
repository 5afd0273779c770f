"""The sink and sink_commit on rows that a plain corpus does not have, and when a store fails."""

import errno
import types

import duckdb
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest

from docweave import queries
from docweave.sources import sink, staged
from docweave.sources.sink import read_back, write_documents

LONG = 10**12
ROWS = [(0, "zero"), (1, ""), (2, None), (3, "taken"), (7, "a folder"), (12, ""), (-8, "negative"), (-13, ""), (LONG + 1, "one"), (LONG + 4, "two"), (LONG + 5, "é"), (40, "twice"), (40, "twice")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in ROWS], pa.int64()), "text": [r[1] for r in ROWS], "lang": ["en" for _ in ROWS], "source": ["s" for _ in ROWS]}), made / "documents.parquet")
    return str(made)


def test_sink_commit_equals_sql_on_odd_rows(spark, folder):
    """Empty and null texts, negative ids, ids of more than 12 digits, and a row that comes twice."""
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    got, want = queries.sink_commit(spark, folder), duck.sql(queries.ORACLES["sink_commit"])
    columns = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_sink_commit_lists_no_files_on_the_driver(spark, folder):
    plan = queries.sink_commit(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "Join" not in plan


def test_files_are_read_back_where_they_lie(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x/a.md", "one"), ("b", "b.md", ""), ("c", "c.md", "gone"), ("d", "d.md", None)], "source_path string, file_name string, output string")
    report = write_documents(rows, str(tmp_path))
    (tmp_path / "c.md").unlink()
    (tmp_path / "x/a.md").write_text("changed")
    got = {r.file_name: r.sha256 for r in read_back(report, str(tmp_path)).collect()}
    sha = lambda text: __import__("hashlib").sha256(text).hexdigest()
    assert got == {"x/a.md": sha(b"changed"), "b.md": sha(b""), "c.md": None, "d.md": None}


def test_contents_are_read_back_in_bounded_batches(spark, tmp_path):
    texts = {f"{k}.md": chr(97 + k) * size for k, size in enumerate((10, 3 << 20, 5, 0, 1 << 20, 1 << 20, 7))}
    rows = spark.createDataFrame([(k, k, v) for k, v in texts.items()], "source_path string, file_name string, output string")
    report = write_documents(rows, str(tmp_path)).coalesce(1)
    assert {r.file_name: bytes(r.content).decode() for r in read_back(report, str(tmp_path), whole=True).collect()} == texts


def test_an_empty_table_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "source_path string, file_name string, output string")
    assert write_documents(rows, str(tmp_path)).count() == 0 and list(tmp_path.iterdir()) == []


class Moved(pafs.LocalFileSystem):
    """Another attempt moves each file just before."""

    def move(self, a, b):
        super().move(a, b)
        super().move(a, b)


def test_a_move_that_another_attempt_made_is_done(tmp_path):
    (tmp_path / "staged").write_text("text")
    assert sink._move(Moved(), f"{tmp_path}/staged", f"{tmp_path}/p/a.md", 4, set()) is None
    (tmp_path / "staged").write_text("text")
    assert "write_output: " in sink._move(Moved(), f"{tmp_path}/staged", f"{tmp_path}/p/b.md", 5, set())
    assert (tmp_path / "p/a.md").read_text() == "text"


class Full(pafs.LocalFileSystem):
    def open_output_stream(self, path, **more):
        if "/files/" in path:
            raise OSError(errno.ENOSPC, "No space left on device")
        return super().open_output_stream(path, **more)


def test_a_full_disk_fails_the_job_and_is_no_row(tmp_path, monkeypatch):
    task = types.SimpleNamespace(get=lambda: types.SimpleNamespace(taskAttemptId=lambda: 5, partitionId=lambda: 0))
    for module in (sink, staged):
        monkeypatch.setattr(module, "TaskContext", task)
    monkeypatch.setattr(sink, "store", lambda folder: (Full(), folder))
    (tmp_path / "files").mkdir()
    batch = pa.RecordBatch.from_pydict({"source_path": ["s"], "file_name": ["a.md"], "output": [b"text"], "error": pa.array([None], pa.string())})
    with pytest.raises(OSError, match="No space left"):
        sink.DocumentWriter(str(tmp_path)).write(iter([batch]))
