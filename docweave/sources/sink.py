"""The sink of translated documents, in two phases.

First a Python data source writes every output into a staging folder beside the target,
and one commit publishes its manifest: until then a failed job leaves nothing behind, and
of a task that ran twice only the winner's lines count. Outputs are not shuffled: which
document has a name is told from the manifest. Then the manifest's files are
moved to their places by tasks. A move is a rename within one file system; one that is
repeated, or made by two attempts of a task at once, finds its file there. What a target
refuses is a row with its error, whatever the error; the other documents go on. Staged files
have numbers for names, so what fails there, as a full disk does, is no document's fault: it fails
the task, and in the end the job, and is not told as rows.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from docweave.functions.session import BATCH_BYTES, bounded_batches, exists, make_folder, qualified, remove, scratch
from docweave.sources.staged import Moves, StagedWriter, store

MANIFEST = "source_path string, file_name string, staged string, bytes_written long, error string"
REPORT = "source_path string, output_path string, file_name string, bytes_written long, error string"
ERROR = "write_output: "


def _told(error: OSError) -> str:
    return f"{ERROR}{error.strerror or error}"


class DocumentWriter(StagedWriter):
    """Stages rows (source_path, file_name, output, error) as files and lists them in a manifest;
    a row with an error is listed only."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moves:
        system, root = store(self.folder)
        task, moves, n = TaskContext.get(), Moves(), 0
        own = f"files/{task.taskAttemptId()}"
        system.create_dir(f"{root}/{own}", recursive=False)  # none if the job has failed and its folder is gone
        with self.stage(system, root, f"manifest/{task.partitionId():05d}.json", moves) as listed:
            for batch in iterator:
                for source, name, output, refused in zip(*(batch.column(i) for i in range(4)), strict=True):
                    body = output.as_buffer().to_pybytes() if output.is_valid else b""
                    error = f"{ERROR}no file name" if not name.is_valid else refused.as_py() if output.is_valid else f"{ERROR}no output"
                    if error is None:
                        with system.open_output_stream(f"{root}/{own}/{n}", compression=None) as out:
                            out.write(body)
                    listed.write((json.dumps({"source_path": source.as_py(), "file_name": name.as_py(), "staged": f"{own}/{n}", "bytes_written": len(body), "error": error}) + "\n").encode())
                    n += 1
        return moves


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def _place(path: str) -> str:
    """A path without the scheme of local files, for comparing and telling."""
    return posixpath.normpath(path.removeprefix("file://").removeprefix("file:"))


def _move(system: pafs.FileSystem, staged: str, target: str, size: int, made: set[str]) -> str | None:
    try:
        here, there = system.get_file_info([staged, target])
        if there.type == pafs.FileType.Directory:
            return f"{ERROR}the target is a folder"
        if here.type == pafs.FileType.File:
            above = posixpath.dirname(target)
            if above not in made:
                system.create_dir(above, recursive=True)
                made.add(above)
            try:
                system.move(staged, target)
            except FileNotFoundError:  # another attempt of this task has moved it meanwhile
                there = system.get_file_info(target)
                if there.type != pafs.FileType.File or there.size != size:
                    raise
        elif there.type != pafs.FileType.File or there.size != size:
            return f"{ERROR}the staged file is gone"
    except OSError as failed:
        return _told(failed)
    return None


def _published(manifest: DataFrame, folder: str, staging: str) -> DataFrame:
    """Moves the manifest's files to their places, a task some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        made: set[str] = set()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                error = r["error"] or _move(system, f"{root}/{staging}/{r['staged']}", f"{root}/{r['file_name']}", r["bytes_written"], made)
                rows.append((r["source_path"], r["file_name"] and _place(f"{folder}/{r['file_name']}"), r["file_name"], 0 if error else r["bytes_written"], error))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 3 else pa.string()) for i, c in enumerate(columns)], [x.split()[0] for x in REPORT.split(", ")])

    return manifest.mapInArrow(run, REPORT)


def write_documents(outputs: DataFrame, folder: str) -> DataFrame:
    """Writes outputs(source_path, file_name, output), one file a row, below ``folder`` and
    returns a row for each (``REPORT``), after all files are in place.

    ``file_name`` may name subfolders, which are made; ``folder`` itself must exist. Files are
    replaced whole. Rows that are not written say why in ``error``: an output that would
    replace its source, a null output, a file that another document of the table writes
    too (the smallest source path has it), and whatever the file system refuses. If the
    job fails, no output appears. A repeated row writes its file once more. An empty
    table writes nothing."""
    spark = outputs.sparkSession
    folder = qualified(spark, folder)
    rows = outputs.select("source_path", "file_name", F.col("output").cast("binary").alias("output"))
    if not exists(spark, folder):
        return _refused(rows.withColumn("error", F.lit(f"{ERROR}the folder does not exist")), folder)
    plain = lambda x: F.regexp_replace(x, "^file:/+", "/")
    same = plain(F.col("source_path")) == F.concat(F.lit(f"{_place(folder)}/"), "file_name")
    listed = rows.withColumn("error", F.when(same, f"{ERROR}the output would replace its source"))
    staging = f".staging-{uuid.uuid4().hex}"
    spark.dataSource.register(DocumentSink)
    bounded_batches(spark)
    try:
        make_folder(spark, f"{folder}/{staging}/files")
        listed.write.format(DocumentSink.name()).mode("append").save(f"{folder}/{staging}")
        manifest = spark.read.schema(MANIFEST).json(f"{folder}/{staging}/manifest")
        report = scratch(spark, "written")
        _published(_owned(manifest), folder, staging).write.parquet(report)
    finally:
        _clear(spark, f"{folder}/{staging}")
    return spark.read.schema(REPORT).parquet(report)


def _owned(manifest: DataFrame) -> DataFrame:
    """The manifest with an error where another document has the name. Its rows are few bytes, which
    adaptive execution would deal to a task or two; each means a file to move."""
    owner = F.min("source_path").over(W.partitionBy("file_name"))
    taken = F.when(F.col("source_path") > owner, f"{ERROR}another document has this file name")
    dealt = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_name")
    return dealt.withColumn("error", F.coalesce("error", taken))


def _clear(spark: SparkSession, path: str) -> None:
    """Removes a folder; again while a task that was told to stop still writes into it."""
    for wait in (0.0, 0.2, 1.0, 3.0):
        time.sleep(wait)
        remove(spark, path)
        if not exists(spark, path):
            break


def read_back(written: DataFrame, folder: str, *, whole: bool = False) -> DataFrame:
    """The rows of written(file_name, error, ...), as a report on ``folder`` has them, with ``sha256`` of each
    file's bytes as they are in their place, or, if ``whole``, with these as ``content``; null for a row
    with an error, or where the file is gone. The tasks that hold the rows open the files: nothing is
    listed, so the driver holds no names, and empty files, which Spark's file sources pass over, are
    read as any."""
    spark = written.sparkSession
    folder = qualified(spark, folder)
    bounded_batches(spark)

    def one(system: pafs.FileSystem, path: str) -> bytes | str | None:
        try:
            with system.open_input_stream(path, compression=None) as file:
                return file.read() if whole else hashlib.file_digest(file, "sha256").hexdigest()
        except FileNotFoundError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)

        def told(batch: pa.RecordBatch, found: list[bytes | str | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary() if whole else pa.string())], [*batch.schema.names, "content" if whole else "sha256"])

        for batch in batches:
            found, first, held = [], 0, 0
            for n, (name, error) in enumerate(zip(batch.column("file_name").to_pylist(), batch.column("error").to_pylist(), strict=True)):
                found.append(None if error else one(system, f"{root}/{name}"))
                held += len(found[-1] or "")
                if held >= BATCH_BYTES:
                    yield told(batch.slice(first, len(found)), found)
                    found, first, held = [], n + 1, 0
            yield told(batch.slice(first), found)

    kind = T.StructField("content", T.BinaryType()) if whole else T.StructField("sha256", T.StringType())
    return written.mapInArrow(run, T.StructType([*written.schema.fields, kind]))


def _refused(rows: DataFrame, folder: str) -> DataFrame:
    return rows.select("source_path", F.concat(F.lit(f"{_place(folder)}/"), "file_name").alias("output_path"), "file_name", F.lit(0).cast("long").alias("bytes_written"), "error")


def write_markdown(outputs: DataFrame, folder: str) -> DataFrame:
    """:func:`write_documents` of Markdown alone; a row whose source or output is named
    otherwise is not written and says so."""
    named = F.coalesce(F.endswith(F.lower("source_path"), F.lit(".md")) & F.endswith(F.lower("file_name"), F.lit(".md")), F.lit(False))
    wrong = _refused(outputs.where(~named).withColumn("error", F.lit(f"{ERROR}not Markdown")), qualified(outputs.sparkSession, folder))
    return write_documents(outputs.where(named), folder).unionByName(wrong)
