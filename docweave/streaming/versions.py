"""A folder whose files may change, as a stream of their versions.

Spark's file stream takes a path once. Here every trigger lists the folder, subfolder by
subfolder in tasks, and state tells which files are new: one whose time and length are
known is not opened; one that differs is read by the task that holds its state, and handed
on if its bytes differ too. State and offsets lie in the checkpoint folder, so a restart
hands on what changed meanwhile and repeats nothing.

State is kept by buckets of paths: a group of its own for each path would cost some
milliseconds of pandas a file at every trigger, whether the file changed or not.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.functions.session import BATCH_BYTES, BATCH_ROWS, bounded_batches, qualified
from docweave.operators.translate import Policy
from docweave.operators.translators import Translator
from docweave.plans.folder import Report, translate_texts
from docweave.sources.registry import Registry
from docweave.sources.scan import MAX_BYTES, read_texts
from docweave.sources.staged import store as file_store

LISTING = "path string, modified long, length long"
VERSION = "path string, modified timestamp, length long, content binary"
_STATE = "paths array<string>, modified array<long>, lengths array<long>, hashes array<string>"
_ROWS = 1000
#: Groups that share the state; more than any number of tasks, few beside the files of a large folder.
BUCKETS = 4096


class _Part(InputPartition):
    """The files of the folder itself (an empty name), or all below one subfolder."""

    def __init__(self, name: str) -> None:
        self.name = name


def _hidden(path: str) -> bool:
    return "/." in path or "/_" in path


class ListingReader(DataSourceStreamReader):
    """An offset is a time of listing, so each trigger is one listing."""

    def __init__(self, folder: str, recursive: bool) -> None:
        self.folder, self.recursive = folder, recursive

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        if not self.recursive:
            return [_Part("")]
        system, root = file_store(self.folder)
        found = system.get_file_info(pafs.FileSelector(root))
        return [_Part(""), *(_Part(x.base_name) for x in found if x.type == pafs.FileType.Directory and not _hidden(f"/{x.base_name}"))]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, root = file_store(self.folder)
        at = f"{root}/{partition.name}" if partition.name else root
        found = system.get_file_info(pafs.FileSelector(at, recursive=bool(partition.name), allow_not_found=True))
        files = [x for x in found if x.type == pafs.FileType.File and not _hidden(x.path[len(root) :])]
        for first in range(0, len(files), _ROWS):
            some = files[first : first + _ROWS]
            paths = [self.folder + x.path[len(root) :] for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([x.mtime_ns for x in some], pa.int64()), pa.array([x.size for x in some], pa.int64())], ["path", "modified", "length"])


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], self.options.get("recursive", "false") == "true")


def _versions(rows: list[tuple[str, int, int, bytes | None]]) -> pd.DataFrame:
    path, modified, length, content = zip(*rows, strict=True)
    return pd.DataFrame({"path": path, "modified": pd.to_datetime([m // 1000 for m in modified], unit="us", utc=True), "length": length, "content": pd.Series(content, dtype=object)})


def _newer(folder: str, limit: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {p: (m, n, sha) for p, m, n, sha in zip(*state.get, strict=True)} if state.exists else {}
        listed: dict[str, tuple[int, int]] = {}
        for f in frames:
            for path, *now in zip(f["path"].tolist(), f["modified"].tolist(), f["length"].tolist(), strict=True):
                listed[path] = max(listed.get(path, (-1 << 63, 0)), tuple(now))
        (system, root), rows, held, moved = file_store(folder), [], 0, False
        for path, (modified, length) in listed.items():
            last = known.get(path, (None, None, None))
            if last[:2] == (modified, length):
                continue
            body, sha = None, f"{length} bytes"
            if length <= limit:
                try:
                    with system.open_input_stream(root + path[len(folder) :], compression=None) as file:
                        body = file.read()
                except FileNotFoundError:  # gone since the listing
                    continue
                sha = hashlib.sha256(body).hexdigest()
            known[path], moved = (modified, length, sha), True
            if sha != last[2]:
                size = length if body is None else len(body)
                rows.append((path, modified, size, body))
                held += size if body is not None else 0
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _versions(rows)
                rows, held = [], 0
        if moved:
            state.update((list(known), *(list(x) for x in zip(*known.values(), strict=True))))
        if rows:
            yield _versions(rows)

    return run


def file_versions(spark: SparkSession, folder: str, *, recursive: bool = False, limit: int = MAX_BYTES) -> DataFrame:
    """A stream (path, modified, length, content) with a row whenever a file is new or its
    bytes differ from those handed on last. Files of more than ``limit`` bytes are not
    read: they come without content, and again when their length changes. A file that is
    only touched, or is deleted and comes back as it was, is not handed on again. Names
    and subfolders that begin with a dot or an underscore are left out, as Spark's file sources do; an
    empty folder gives no rows. Of several
    changes between two triggers the last is seen. State holds every path ever seen, a row
    a bucket; for very many, set ``spark.sql.streaming.stateStore.providerClass`` to RocksDB's."""
    spark.dataSource.register(FolderListing)
    at = qualified(spark, folder)
    listed = spark.readStream.format(FolderListing.name()).option("path", at).option("recursive", str(recursive).lower()).load()
    bounded_batches(spark)
    kept = listed.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)))
    return kept.groupBy("bucket").applyInPandasWithState(_newer(at, limit), VERSION, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_versions(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Hands each batch that is not empty to ``handle`` with its number, as a table below
    ``checkpoint``, so that files are read and state is moved once however often
    ``handle`` reads it. A batch whose ``handle`` failed is handed on again after a
    restart. Goes through the folder once, or again at each interval ``every``."""

    def batch(rows: DataFrame, number: int) -> None:
        path = f"{checkpoint}/versions/{number}"
        rows.write.mode("overwrite").parquet(path)
        table = rows.sparkSession.read.schema(rows.schema).parquet(path)
        if not table.isEmpty():
            handle(table, number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(**trigger).start()


def translate_changes(spark: SparkSession, folder: str, out: str, make: Callable[[], Translator], policy: Policy, work: str, *, recursive: bool = False, registry: Registry | None = None, max_bytes: int = MAX_BYTES, every: str | None = None, told: Callable[[int, Report], None] | None = None) -> StreamingQuery:
    """Translates the files of ``folder`` into ``out``, another folder, as they come and
    whenever they change, each in the direction of its language. ``work`` keeps the
    stream's place between runs; ``told`` gets each batch's number and report."""

    def handle(files: DataFrame, number: int) -> None:
        texts = read_texts(files, limit=max_bytes, registry=registry)
        if not texts.isEmpty():
            report = translate_texts(texts, out, make, policy, f"{work}/batch-{number}", root=qualified(spark, folder))
            if told is not None:
                told(number, report)

    return run_versions(file_versions(spark, folder, recursive=recursive, limit=max_bytes), handle, work, every=every)
