"""A pair of tables in co-located buckets, realised by surrogate partition keys.

Spark deals rows out by ``pmod(murmur3(key), partitions)``, so a bucket number taken by
another hash is no partition number. For every target partition an integer is looked up
once whose murmur3 lands there; ``repartition`` by a bucket's integer then puts each
bucket into the partition of its number, one to one, and a native sort within partitions
and a plain Parquet write give one sorted file a bucket, numbered by its partition.

1. Each table is written as it is dealt at first, one sorted file for each number.
2. Whether a row of the right table has a partner is learnt by a merge join with the
   distinct keys of the left one, whose hot keys AQE may split as the right side repeats
   no key. Nothing but counts by (file, bucket), whose number has a fixed bound, is summed.
3. Files that hold exactly the rows of one bucket stay. The rest is read, dealt by
   surrogate keys, sorted and written beside them.
4. The final files are read back in narrow columns: runs of equal keys with their places
   in the file, dealt to their buckets again, stream through one pass that checks the
   order of the file, digests its keys and counts the bucket's inner-join rows. Only when
   all counts agree are the replaced files deleted.

A bucket's file is written by one task, as one file has to be; the sort spills, and no
group is held in memory. Files appear when Spark commits a write, and a lost executor
costs the tasks it ran.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.session import files_in, remove
from docweave.llm._shared import Tables, map_arrow

#: Keys joined into a digest's text at once.
STEP_KEYS = 1 << 16

REPORT = "table_name string, path string, columns string, bucket long, n_rows long, n_joined long, ids_sha256 string, lineage_sha256 string, rewritten boolean"


@dataclass
class Side:
    """A table, and the number of the file that each row starts in, from 0 to ``files`` - 1."""

    name: str
    frame: DataFrame
    number: Column
    files: int


def crc_bucket(key: Column, salt: str, buckets: int) -> Column:
    """The unsigned CRC-32 of ``salt`` and the key as text, modulo ``buckets``; null for null."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")), F.lit(buckets)).cast("int")


def surrogates(spark: SparkSession, parts: int) -> list[int]:
    """For each partition from 0 to ``parts`` - 1 the least integer that Spark's hash
    partitioning puts there."""
    found: dict[int, int] = {}
    at, step = 0, 16 * parts
    while len(found) < parts:
        number = F.col("id").cast("int")
        rows = spark.range(at, at + step).groupBy(F.pmod(F.hash(number), F.lit(parts)).alias("part")).agg(F.min(number).alias("key")).collect()
        found = {r["part"]: r["key"] for r in rows} | found
        at += step
    return [found[p] for p in range(parts)]


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


class _Writer:
    """Writes and reads the numbered files of a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str, targets: int) -> None:
        self.spark, self.folder, self.key = spark, folder, key
        self.parts = max(targets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.keys = F.array(*(F.lit(k) for k in surrogates(spark, self.parts)))

    def write(self, frame: DataFrame, number: Column, columns: list[str], name: str) -> None:
        """Appends one file for each number, sorted by the key from the largest, then by
        the other columns from the least, nulls first."""
        order = [F.col(_quoted(self.key)).desc_nulls_first(), *(F.col(_quoted(c)).asc_nulls_first() for c in columns if c != self.key)]
        dealt = frame.repartition(self.parts, F.element_at(self.keys, number + 1))
        done = dealt.sortWithinPartitions(*order).select(*(_quoted(c) for c in columns)).write.mode("append")
        done.option("maxRecordsPerFile", 0).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self.folder}/{name}")

    def files(self, name: str) -> set[str]:
        return {p for p in files_in(self.spark, f"{self.folder}/{name}") if p.endswith(".parquet")}

    def read(self, paths: list[str], schema: T.StructType, as_number: str) -> DataFrame:
        """The rows of the files with the number of their file."""
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(as_number, T.IntegerType())]))
        found = self.spark.read.schema(schema).parquet(*paths)
        return found.withColumn(as_number, F.split_part(found.metadataColumn("_metadata")["file_name"], F.lit("-"), F.lit(2)).cast("int"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def file_number(path: str) -> int:
    """The partition that wrote the file."""
    return int(path.rsplit("/", 1)[1].split("-")[1])


def co_bucket(left: Side, right: Side, folder: str, *, key: str, buckets: int, salt: str = "") -> DataFrame:
    """Writes both tables into the new ``folder``, a folder each, first by their own
    numbers, then as buckets of ``key``; returns one row for each final file (``REPORT``).

    A row's bucket is ``crc_bucket(key)``; rows of ``right`` whose key ``left`` does not
    hold are in bucket ``buckets``, rows of either table with a null key in the one after.
    Files are sorted by the key descending, then by the other columns from left to right
    ascending, nulls first; ties are rows alike in all columns, and repeated rows all stay.
    A starting file with exactly a bucket's rows stays; all others are deleted once the
    final files have been read back and their counts agree. ``ids_sha256`` digests the keys
    in file order as text joined by commas, null as empty; ``lineage_sha256`` the counts
    ``number:rows`` of the starting files. A bucket without rows has no file; an empty
    table has no file and no row. All columns must be of orderable types; a column may
    have any name. Texts of any length are rows like others."""
    spark = left.frame.sparkSession
    tables = Tables(spark, "co-bucket")
    writer = _Writer(spark, folder, key, max(buckets + 2, left.files, right.files))
    known = [c for side in (left, right) for c in side.frame.columns]
    start, bucket, there = (_free(x, known) for x in ("start", "bucket", "there"))
    k = F.col(_quoted(key))
    sides, began, dealt = (left, right), {}, {}
    for side in sides:
        writer.write(side.frame, side.number, side.frame.columns, side.name)
        began[side.name] = writer.files(side.name)
    at_first = {s.name: writer.read(sorted(began[s.name]), s.frame.schema, start) for s in sides}
    dealt[left.name] = at_first[left.name].withColumn(bucket, F.coalesce(crc_bucket(k, salt, buckets), F.lit(buckets + 1)))
    ids = tables.keep(at_first[left.name].where(k.isNotNull()).select(_quoted(key)).distinct(), "ids")
    met = at_first[right.name].join(ids.withColumn(there, F.lit(True)).hint("merge"), [key], "left")
    place = F.when(k.isNull(), F.lit(buckets + 1)).when(F.col(there), crc_bucket(k, salt, buckets)).otherwise(F.lit(buckets))
    dealt[right.name] = tables.keep(met.withColumn(bucket, place).select(*(_quoted(c) for c in right.frame.columns), start, bucket), "dealt")
    tables.drop("ids")

    def count(side: Side) -> DataFrame:
        own = dealt[side.name].select(F.lit(side.name).alias("t"), F.col(start).alias("s"), F.col(bucket).alias("b"))
        return own.groupBy("t", "s", "b").agg(F.count(F.lit(1)).alias("n"))

    counts = tables.keep(count(left).unionByName(count(right)), "counts")
    whole = counts.withColumns({"of_s": F.sum("n").over(W.partitionBy("t", "s")), "of_b": F.sum("n").over(W.partitionBy("t", "b"))})
    stays = {(r["t"], r["s"]): r["b"] for r in whole.where("n = of_s and n = of_b").collect()}

    final: dict[str, dict[str, int]] = {}
    for side in sides:
        here = {p: stays[side.name, file_number(p)] for p in began[side.name] if (side.name, file_number(p)) in stays}
        if side is left:
            rest = writer.read(sorted(began[side.name] - set(here)), side.frame.schema, start).withColumn(bucket, F.coalesce(crc_bucket(k, salt, buckets), F.lit(buckets + 1)))
        else:
            rest = dealt[side.name].where(~F.col(bucket).isin(sorted(here.values()))) if here else dealt[side.name]
        writer.write(rest, F.col(bucket), side.frame.columns, side.name)
        final[side.name] = here | {p: file_number(p) for p in writer.files(side.name) - began[side.name]}
    tables.drop("dealt")

    lines = F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws(":", x["s"], x["n"]))
    told = counts.groupBy("t", "b").agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(lines, ","), 256).alias("lineage_sha256"))
    rows = {(r["t"], r["b"]): r for r in told.collect()}
    for side in sides:  # the first partition writes a file even without rows
        final[side.name] = {p: b for p, b in final[side.name].items() if (side.name, b) in rows}
    digests = {(r["t"], r["b"]): r for r in _digests(writer, sides, began, final).collect()}
    held = sorted((name, b) for name, files in final.items() for b in files.values())
    if held != sorted(rows) or any((rows[x]["n_rows"], x) != (digests[x]["n_rows"] if x in digests else None, x) for x in held):
        raise RuntimeError(f"the files in {folder} do not hold the rows dealt to them; the starting files are kept")
    for side in sides:
        for path in writer.files(side.name) - set(final[side.name]):
            remove(spark, path)
    out = []
    for side in sides:
        names = ",".join(side.frame.columns)
        for path, b in sorted(final[side.name].items(), key=lambda x: x[1]):
            row, digest = rows[side.name, b], digests[side.name, b]
            out.append((side.name, path, names, b, row["n_rows"], digest["n_joined"], digest["ids_sha256"], row["lineage_sha256"], path not in began[side.name]))
    return spark.createDataFrame(out, REPORT)


def _digests(writer: _Writer, sides: tuple[Side, Side], began: dict[str, set[str]], final: dict[str, dict[str, int]]) -> DataFrame:
    """(t, b, n_rows, n_joined, ids_sha256) of the final files, as read back."""
    runs, number = None, _free("number", [writer.key])
    for side in sides:
        paths = final[side.name]
        for group in (set(paths) & began[side.name], set(paths) - began[side.name]):
            if not group:
                continue
            bucket_of = {file_number(p): paths[p] for p in group}
            named = F.array(*(F.lit(bucket_of.get(i, -1)) for i in range(max(bucket_of) + 1)))
            found = writer.read(sorted(group), T.StructType([side.frame.schema[writer.key]]), number)
            own = found.select(F.lit(side is not sides[0]).alias("second"), F.element_at(named, F.col(number) + 1).alias("b"), F.col(_quoted(writer.key)).alias("id"), found.metadataColumn("_metadata")["row_index"].alias("at"))
            own = own.groupBy("second", "b", "id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
            runs = own if runs is None else runs.unionByName(own)
    if runs is None:
        return writer.spark.createDataFrame([], "t string, b int, n_rows long, n_joined long, ids_sha256 string")
    dealt = runs.repartition(writer.parts, F.element_at(writer.keys, F.col("b") + 1)).sortWithinPartitions("b", F.col("id").desc_nulls_first(), "second")
    names = [side.name for side in sides]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Bucket | None = None
        for batch in batches:
            b = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)] if len(b) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if now is None or now.b != b[lo]:
                    if now is not None:
                        yield now.rows(names)
                    now = _Bucket(int(b[lo]))
                now.add(batch.slice(lo, hi - lo))
        if now is not None:
            yield now.rows(names)

    return map_arrow(dealt.select("second", "b", F.col("id").cast("string").alias("id"), "n", "first", "last"), run, "t string, b int, n_rows long, n_joined long, ids_sha256 string")


class _Bucket:
    """What is known of a bucket's two files so far; its runs come in the files' order."""

    def __init__(self, b: int) -> None:
        self.b, self.joined = b, 0
        self.digests, self.n = (hashlib.sha256(), hashlib.sha256()), [0, 0]
        self.before: tuple[str | None, bool, int] = (None, True, 0)

    def add(self, runs: pa.RecordBatch) -> None:
        second, ids = runs.column(0).to_numpy(zero_copy_only=False), runs.column(2)
        n, first, last = (runs.column(i).to_numpy() for i in (3, 4, 5))
        for k in (0, 1):
            own = np.flatnonzero(second == bool(k))
            if not len(own):
                continue
            ends = self.n[k] + np.cumsum(n[own])
            if (first[own] != ends - n[own]).any() or (last[own] != ends - 1).any():
                raise RuntimeError(f"the file of bucket {self.b} is not in the order of its keys")
            self._digest(k, ids.take(pa.array(own)).fill_null("").to_pylist(), n[own])
            self.n[k] = int(ends[-1])
        mine, after = ids[0].as_py(), np.zeros(0, np.int64)
        if mine is not None and mine == self.before[0] and not self.before[1]:
            self.joined += self.before[2] * int(n[0])
        if len(ids) > 1:
            same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy(zero_copy_only=False)
            after = np.flatnonzero(same)
            self.joined += sum(int(x) * int(y) for x, y in zip(n[after], n[after + 1], strict=True))
        self.before = (ids[len(ids) - 1].as_py(), bool(second[-1]), int(n[-1]))

    def _digest(self, k: int, ids: list[str], n: np.ndarray) -> None:
        started, names = self.n[k] > 0, np.array(ids, dtype=object)
        for at in range(0, len(ids), STEP_KEYS):
            some, times = names[at : at + STEP_KEYS], n[at : at + STEP_KEYS]
            while len(times):  # the most repeated key may stand there more often than fits
                step = np.minimum(times, np.maximum(0, STEP_KEYS - np.cumsum(times) + times))
                text = ",".join(np.repeat(some, step).tolist())
                self.digests[k].update(("," + text if started else text).encode())
                started, left = True, times > step
                some, times = some[left], (times - step)[left]

    def rows(self, names: list[str]) -> pa.RecordBatch:
        some = [k for k in (0, 1) if self.n[k]]
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in some]), pa.array([self.b] * len(some), type=pa.int32()), pa.array([self.n[k] for k in some]), pa.array([self.joined] * len(some)), pa.array([self.digests[k].hexdigest() for k in some])], ["t", "b", "n_rows", "n_joined", "ids_sha256"])
