"""A folder, or a list of files, from scan to sink in one run.

Contents are read once into a table of the shared folder, from which every document gets
its id and the plan is made. Documents go by type and direction, one dataflow each; translations
that an earlier run stored for the same path, direction and fingerprint are taken,
and what a round gets through is stored before the next one begins, so a run that is
broken off goes on where it stopped. A file that fails is a row of ``failures``; the
others go on.

Disk holds one type and direction at a time: when its outputs are written, what the run tells of it
is kept as small tables, without texts, and its folder and shuffle files go.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.session import qualified, release, remove, small_files
from docweave.operators.segments import BATCH, LIMIT, segment_documents
from docweave.operators.translate import Policy
from docweave.operators.translators import Translator
from docweave.plans.metrics import benchmark_rollup, run_metrics
from docweave.plans.reporter import Reporter
from docweave.plans.run import SEGMENT_PREFIX, Outcome, prepared, translate_prepared
from docweave.sources import checkpoints as C
from docweave.sources import outputs as O
from docweave.sources.registry import Registry, default_registry
from docweave.sources.scan import MAX_BYTES, PlanError, checked_plan, detection_texts, folder_files, generated, plan_counts, plan_items, read_texts, relative_folder, scan
from docweave.sources.sink import write_documents

DIRECTIONS = ("zh_to_en", "en_to_zh")
_FAILURE = "source_path string, stage string, message string"


@dataclass
class Report:
    """What a run did: ``plan`` a row a document, ``written`` a row an output,
    ``failures(source_path, stage, message)``, ``files`` the counters of each document,
    ``counts`` of the plan, ``metrics`` of the calls, ``rollup`` over all files."""

    plan: DataFrame
    written: DataFrame
    failures: DataFrame
    files: DataFrame
    counts: dict
    metrics: dict
    rollup: dict


def translate_folder(spark: SparkSession, folder: str, out: str, make: Callable[[], Translator], policy: Policy, work: str, *, recursive: bool = False, registry: Registry | None = None, max_bytes: int = MAX_BYTES, limit: int = LIMIT, batch: int = BATCH, parallel: int = 2, reporter: Reporter | None = None, glossary: DataFrame | None = None) -> Report:
    """Translates the supported files of ``folder`` into ``out``. Outputs of earlier runs
    are left out; those of subfolders keep their folder. Each document goes in the
    direction of its language; where that is not sure, in the policy's. ``work`` is a folder of this run that all executors share.
    :class:`PlanError` if there is nothing to do."""
    files = scan(spark, folder, recursive=recursive, registry=registry)
    with small_files(spark):  # the folder is gone through once; what follows reads the list
        files.write.mode("overwrite").parquet(f"{work}/files")
    files = spark.read.schema(files.schema).parquet(f"{work}/files")
    checked_plan(files)
    generated(files.where("supported")).write.mode("overwrite").parquet(f"{work}/generated")
    made = spark.read.schema("path string").parquet(f"{work}/generated")
    skipped = made.count()
    texts = read_texts(folder_files(spark, folder, recursive).join(made, "path", "left_anti"), limit=max_bytes, registry=registry)
    return _run(texts, out, make, policy, work, None, qualified(spark, folder), skipped, limit, batch, parallel, reporter, glossary)


def translate_files(spark: SparkSession, paths: list[str], out: str, make: Callable[[], Translator], policy: Policy, work: str, *, registry: Registry | None = None, max_bytes: int = MAX_BYTES, limit: int = LIMIT, batch: int = BATCH, parallel: int = 2, reporter: Reporter | None = None, glossary: DataFrame | None = None) -> Report:
    """Translates the listed files, all in the policy's direction, whatever their
    language and names. Files of unknown formats are failures of stage scan_source."""
    if not paths:
        raise PlanError("no files")
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))
    unknown = files.where((registry or default_registry()).document_type(F.col("path")).isNull())
    none = F.lit(None).cast("string")
    odd = unknown.select(F.col("path").alias("source_path"), none.alias("document_type"), none.alias("text"), F.lit("scan_source").alias("stage"), F.lit("unknown format").alias("message"))
    texts = read_texts(files, limit=max_bytes, registry=registry).unionByName(odd)
    return _run(texts, out, make, policy, work, policy.direction, None, 0, limit, batch, parallel, reporter, glossary)


def translate_texts(texts: DataFrame, out: str, make: Callable[[], Translator], policy: Policy, work: str, *, root: str | None = None, limit: int = LIMIT, batch: int = BATCH, parallel: int = 2, reporter: Reporter | None = None, glossary: DataFrame | None = None) -> Report:
    """Translates texts(source_path, document_type, text, stage, message), as ``read_texts``
    makes them, each in the direction of its language. Outputs of paths below the folder ``root`` keep
    their folder."""
    return _run(texts, out, make, policy, work, None, root, 0, limit, batch, parallel, reporter, glossary)


def _run(texts: DataFrame, out: str, make: Callable[[], Translator], policy: Policy, work: str, direction: str | None, root: str | None, skipped: int, limit: int, batch: int, parallel: int, reporter: Reporter | None, glossary: DataFrame | None) -> Report:
    spark, say, began = texts.sparkSession, reporter or Reporter(), time.time()

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    say("read_source", "reading")
    with small_files(spark):
        texts = kept(texts, "texts")
    unread = kept(texts.where("stage is not null").select("source_path", "stage", "message"), "unread")
    planned = plan_items(detection_texts(texts.where("stage is null").drop("stage", "message")), policy.direction, text="detection_text").drop("detection_text")
    if direction is not None:
        planned = planned.withColumn("resolved_direction", F.lit(direction)).withColumn("uses_fallback_direction", F.lit(False))
    plan = kept(planned.withColumn("doc_id", F.monotonically_increasing_id()), "plan")
    remove(spark, f"{work}/texts")
    release(spark)
    counts = plan_counts(plan, skipped).first().asDict()
    say("plan", f"{counts['total']} documents, {counts['zh_to_en']} zh_to_en, {counts['en_to_zh']} en_to_zh, {skipped} outputs of earlier runs left out")
    store = f"{out}/.doc_translation_cache"
    written, failures, calls, reused, marked = [], [unread], [], [], []
    for row in sorted(plan.groupBy("document_type", "resolved_direction").count().collect()):
        kind, way = row["document_type"], row["resolved_direction"]
        say("translate", f"{row['count']} {kind} documents, {way}")
        part = plan.where((F.col("document_type") == kind) & (F.col("resolved_direction") == way))
        done, taken, marks = _translated(part, kind, replace(policy, direction=way), make, f"{work}/{kind}-{way}", store, limit, batch, parallel, glossary, lambda turn, c, kind=kind, way=way: say("translate", f"{kind}, {way}, round {turn}: {c['translated']} of {c['segments']} segments, {c['waiting']} wait, {c['failed']} failed, {c['retries']} retries"))
        named = done.outputs.join(part.select("doc_id", "source_path"), "doc_id")
        below = relative_folder(F.col("source_path"), root) if root else F.lit("")
        named = named.select("source_path", F.concat(below, O.output_name(F.col("source_path"), F.lit(way))).alias("file_name"), "output")
        say("write_output", f"{kind}, {way}")
        wrote = write_documents(named, out)
        told = f"told/{kind}-{way}"
        of = lambda rows, *columns: rows.join(part.select("doc_id", "source_path"), "doc_id").select("source_path", *columns)  # noqa: E731, B023
        unwritten = wrote.where("error is not null").select("source_path", F.lit("write_output").alias("stage"), F.col("error").alias("message"))
        marked.append(kept(marks, f"{told}/marks"))
        written.append(wrote)
        failures.append(kept(of(done.failures, "stage", "message").unionByName(unwritten), f"{told}/failures"))
        calls.append(kept(of(done.translations, "batch_index", "error_code", "retries", "splits", "rescues", "round"), f"{told}/calls"))
        reused.append(kept(of(taken).groupBy("source_path").agg(F.count(F.lit(1)).alias("cached")), f"{told}/reused"))
        remove(spark, f"{work}/{kind}-{way}")
        release(spark)
    told = kept(plan.drop("text"), "told/plan")
    remove(spark, f"{work}/plan")
    plan = told
    failed = kept(_united(failures, spark, _FAILURE), "failures")
    calls = _united(calls, spark, "source_path string, batch_index long, error_code string, retries long, splits long, rescues long, round int")
    files = kept(_files(plan, unread, failed, calls, _united(reused, spark, "source_path string, cached long"), time.time() - began), "files")
    if marked and failed.isEmpty():  # this run's documents only; other runs keep theirs
        C.clear_checkpoints(_united(marked, spark, ""), store)
    say.files(files, failed)
    rollup = benchmark_rollup(files).first().asDict()
    say("done", f"{rollup['succeeded']} of {rollup['files']} files")
    return Report(plan, _united(written, spark, "file_name string, output_path string, bytes_written long, error string, source_path string"), failed, files, counts, run_metrics(calls).first().asDict(), rollup)


def _translated(part: DataFrame, kind: str, policy: Policy, make: Callable[[], Translator], folder: str, store: str, limit: int, batch: int, parallel: int, glossary: DataFrame | None, told: Callable[[int, dict], None]) -> tuple[Outcome, DataFrame, DataFrame]:
    """The documents of one type and direction, the translations that were stored, and the
    documents' fingerprints."""
    spark = part.sparkSession
    prepared(part.select("doc_id", "text"), kind).write.mode("overwrite").parquet(f"{folder}/prepared")
    ready = spark.read.parquet(f"{folder}/prepared")
    segment_documents(ready.where("error is null"), limit=limit, prefix=SEGMENT_PREFIX[kind]).write.mode("overwrite").parquet(f"{folder}/segments")
    segments = spark.read.parquet(f"{folder}/segments")
    listed = F.collect_list(F.struct("ordinal", "seg_id", "block_index", "block_type", "order_in_block", "text"))
    each = segments.groupBy("doc_id").agg(listed.alias("s")).join(ready.select("doc_id", "trailing_newline"), "doc_id")
    marks = each.join(part.select("doc_id", "source_path"), "doc_id").select("doc_id", "source_path", F.lit(policy.direction).alias("direction"), O.fingerprint(F.lit(kind), F.col("trailing_newline"), F.col("s")).alias("fingerprint"))
    marks.write.mode("overwrite").parquet(f"{folder}/fingerprints")
    marks = spark.read.parquet(f"{folder}/fingerprints")
    cached = C.read_checkpoints(spark, store, marks).join(marks, C.KEYS).select("doc_id", "seg_id", "translated_text")
    cached.write.mode("overwrite").parquet(f"{folder}/cached")
    cached = spark.read.parquet(f"{folder}/cached")
    done = translate_prepared(ready, kind, make, policy, folder, cached=cached, segments=segments, limit=limit, batch=batch, parallel=parallel, glossary=glossary, told=told, store=lambda rows: C.write_checkpoints(rows.join(marks, "doc_id"), store))
    return done, cached, marks


def _files(plan: DataFrame, unread: DataFrame, failed: DataFrame, calls: DataFrame, reused: DataFrame, seconds: float) -> DataFrame:
    """(source_path, ok, segments, batches, retries, backoffs, cached, seconds) of each
    file; the run's time is shared evenly, as files run side by side."""
    each = calls.groupBy("source_path").agg(F.count(F.lit(1)).alias("sent"), F.count_distinct("round", "batch_index").alias("batches"), F.sum("retries").alias("retries"), F.max("round").alias("backoffs"))
    paths = plan.select("source_path").unionByName(unread.select("source_path")).distinct()
    bad = failed.select("source_path").distinct().withColumn("bad", F.lit(True))
    every = paths.join(each, "source_path", "left").join(reused, "source_path", "left").join(bad, "source_path", "left")
    number: Callable[[str], Column] = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    share = F.lit(seconds) / F.lit(max(1, paths.count()))
    return every.select("source_path", F.col("bad").isNull().alias("ok"), (number("sent") + number("cached")).alias("segments"), number("batches").alias("batches"), number("retries").alias("retries"), number("backoffs").alias("backoffs"), number("cached").alias("cached"), share.alias("seconds"))


def _united(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)
