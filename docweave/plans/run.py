"""A whole run as one dataflow: parse, protect, segment, resume, translate, rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import dita
from docweave.operators.protect import FIELDS, protect_markdown, rebuilt
from docweave.operators.segments import LIMIT, chunked, rebuild_documents, remaining, reused, segment_documents
from docweave.operators.translate import Policy, translate_segments
from docweave.operators.translators import Translator, mock_translated


# How segment ids of each type begin.
SEGMENT_PREFIX = {"markdown": "seg-", "dita": "dita_seg_"}


@dataclass
class Outcome:
    """outputs(doc_id, output, missing), translations and failures(doc_id, stage, message)."""

    outputs: DataFrame
    translations: DataFrame
    failures: DataFrame


def prepared(docs: DataFrame, document_type: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """docs(doc_id, text) with protected blocks, trailing_newline and error."""
    if document_type == "markdown":
        return protect_markdown(docs, fields).withColumn("error", F.lit(None).cast("string"))
    if document_type == "dita":
        return dita.prepare_documents(docs)
    raise ValueError(f"unknown document type: {document_type}")


def translate_documents(docs: DataFrame, document_type: str, make: Callable[[], Translator], policy: Policy, folder: str, *, cached: DataFrame | None = None, limit: int = LIMIT, batch: int = 8, parallel: int = 2) -> Outcome:
    """All documents of one type. ``folder`` is shared; ``cached(doc_id, seg_id,
    translated_text)`` are translations that need no call."""
    prepared(docs, document_type).write.mode("overwrite").parquet(f"{folder}/prepared")
    ready = docs.sparkSession.read.parquet(f"{folder}/prepared")
    return translate_prepared(ready, document_type, make, policy, folder, cached=cached, limit=limit, batch=batch, parallel=parallel)


def translate_prepared(ready: DataFrame, document_type: str, make: Callable[[], Translator], policy: Policy, folder: str, *, cached: DataFrame | None = None, segments: DataFrame | None = None, limit: int = LIMIT, batch: int = 8, parallel: int = 2, store: Callable[[DataFrame], None] | None = None, glossary: DataFrame | None = None, told: Callable[[int, dict], None] | None = None) -> Outcome:
    """The documents of :func:`prepared`, read from a table; ``store`` gets the translations
    of each round, ``told`` its counters. ``segments`` are theirs, where they are at hand."""
    good = ready.where("error is null")
    if segments is None:
        segments = segment_documents(good, limit=limit, prefix=SEGMENT_PREFIX[document_type])
    keys = ["doc_id", "seg_id"]
    todo = segments if cached is None else remaining(segments, cached, keys)
    made = translate_segments(todo, make, policy, f"{folder}/calls", batch=batch, parallel=parallel, store=store, glossary=glossary, told=told)
    done = made.where("error_code is null").select(*keys, "translated_text")
    if cached is not None:
        done = done.unionByName(reused(segments, cached.select(*keys, "translated_text"), keys))
    failed = made.where("error_code is not null").groupBy("doc_id").agg(F.lit("translate").alias("stage"), F.first("message").alias("message"))
    failures = ready.where("error is not null").select("doc_id", F.lit("parse_document").alias("stage"), F.col("error").alias("message")).unionByName(failed)
    whole = good.join(failed.select("doc_id"), "doc_id", "left_anti")
    return Outcome(_rebuilt(whole, segments, done, document_type), made, failures)


def _rebuilt(ready: DataFrame, segments: DataFrame, done: DataFrame, document_type: str) -> DataFrame:
    if document_type == "markdown":
        return rebuild_documents(ready, segments, done)
    texts = segments.join(done, ["doc_id", "seg_id"], "left")
    parts = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "order_in_block", F.coalesce("translated_text", "text").alias("t")))).alias("parts"), F.count_if(F.col("translated_text").isNull()).alias("missing"))
    both = ready.join(parts, "doc_id", "left")
    filled = F.transform("blocks", lambda b: b.withField("protected_text", F.array_join(F.transform(F.filter("parts", lambda p: p["block_index"] == b["block_index"]), lambda p: p["t"]), "")))
    return dita.rebuild_documents(both.select("doc_id", "text", filled.alias("blocks"), F.coalesce("missing", F.lit(0)).alias("missing")))


def mock_documents(docs: DataFrame, direction: str, *, limit: int = LIMIT) -> DataFrame:
    """(doc_id, output): Markdown documents through the offline translator. The mock is an
    expression, so a document stays in its row: no barrier and no shuffle."""
    ready = prepared(docs, "markdown")
    way = F.lit(direction)
    said = lambda b: F.array_join(F.transform(chunked(b["block_type"], b["protected_text"], limit), lambda t: mock_translated(t, way)), "")
    done = F.transform("blocks", lambda b: b.withField("protected_text", F.when(b["translatable"], said(b)).otherwise(b["protected_text"])))
    return ready.select("doc_id", rebuilt(done, F.col("trailing_newline")).alias("output"))
