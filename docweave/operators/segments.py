"""Protected blocks to segments, batches and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.text import CUT, greedy, hard_split, let, pack, packed_sentences, padded
from docweave.operators.protect import rebuilt

LIMIT = 500
BATCH = 8


def newline_chunks(text: Column) -> Column:
    """Lines with their ends."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^\n]*+\n?+"), F.lit(0)), lambda x: x != "")


def break_chunks(text: Column) -> Column:
    """Pieces that end behind each <br>, cut at marks as sentences are."""
    marked = F.split(F.regexp_replace(text, r"(?i)<br\s*/?>", f"$0{CUT}"), CUT, -1)
    cut = F.when(F.contains(text, F.lit(CUT)), F.regexp_extract_all(text, F.lit(r"(?is).*?(?:<br\s*/?>|\z)"), F.lit(0))).otherwise(marked)
    return F.filter(cut, lambda x: x != "")


def space_chunks(text: Column) -> Column:
    """Words with the white space behind them; leading space is its own chunk."""
    return F.regexp_extract_all(text, F.lit(r"(?U)^\s+|\S+\s*"), F.lit(0))


def _row(line: Column, limit: int) -> Column:
    """A table line; only one that is too long and holds <br> is taken apart."""
    fits = lambda xs: F.forall(xs, lambda x: F.length(x) <= limit)
    by_space = lambda xs: F.when(fits(xs), xs).otherwise(hard_split(line, limit))
    by_break = lambda xs: F.when((F.size(xs) > 1) & fits(xs), xs).otherwise(let(pack(space_chunks(line), limit), by_space))
    apart = let(pack(break_chunks(line), limit), by_break)
    return F.when((F.length(line) > limit) & line.rlike(r"(?i)<br\s*/?>"), apart).otherwise(F.array(line))


def chunked(block_type: Column, text: Column, limit: int = LIMIT) -> Column:
    """The segment texts of a block, which joined give the block."""
    if limit <= 0:
        raise ValueError("the segment limit must be positive")
    table = greedy(F.flatten(F.transform(newline_chunks(text), lambda x: _row(x, limit))), limit)
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= limit, F.array(text)).when(block_type == "table", table).otherwise(packed_sentences(text, limit))


def segment_documents(protected: DataFrame, *, doc_id: str = "doc_id", limit: int = LIMIT, prefix: str = "seg-") -> DataFrame:
    """segments(doc_id, seg_id, block_index, block_type, order_in_block, text); ids
    count within a document. No shuffle: a document's blocks lie in one row."""
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(
        F.when(b["translatable"], chunked(b["block_type"], b["protected_text"], limit)).otherwise(F.array().cast("array<string>")),
        lambda t, i: F.struct(b["block_index"].alias("block_index"), b["block_type"].alias("block_type"), i.alias("order_in_block"), t.alias("text")))))
    rows = protected.select(doc_id, F.posexplode(pieces).alias("ordinal", "s"))
    return rows.select(doc_id, F.concat(F.lit(prefix), padded(F.col("ordinal"))).alias("seg_id"), "ordinal", "s.block_index", "s.block_type", "s.order_in_block", "s.text")


def batched(segments: DataFrame, *, doc_id: str = "doc_id", size: int = BATCH) -> DataFrame:
    """segments with ``batch_index``, from 1, of consecutive segments of a document."""
    place = F.row_number().over(W.partitionBy(doc_id).orderBy("ordinal"))
    return segments.withColumn("batch_index", (F.floor((place - 1) / size) + 1).cast("long"))


def remaining(segments: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Segments without a cached translation."""
    return segments.join(cached.select(*keys), keys, "left_anti")


def reused(segments: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Cached translations that belong to a segment."""
    return cached.join(segments.select(*keys), keys, "left_semi")


def rebuild_documents(protected: DataFrame, segments: DataFrame, translations: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, output, missing): documents with translated segments in place of their
    blocks' texts; a segment without a translation keeps its source and is counted
    as missing. One shuffle, by document."""
    done = segments.join(translations.select(doc_id, "seg_id", "translated_text"), [doc_id, "seg_id"], "left")
    body = F.struct("block_index", "order_in_block", F.coalesce("translated_text", "text").alias("t"))
    parts = done.groupBy(doc_id).agg(F.array_sort(F.collect_list(body)).alias("parts"), F.count_if(F.col("translated_text").isNull()).alias("missing"))
    both = protected.select(doc_id, "blocks", "trailing_newline").join(parts, doc_id, "left")
    filled = F.transform("blocks", lambda b: b.withField("protected_text", F.when(
        F.exists(F.coalesce("parts", F.array()), lambda p: p["block_index"] == b["block_index"]),
        F.array_join(F.transform(F.filter("parts", lambda p: p["block_index"] == b["block_index"]), lambda p: p["t"]), ""),
    ).otherwise(b["protected_text"])))
    return both.select(doc_id, rebuilt(filled, F.col("trailing_newline")).alias("output"), F.coalesce("missing", F.lit(0)).alias("missing"))
