"""Names of outputs and caches, and what tells one content from another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.sources.scan import file_name, stem

SUFFIX = {"zh_to_en": "_en", "en_to_zh": "_zh"}


def output_name(path: Column, direction: Column) -> Column:
    """``<stem>_en.<ext>`` or ``<stem>_zh.<ext>``; another direction raises."""
    suffix = F.when(direction == "zh_to_en", "_en").when(direction == "en_to_zh", "_zh").otherwise(F.raise_error(F.concat(F.lit("unknown direction: "), direction)))
    return F.concat(stem(path), suffix, F.substr(file_name(path), F.length(stem(path)) + 1))


def cache_name(path: Column, direction: Column) -> Column:
    named = F.when(stem(path) == "", "document").otherwise(stem(path))
    return F.concat(F.lit(".doc_translation_cache/"), named, F.lit("_"), direction, F.lit("_"), F.substring(F.sha2(path, 256), 1, 12), F.lit(".json"))


def fingerprint(document_type: Column, trailing_newline: Column, segments: Column) -> Column:
    """SHA-256 of a document's segments(ordinal, seg_id, block_index, block_type,
    order_in_block, text), in order, as compact JSON with its type and whether it ends
    with a line break; letters beyond ASCII stand as they are."""
    listed = F.transform(F.array_sort(segments), lambda s: F.struct(s["seg_id"].alias("id"), s["block_index"].alias("block_index"), s["block_type"].alias("block_type"), s["order_in_block"].alias("order_in_block"), s["text"].alias("text")))
    return F.sha2(_plain_escapes(F.to_json(F.struct(document_type.alias("document_type"), trailing_newline.alias("trailing_newline"), listed.alias("segments")))), 256)


def _plain_escapes(json: Column) -> Column:
    """The JSON with control characters written in lower case: \\u001f for \\u001F."""
    out = json
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(json.rlike(r"\\u00[01][A-F]"), out).otherwise(json)
