"""Markdown texts to blocks, without a shuffle.

What a line is depends on the block that is open, so a document is walked line by
line, in Arrow workers; as a fold of expressions the same walk took ten times the
CPU, as each step copied what it had gathered. Counts of lines that need no walk
are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.session import bounded_batches
from docweave.functions.text import let, split_lines

# What lines are.
FENCE = r"^(```+|~~~+)"
HEADING = r"(?dU)^(#{1,6})\s+(.*)$"
LIST_ITEM = r"(?dU)^(\s*(?:[-*+]|\d+\.)\s+)"
ADMONITION = r"(?idU)^:::(note|tip|warning)\s*$"
ADMONITION_END = r"(?dU)^:::\s*$"
TABLE_RULE = r"(?dU)^\s*\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?\s*$"
INLINE = r"(?d)(!\[([^\]]*)\]\(([^)]*)\))|((?<!!)\[([^\]]*)\]\(([^)]*)\))|((`+)([^\n]*?)\8)"

_BAR = "---"
# Line ends; all but the line feed are rare.
_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_ODD = re.compile("[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_FENCE, _HEADING, _LIST_ITEM, _ADMONITION, _ADMONITION_END, _TABLE_RULE = (re.compile(re.sub(r"^\(\?[a-zU]+\)", "", x), f) for x, f in ((FENCE, 0), (HEADING, 0), (LIST_ITEM, 0), (ADMONITION, re.I), (ADMONITION_END, 0), (TABLE_RULE, 0)))
_ARROW = pa.list_(pa.struct([("block_index", pa.int32()), ("block_type", pa.string()), ("raw_text", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))]))
BLOCKS = "array<struct<block_index:int,block_type:string,raw_text:string,meta:map<string,string>>>"


def line_facts(lines: Column) -> Column:
    """What each line could start, whatever stands before it. Plain prefixes are
    tested before patterns, as most lines are prose."""
    starts = lambda x, *marks: reduce(or_, (F.startswith(x, F.lit(m)) for m in marks))
    facts = lambda x, i: F.struct(
        F.when(F.contains(x, F.lit("|")), F.coalesce(F.get(lines, i + 1).rlike(TABLE_RULE), F.lit(False))).otherwise(False).alias("rule"),
        F.when(starts(x, "#"), x.rlike(HEADING)).otherwise(False).alias("heading"),
        x.rlike(LIST_ITEM).alias("item"),
    )
    return F.transform(lines, facts)


def start_of(lines: list[str], i: int) -> tuple[str, dict[str, str]]:
    """The block that a line starts where none is open, and its facts."""
    x = lines[i]
    if i == 0 and x.strip() == _BAR:
        return "front_matter", {}
    head = x[:1]
    if head in "`~" and (m := _FENCE.match(x)):
        return "fenced_code_block", {"fence": m[1]}
    if head == ":" and (m := _ADMONITION.match(x)):
        return "admonition", {"admonition_type": m[1].lower()}
    if not x or x.isspace():
        return "blank_line", {}
    if "|" in x and i + 1 < len(lines) and _TABLE_RULE.match(lines[i + 1]):
        return "table", {}
    if head == "#" and (m := _HEADING.match(x)):
        return "heading", {"level": str(len(m[1]))}
    if m := _LIST_ITEM.match(x):
        return "list_item", {"marker": m[1]}
    return "paragraph", {}


def split_ends(text: str) -> tuple[list[str], list[str]]:
    """Lines, and the line ends between them, one fewer."""
    if not _ODD.search(text):
        lines = text.split("\n")
        return lines, ["\n"] * (len(lines) - 1)
    return _END.split(text), _END.findall(text)


def joined(lines: list[str], ends: list[str]) -> str:
    return "".join(x for pair in zip(lines, [*ends, ""], strict=True) for x in pair)


def blocks_of(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, raw text, facts) of the blocks of a text, one walk over its lines. Lines end
    at any of Unicode's line ends, which the raw text keeps; the end behind a block is a
    fact, ``line_end``, where it is none of a plain text's."""
    lines = text.splitlines()
    ends = None
    if _ODD.search(text):
        ends = [kept[len(line) :] for line, kept in zip(lines, text.splitlines(keepends=True), strict=True)]
    out: list[tuple[str, str, dict[str, str]]] = []

    def close(kind: str, first: int, last: int, facts: dict[str, str]) -> None:
        if ends is None:
            out.append((kind, "\n".join(lines[first:last]), facts))
            return
        own = facts if ends[last - 1] in ("", "\n") else {**facts, "line_end": ends[last - 1]}
        out.append((kind, joined(lines[first:last], ends[first : last - 1]), own))

    kind, facts, first, inside = "", {}, 0, False
    for i, x in enumerate(lines):
        if inside:
            inside = not (x.strip() == _BAR if kind == "front_matter" else x.startswith(facts["fence"][:3]) if kind == "fenced_code_block" else _ADMONITION_END.match(x))
            continue
        if kind == "table" and "|" in x:
            continue
        new, found = start_of(lines, i)
        if new == kind and new in ("blank_line", "paragraph"):
            continue
        if i:
            close(kind, first, i, facts)
        kind, facts, first = new, found, i
        inside = new in ("front_matter", "fenced_code_block", "admonition")
    if lines:
        close(kind, first, len(lines), facts)
    return out


def offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32), type=pa.int32())


def maps(rows: list[dict[str, str]]) -> pa.Array:
    return pa.MapArray.from_arrays(offsets([len(r) for r in rows]), pa.array([k for r in rows for k in r], pa.string()), pa.array([v for r in rows for v in r.values()], pa.string()))


def with_blocks(docs: DataFrame, text: str, blocks: str, pack: Callable[[list[str]], pa.Array]) -> DataFrame:
    """``docs`` with ``blocks``, of the type given, packed a batch of texts at a time,
    and ``trailing_newline``. Columns of these names are replaced; a null text is empty."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("blocks", "trailing_newline")
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema, T.StructField("blocks", T._parse_datatype_string(blocks)), T.StructField("trailing_newline", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pack(texts), pa.array([t.endswith("\n") for t in texts], pa.bool_())], schema.names)

    return docs.mapInArrow(run, schema)


def _packed(texts: list[str]) -> pa.Array:
    found = [blocks_of(t) for t in texts]
    flat = [b for blocks in found for b in blocks]
    index = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(blocks), dtype=np.int32) for blocks in found)])
    fields = [pa.array(index), pa.array([b[0] for b in flat], pa.string()), pa.array([b[1] for b in flat], pa.string()), maps([b[2] for b in flat])]
    return pa.ListArray.from_arrays(offsets([len(blocks) for blocks in found]), pa.StructArray.from_arrays(fields, fields=list(_ARROW.value_type)))


def parse_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``blocks`` and ``trailing_newline``; a null text has no blocks."""
    return with_blocks(docs, text, BLOCKS, _packed)


def explode_blocks(parsed_docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return parsed_docs.select(doc_id, F.inline("blocks"))


def inline_tokens(text: Column) -> Column:
    """array<struct<type, raw, text, target>>: images, links, code and the texts
    between, in order."""
    found = F.regexp_extract_all(text, F.lit(INLINE), F.lit(0))
    gaps = F.split(text, INLINE, -1)

    def token(raw: Column) -> Column:
        image, link = F.startswith(raw, F.lit("!")), F.startswith(raw, F.lit("["))
        label = F.regexp_extract(raw, r"^!?\[([^\]]*)\]\(([^)]*)\)$", 1)
        target = F.regexp_extract(raw, r"^!?\[([^\]]*)\]\(([^)]*)\)$", 2)
        code = F.regexp_extract(raw, r"(?d)^(`+)([^\n]*?)\1$", 2)
        kind = F.when(image, "image").when(link, "link").otherwise("inline_code")
        return F.struct(kind.alias("type"), raw.alias("raw"), F.when(image | link, label).otherwise(code).alias("text"), F.when(image | link, target).otherwise("").alias("target"))

    plain = lambda raw: F.struct(F.lit("text").alias("type"), raw.alias("raw"), raw.alias("text"), F.lit("").alias("target"))
    both = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda p: F.array(plain(p["g"]), F.when(p["m"].isNotNull(), token(p["m"]))))
    return F.filter(F.flatten(both), lambda x: x.isNotNull() & (x["raw"] != ""))


def line_classes(text: Column) -> Column:
    """struct of how many lines could start a heading, a list item and a table."""
    return let(let(split_lines(text), line_facts), _counts)


def _counts(facts: Column) -> Column:
    count = lambda test: F.size(F.filter(facts, test)).cast("long")
    return F.struct(count(lambda x: x["heading"]).alias("headings"), count(lambda x: x["item"]).alias("list_items"), count(lambda x: x["rule"]).alias("table_starts"))
