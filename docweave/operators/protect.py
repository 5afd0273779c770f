"""Blocks to protected blocks and back.

Shielding numbers tokens through a whole document, and what it shields depends on
nesting, so it runs in Arrow workers on the parsed blocks of a document, a batch at a
time and without a shuffle. Restoring is a fold of Catalyst expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.literals import Shield, token
from docweave.functions.text import let
from docweave.operators.blocks import blocks_of, joined, maps, offsets, split_ends, with_blocks

PLACEHOLDERS = "array<struct<token:string,raw_text:string,kind:string>>"
PROTECTED = f"array<struct<block_index:int,block_type:string,protected_text:string,placeholders:{PLACEHOLDERS},translatable:boolean,meta:map<string,string>>>"

# Front matter fields that are translated, and comment marks by language.
FIELDS = ("title", "subtitle", "desc")
HASH = frozenset(("python", "py", "ruby", "rb", "shell", "sh", "bash", "zsh", "yaml", "yml", "conf", "cfg", "mk", "makefile", "dockerfile", "perl", "pl", "r", "tcl"))
SLASH = frozenset(("c", "cpp", "cc", "h", "hpp", "java", "javascript", "js", "typescript", "ts", "go", "rust", "rs", "swift", "kotlin", "kt", "csharp", "cs", "php", "scala", "groovy", "dart"))
MARKUP = frozenset(("html", "xml", "svg", "markdown", "md"))
# Images, links and code; fields and scalars of front matter; table rules and
# cells; a fence's language; the marks of a heading; block comments.
_INLINE = re.compile(r"(!\[([^\]]*)\]\(([^)]*)\))|((?<!!)\[([^\]]*)\]\(([^)]*)\))|((`+)([^\n]*?)\8)")
_FIELD = re.compile(r"(\s*)([A-Za-z0-9_-]+):(\s*)(.*)$")
_SCALAR = re.compile(r"(\s*)([A-Za-z0-9_-]+):(\s*)([|>][-+]?)\s*$")
_RULE = re.compile(r"\s*\|?(?:\s*:?-+:?\s*\|)+\s*:?-+:?\s*\|?\s*$")
_CELL = re.compile(r"((?:\\.|[^\\|]|\\$)*)(\||$)")
_LANGUAGE = re.compile(r"[`~]{3,}\s*(\w+)?")
_HEAD = re.compile(r"#{1,6}\s+")
_COMMENTS = {"/*": re.compile(r"(/\*)(.*?)(\*/)", re.S), "<!--": re.compile(r"(<!--)(.*?)(-->)", re.S)}


class Protector:
    """Protects the blocks of documents, one document after the other."""

    def __init__(self, fields: tuple[str, ...] = FIELDS) -> None:
        self.fields = frozenset(f.lower() for f in fields)

    def document(self, blocks: list[tuple[str, str, dict[str, str]]]) -> list[tuple]:
        """(place, type, protected text, placeholders, translatable, facts) of blocks
        (type, raw text, facts)."""
        self.shield = Shield(frozenset(t for _, raw, _ in blocks if "@@PROTECT_" in raw for t in token.findall(raw)))
        return [self.block(i, *b) for i, b in enumerate(blocks)]

    def block(self, place: int, kind: str, raw: str, meta: dict[str, str]) -> tuple:
        meta = dict(meta)
        text, translatable = getattr(self, f"_{kind}", self._plain)(raw, meta)
        return place, kind, text, self.shield.take(), translatable, meta

    def inline(self, text: str) -> str:
        if "`" not in text and "](" not in text:
            return self.shield.prose(text)
        out, at = [], 0
        for m in _INLINE.finditer(text):
            out.append(self.shield.prose(text[at : m.start()]))
            at = m.end()
            if m[1] is not None:
                out.append(f"![{m[2]}]({self.shield.token(m[3], 'image_path')})")
            elif m[4] is not None:
                out.append(f"[{m[5]}]({self.shield.token(m[6], 'link_target')})")
            else:
                out.append(self.shield.token(m[0], "inline_code"))
        return "".join([*out, self.shield.prose(text[at:])])

    def _plain(self, raw: str, meta: dict) -> tuple[str, bool]:
        return raw, True

    def _blank_line(self, raw: str, meta: dict) -> tuple[str, bool]:
        return raw, False

    def _paragraph(self, raw: str, meta: dict) -> tuple[str, bool]:
        return self.inline(raw), True

    def _heading(self, raw: str, meta: dict) -> tuple[str, bool]:
        head = _HEAD.match(raw)[0]
        return head + self.inline(raw[len(head) :]), True

    def _list_item(self, raw: str, meta: dict) -> tuple[str, bool]:
        head = meta["marker"]
        return head + self.inline(raw[len(head) :]), True

    def _admonition(self, raw: str, meta: dict) -> tuple[str, bool]:
        lines, ends = split_ends(raw)
        if len(lines) < 2:
            return raw, True
        stop = len(lines) - 1 if lines[-1].rstrip() == ":::" else len(lines)
        body = self.inline(joined(lines[1:stop], ends[1 : stop - 1])) if stop > 1 else ""
        close = (ends[-1] if stop > 1 else "") + lines[-1] if stop < len(lines) else ""
        return lines[0] + ends[0] + body + close, True

    def _front_matter(self, raw: str, meta: dict) -> tuple[str, bool]:
        lines, ends = split_ends(raw)
        if len(lines) < 2:
            return raw, False
        out, content = [lines[0]], False
        take, depth = None, 0  # within a block scalar: whether its field is exposed, and its indent
        for line in lines[1:-1]:
            if take is not None and (not line.strip() or line[0] == "\t" or len(line) - len(line.lstrip(" ")) > depth):
                if not take:
                    out.append(self.shield.token(line, "front_matter_line"))
                elif not line.strip():
                    out.append(self.shield.token(line, "front_matter_blank_line"))
                else:
                    body = line.lstrip(" \t")
                    out.append(self.shield.token(line[: len(line) - len(body)], "front_matter_indent") + body)
                    content = content or bool(body.strip())
                continue
            take = None
            if m := _SCALAR.match(line):
                take, depth = m[2].lower() in self.fields, len(m[1])
                out.append(self.shield.token(line, "front_matter_key" if take else "front_matter_line"))
            elif (m := _FIELD.match(line)) and m[2].lower() in self.fields and m[4].strip():
                out.append(self.shield.token(line[: m.start(4)], "front_matter_key") + m[4])
                content = True
            else:
                out.append(self.shield.token(line, "front_matter_line"))
        return joined([*out, lines[-1]], ends), content

    def _table(self, raw: str, meta: dict) -> tuple[str, bool]:
        out, content = [], False
        lines, ends = split_ends(raw)
        for i, line in enumerate(lines):
            if i == 1 and _RULE.match(line):
                out.append(self.shield.token(line, "table_separator"))
                continue
            row = []
            for m in _CELL.finditer(line):
                row.append(self.inline(m[1]))
                content = content or bool(m[1].strip())
                if not m[2]:
                    break
                row.append(self.shield.token(m[2], "table_pipe"))
            out.append("".join(row))
        return joined(out, ends), content

    def _fenced_code_block(self, raw: str, meta: dict) -> tuple[str, bool]:
        lines, ends = split_ends(raw)
        language = _LANGUAGE.match(lines[0].strip())[1]
        if not language:
            return self.shield.token(raw, "fenced_code_block"), False
        meta["language"] = language = language.lower()
        out = [self.shield.token(lines[0], "code_fence")]
        body, content = joined(lines[1:-1], ends[1:-1]) if len(lines) > 2 else "", False
        if len(lines) > 2:
            text, content = self._code(body, language)
            out.append(text)
        if len(lines) > 1:
            out.append(self.shield.token(lines[-1], "code_fence") if lines[-1] else "")
        return joined(out, (ends[:1] + ends[-1:])[: len(out) - 1]), content

    def _code(self, body: str, language: str) -> tuple[str, bool]:
        marks = {"#"} if language in HASH else {"//", "/*"} if language in SLASH else {"<!--"} if language in MARKUP else {"#"}
        spans = [(m.start(), m.end(), m[1], m[2], m[3]) for mark, pattern in _COMMENTS.items() if mark in marks for m in pattern.finditer(body)]
        out, at, content = [], 0, False
        for start, end, opening, text, closing in sorted(spans):
            if start < at:
                continue
            before, said = self._lines(body[at:start], marks)
            out += [before, self.shield.token(opening, "block_comment_start"), text, self.shield.token(closing, "block_comment_end")]
            content, at = content or said or bool(text.strip()), end
        rest, said = self._lines(body[at:], marks)
        return "".join([*out, rest]), content or said


    def _lines(self, code: str, marks: set[str]) -> tuple[str, bool]:
        """Line comments exposed, their marks and the code before them shielded."""
        mark = next((m for m in ("#", "//") if m in marks), None)
        out, content = [], False
        lines, ends = split_ends(code)
        for line in lines:
            before, found, text = line.partition(mark) if mark else (line, "", "")
            if not found:
                out.append(self.shield.token(line, "code_line") if line else "")
                continue
            out.append((self.shield.token(before, "code_line_prefix") if before else "") + self.shield.token(found, "comment_prefix") + text)
            content = content or bool(text)
        return joined(out, ends), content


_ARROW = pa.list_(pa.struct([("block_index", pa.int32()), ("block_type", pa.string()), ("protected_text", pa.string()), ("placeholders", pa.list_(pa.struct([(m, pa.string()) for m in ("token", "raw_text", "kind")]))), ("translatable", pa.bool_()), ("meta", pa.map_(pa.string(), pa.string()))]))


def _packed(found: list[list[tuple]]) -> pa.Array:
    """Protected blocks of documents, column by column."""
    flat = [b for blocks in found for b in blocks]
    made = [m for b in flat for m in b[3]]
    parts = _ARROW.value_type.field("placeholders").type
    marks = pa.StructArray.from_arrays([pa.array([m[k] for m in made], pa.string()) for k in range(3)], fields=list(parts.value_type))
    index = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(blocks), dtype=np.int32) for blocks in found)])
    fields = [pa.array(index), pa.array([b[1] for b in flat], pa.string()), pa.array([b[2] for b in flat], pa.string()), pa.ListArray.from_arrays(offsets([len(b[3]) for b in flat]), marks), pa.array([b[4] for b in flat], pa.bool_()), maps([b[5] for b in flat])]
    return pa.ListArray.from_arrays(offsets([len(blocks) for blocks in found]), pa.StructArray.from_arrays(fields, fields=list(_ARROW.value_type)))


def protect_markdown(docs: DataFrame, fields: tuple[str, ...] = FIELDS, *, text: str = "text") -> DataFrame:
    """Texts to protected blocks in one pass: :func:`parse_documents` and
    :func:`protect_documents` without the blocks going through the JVM between."""
    protector = Protector(fields)
    return with_blocks(docs, text, PROTECTED, lambda texts: _packed([protector.document(blocks_of(t)) for t in texts]))


def protect_documents(parsed: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """parsed(..., blocks) with ``blocks`` protected: struct(block_index, block_type,
    protected_text, placeholders, translatable, meta)."""
    place = parsed.columns.index("blocks")
    kind = T._parse_datatype_string(PROTECTED)
    schema = T.StructType([T.StructField(f.name, kind if f.name == "blocks" else f.dataType) for f in parsed.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        protector = Protector(fields)
        for batch in batches:
            rows = [[(b["block_type"], b["raw_text"], dict(b["meta"] or {})) for b in blocks or []] for blocks in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = _packed([protector.document(blocks) for blocks in rows])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return parsed.mapInArrow(run, schema)


def restored(text: Column, placeholders: Column) -> Column:
    """The text with its tokens replaced, the last made first."""
    return F.aggregate(F.reverse(placeholders), text, lambda t, p: F.replace(t, p["token"], p["raw_text"]))


def rebuilt(blocks: Column, trailing_newline: Column) -> Column:
    """A document from its protected blocks, in order, with the line ends it had. The blocks,
    which may be a costly expression, are evaluated once."""

    def joined_blocks(xs: Column) -> Column:
        behind = lambda i: F.when((i < F.size(xs) - 1) | trailing_newline, "\n").otherwise("")
        whole = lambda b, i: F.concat(restored(b["protected_text"], b["placeholders"]), F.coalesce(b["meta"]["line_end"], behind(i)))
        return F.array_join(F.transform(xs, whole), "")

    return let(blocks, joined_blocks)
