"""Topic-style XML to segments and back. The tree walk and the rebuild need a parser,
so they run in Arrow workers, a document at a time; splitting stays in Catalyst. A
rebuild changes the source only where a translated text goes in."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.literals import Shield, restore, token
from docweave.functions.session import bounded_batches

# Elements whose text is translated, and elements that hide theirs.
TAGS = frozenset(("title", "shortdesc", "context", "info", "note", "postreq", "section", "result", "p", "li", "entry", "choice", "ph", "cmd", "stepxmp", "stepresult", "xref"))
HIDDEN = frozenset(("codeblock", "codeph", "filepath", "pre", "lines", "screen", "msgblock", "userinput", "systemoutput"))

SLOT = "struct<block_index:int,block_type:string,element_path:array<int>,field_name:string,tag_name:string,protected_text:string,placeholders:array<struct<token:string,raw_text:string,kind:string>>,translatable:boolean,meta:map<string,string>>"


def parse(text: str) -> ET.Element:
    """The root, with comments and instructions kept; entity declarations are refused."""
    if re.search(r"<!ENTITY", text):
        raise ET.ParseError("entity declarations are not read")
    return ET.fromstring(text, ET.XMLParser(target=ET.TreeBuilder(insert_comments=True, insert_pis=True)))


def local(tag: object) -> str | None:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else None


def slots(root: ET.Element) -> Iterator[tuple[tuple[int, ...], str, str, str]]:
    """(path, field, tag, text) of every text to translate, in document order. A tail
    belongs to the element around it."""
    todo: list[tuple] = [("in", root, (), False, False)]
    while todo:
        what, element, path, under, hidden = todo.pop()
        name = local(element.tag)
        if what == "tail":
            yield path, "tail", under, element.tail
            continue
        hidden = hidden or name in HIDDEN or element.attrib.get("translate", "").lower() == "no"
        own = name in TAGS
        if own and not hidden and (element.text or "").strip():
            yield path, "text", name, element.text
        for k in range(len(element) - 1, -1, -1):
            child = element[k]
            if (under or own) and not hidden and (child.tail or "").strip():
                todo.append(("tail", child, (*path, k), name, hidden))
            todo.append(("in", child, (*path, k), under or own, hidden))


# Fixed value: what may stand before the root.
_BEFORE = re.compile(r"\A(?:\s+|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>)*", re.S)


def namespaces(text: str) -> dict[str, str]:
    """Prefixes and what they stand for, the last declaration of each; "" is the default."""
    return {prefix or "": uri for _, (prefix, uri) in ET.iterparse(io.StringIO(text), events=("start-ns",))}


def xml_facts(text: Column) -> Column:
    """struct<namespaces, leading, error>: the prefixes of an XML text, what stands before its
    root, as it stands, and why it cannot be parsed; null parts of such a text."""

    @F.pandas_udf("struct<namespaces:map<string,string>,leading:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for one in texts:
            try:
                parse(one or "")
                rows.append((namespaces(one), _BEFORE.match(one)[0], None))
            except (ET.ParseError, ValueError) as error:
                rows.append((None, None, f"parse_document: {error}"))
        return pd.DataFrame(rows, columns=["namespaces", "leading", "error"])

    return run(text)


def prepare(text: str) -> list[dict]:
    shield, out = Shield(frozenset(token.findall(text))), []  # tokens that the source itself holds stay
    for path, field, tag, body in slots(parse(text)):
        covered = shield.literals(body, urls=True)
        made = [dict(zip(("token", "raw_text", "kind"), m, strict=True)) for m in shield.take()]
        out.append({"block_index": len(out), "block_type": "dita_text", "element_path": list(path), "field_name": field, "tag_name": tag or "", "protected_text": covered, "placeholders": made, "translatable": True, "meta": {"xml_tag": tag or "", "xml_field": field}})
    return out


def spans(body: bytes) -> dict[tuple[tuple[int, ...], str], tuple[int, int]]:
    """Where in the source (UTF-8) each text and tail stands, by path and field, as the
    parser's byte offsets tell: from behind one piece of markup to the next one. Character
    references and CDATA belong to the text; comments and instructions count as elements."""
    found: dict[tuple[tuple[int, ...], str], tuple[int, int]] = {}
    parser = expat.ParserCreate("utf-8")
    open_: list[list] = []  # [path, children so far] of the elements around
    slot: tuple[tuple[int, ...], str] | None = None
    begin: int | None = None

    def markup() -> None:
        nonlocal begin
        if begin is not None and slot is not None:
            found[slot] = (begin, parser.CurrentByteIndex)
        begin = None

    def child() -> tuple[int, ...]:
        if not open_:
            return ()
        open_[-1][1] += 1
        return (*open_[-1][0], open_[-1][1] - 1)

    def start(*_: object) -> None:
        nonlocal slot
        markup()
        path = child()
        open_.append([path, 0])
        slot = (path, "text")

    def end(*_: object) -> None:
        nonlocal slot
        markup()
        slot = (open_.pop()[0], "tail")

    def lone(*_: object) -> None:
        nonlocal slot
        markup()
        slot = (child(), "tail") if open_ else None

    def characters(*_: object) -> None:
        nonlocal begin
        if begin is None:
            begin = parser.CurrentByteIndex

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CommentHandler = parser.ProcessingInstructionHandler = lone
    parser.CharacterDataHandler = parser.StartCdataSectionHandler = characters
    parser.Parse(body, True)
    return found


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def rebuild(text: str, blocks: list[dict]) -> str:
    """The document with the blocks' texts spliced into their places in the source. What is
    not translated, and a text that came back as it was, keeps its bytes."""
    known = {(path, field): body for path, field, _, body in slots(parse(text))}
    source = text.encode()
    where = spans(source)
    out, at = [], 0
    for block in sorted(blocks, key=lambda b: where[tuple(map(int, b["element_path"])), b["field_name"]]):
        slot = tuple(map(int, block["element_path"])), block["field_name"]
        new = restore(block["protected_text"], [(p["token"], p["raw_text"], p["kind"]) for p in block["placeholders"]])
        if new != known.get(slot):
            begin, end = where[slot]
            out += [source[at:begin], escaped(new).encode()]
            at = end
    return b"".join([*out, source[at:]]).decode()


def prepare_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``blocks``, ``error`` (why a text cannot be parsed, else null) and
    ``trailing_newline``. A null text cannot be parsed."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(f"struct<blocks:array<{SLOT}>,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for one in texts:
            try:
                rows.append((prepare(one or ""), None))
            except (ET.ParseError, ValueError) as error:
                rows.append(([], f"parse_document: {error}"))
        return pd.DataFrame(rows, columns=["blocks", "error"])

    done = docs.withColumn("_p", run(F.col(text)))
    return done.withColumn("blocks", F.col("_p.blocks")).withColumn("error", F.col("_p.error")).withColumn("trailing_newline", F.endswith(F.coalesce(text, F.lit("")), F.lit("\n"))).drop("_p")


def rebuilt_text(text: Column, blocks: Column) -> Column:
    """The XML with its blocks put back."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([rebuild(t, json.loads(b)) if b and json.loads(b) else t for t, b in zip(texts, packed, strict=True)])

    return run(text, F.to_json(blocks))


def rebuild_documents(filled: DataFrame) -> DataFrame:
    """filled(doc_id, text, blocks, missing) as (doc_id, output, missing). Blocks that an
    expression has filled are a column here before a worker sees them; within the call of
    a UDF Spark could not evaluate their lambdas."""
    bounded_batches(filled.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [rebuild(t, found) if (found := json.loads(b or "[]")) else t for t, b in zip(f["text"], f["packed"], strict=True)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "output": made, "missing": f["missing"]})

    return filled.select("doc_id", "text", F.to_json("blocks").alias("packed"), "missing").mapInPandas(run, "doc_id long, output string, missing long")


def detection_text(text: Column) -> Column:
    """What a language is detected from: the translatable texts, or the source if
    there are none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            try:
                return "\n".join(b.strip() for _, _, _, b in slots(parse(t))) or t
            except (ET.ParseError, ValueError):
                return t

        return texts.map(one, na_action="ignore")

    return run(text)
