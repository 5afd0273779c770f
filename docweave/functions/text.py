"""String expressions shared by the operators. Lengths are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a class body; 0x1C-0x1F count too.
SPACE = r"\s\x1c-\x1f"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SENTENCE_END = "([。！？]|[.!?](?=[\\s\"')\\]}>]))"
CUT = "\x01"
SENTENCE = "(?<=[。！？])|(?<=[.!?])(?=[\\s\"')\\]}>])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ends_normalised(text: Column) -> Column:
    """Universal newlines: CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def blank(text: Column) -> Column:
    return F.when(text.rlike(r"[!-~]"), False).otherwise(~text.rlike(f"(?U)[^{SPACE}]"))


def split_lines(text: Column) -> Column:
    """Lines without their ends; no line behind the last end; none of an empty text."""
    whole = lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x)
    return let(F.split(text, LINE_END, -1), whole)


def sentences(text: Column) -> Column:
    """Chunks that end behind every 。！？, and behind . ! ? before white space or a
    closing mark; what separates them stays with the left chunk.

    Ends are marked in one scan and the text is cut at the marks; a text that holds the
    mark itself is cut by a pattern that looks back at every place."""
    marked = F.split(F.regexp_replace(text, "(?U)" + SENTENCE_END, f"$1{CUT}"), CUT, -1)
    cut = F.when(F.contains(text, F.lit(CUT)), F.split(text, "(?U)" + SENTENCE, -1)).otherwise(marked)
    return F.filter(cut, lambda x: x != "")


def hard_split(text: Column, limit: int) -> Column:
    """Slices of ``limit`` code points, in one scan: a substring counts from the text's start."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))


def greedy(chunks: Column, limit: int) -> Column:
    """Neighbouring chunks joined while they fit ``limit``; a longer one stays whole. None
    may be empty.

    The fold looks at lengths alone and keeps where groups begin, so a step costs a sum and
    no text is copied until its group is joined."""

    def begins(sizes: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(limit).alias("open"), F.lit(0).alias("i"))
        fits = lambda s, n: s["open"] + n <= limit
        step = lambda s, n: F.struct(F.when(fits(s, n), s["at"]).otherwise(F.concat(s["at"], F.array(s["i"]))).alias("at"), F.when(fits(s, n), s["open"] + n).otherwise(n).alias("open"), (s["i"] + 1).alias("i"))
        return F.aggregate(sizes, start, step, lambda s: s["at"])

    def groups(xs: Column) -> Column:
        cut = lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(xs, a + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - a), ""))
        return let(begins(F.transform(xs, F.length)), cut)

    return let(chunks, groups)


def pack(chunks: Column, limit: int) -> Column:
    """Neighbouring chunks joined while they fit ``limit``. A longer chunk ends what
    is open and stands as slices; a placeholder token is never cut by slicing."""
    return _apart(greedy(F.filter(chunks, lambda x: x != ""), limit), limit)


def packed_sentences(text: Column, limit: int) -> Column:
    """:func:`pack` of :func:`sentences`, in one scan: each piece is the longest run within
    ``limit`` that ends where a sentence does, or else one whole longer sentence."""
    end = f"(?:{SENTENCE}|\\z)"
    return _apart(F.regexp_extract_all(text, F.lit(f"(?sU).{{1,{limit}}}{end}|.+?{end}"), F.lit(0)), limit)


def _apart(pieces: Column, limit: int) -> Column:
    cut = lambda xs: F.flatten(F.transform(xs, lambda c: F.when(F.length(c) > limit, token_safe_split(c, limit)).otherwise(F.array(c))))
    return let(pieces, lambda xs: F.when(F.exists(xs, lambda c: F.length(c) > limit), cut(xs)).otherwise(xs))


def token_safe_split(text: Column, limit: int) -> Column:
    """Slices of at most ``limit`` code points that cut no placeholder token."""
    units = F.regexp_extract_all(text, F.lit(r"(?s)@@PROTECT_\d+@@|.(?:(?!@@PROTECT_).)*"), F.lit(0))
    pieces = F.flatten(F.transform(units, lambda u: F.when(F.startswith(u, F.lit("@@PROTECT_")), F.array(u)).otherwise(hard_split(u, limit))))
    return F.when(F.contains(text, F.lit("@@PROTECT_")), greedy(pieces, limit)).otherwise(hard_split(text, limit))


def truncated(text: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, max(0, limit - len(suffix))), F.lit(suffix)))


def padded(number: Column, width: int = 4) -> Column:
    """Zero-padded to ``width`` digits, wider numbers as they are."""
    return F.when(number < 10**width, F.lpad(number.cast("string"), width, "0")).otherwise(number.cast("string"))


def strip_sentences(text: Column) -> Column:
    """Sentences without surrounding space; a CJK end also needs what may follow one."""
    parts = F.split(text, "(?U)(?<=[。！？.!?])(?=[\\s\"')\\]}>])", -1)
    return F.filter(F.transform(parts, stripped), lambda x: x != "")
