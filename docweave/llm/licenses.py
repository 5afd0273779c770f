"""License scans by ordered signature rules, in DataFrame functions only.

Every text is cut into words once. A rule's regex is tried where its keyword, a word of
all its matches, is among them; most texts hold none. Words carry their places, so a match
is an interval of words by itself; in order of their starts, longest first, an interval that lies within one of the same
or a higher priority is suppressed. Everything happens within a row, so hot
sources and long documents shuffle nothing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.license_rules import Rule, rules

#: ASCII letters and digits and all beyond ASCII; named by what it holds, the class
#: matches some twenty times faster than as a complement.
_WORD = "[0-9A-Za-z\u0080-\U0010ffff]+"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_REACH = "struct<m1:int,m2:int,m3:int>"
_KEPT = "array<struct<s:int,e:int,p:int,i:int>>"
_MATCHED = "array<struct<s:int,e:int,p:int,i:int>>"
_BASE = 4


def _numbered(pattern: str) -> str:
    """The pattern for text whose words carry their places: `` mit#7  license#8 ``."""
    return re.sub(r"(?<=[0-9a-z\]]) ", "#[0-9]+ ", pattern)


def _by_keyword(found: list[Rule]) -> Column:
    """map of keyword -> its rules: array<struct<i, pattern, p>>, one literal of the plan."""
    rows: dict[str, list[dict]] = {}
    for i, r in enumerate(found):
        rows.setdefault(r.keyword, []).append({"i": i, "pattern": _numbered(r.pattern), "p": r.priority})
    return F.from_json(F.lit(json.dumps(rows)), "map<string,array<struct<i:int,pattern:string,p:int>>>")


def _listed(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _detections(text: Column, keywords: Column, found: list[Rule]) -> Column:
    """All matches of the rules of the keywords, sorted: struct(s, -e, -priority, rule)."""
    tried = F.flatten(F.transform(keywords, lambda k: F.element_at(_by_keyword(found), k)))
    place = lambda m, at: F.regexp_extract(m, at, 1).cast("int")
    spans = lambda r: F.transform(F.regexp_extract_all(text, r["pattern"], F.lit(0)), lambda m: F.struct(place(m, "#([0-9]+)").alias("s"), (-1 - place(m, "#([0-9]+) $")).alias("e"), (-r["p"]).alias("p"), r["i"].alias("i")))
    return F.array_sort(F.flatten(F.transform(tried, spans)))


def _kept(sorted_: Column) -> Column:
    """The matches that no earlier one of the same or a higher priority contains.

    A match stays if it ends behind all earlier ones of its priority or above. Blocks
    of about the square root of their number are folded by themselves, each from
    what the blocks before it reach, as a fold copies what it has gathered."""
    none = F.struct(*(F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)))
    reach = lambda m, x: F.struct(*(F.when(-x["p"] == k, F.greatest(m[f"m{k}"], -x["e"])).otherwise(m[f"m{k}"]).alias(f"m{k}") for k in (1, 2, 3)))
    over = lambda m, p: F.when(p == _BASE, F.lit(-1)).when(p == 3, m["m3"]).when(p == 2, F.greatest(m["m2"], m["m3"])).otherwise(F.greatest(m["m1"], m["m2"], m["m3"]))
    most = lambda a, b: F.struct(*(F.greatest(a[f"m{k}"], b[f"m{k}"]).alias(f"m{k}") for k in (1, 2, 3)))
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sorted_))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(sorted_) - 1), step), lambda at: F.slice(sorted_, at + 1, step))

    def ahead(blocks: Column) -> Column:
        """What the blocks before each one reach."""
        ends = F.transform(blocks, lambda b: F.aggregate(b, none, reach))
        start = F.struct(none.alias("now"), F.array().cast(f"array<{_REACH}>").alias("seen"))
        add = lambda a, x: F.struct(most(a["now"], x).alias("now"), F.concat(a["seen"], F.array(a["now"])).alias("seen"))
        return F.aggregate(ends, start, add, lambda a: a["seen"])

    def block(rows: Column, before: Column) -> Column:
        start = F.struct(before.alias("m"), F.array().cast(_KEPT).alias("kept"))

        def add(a: Column, x: Column) -> Column:
            e, p = -x["e"], -x["p"]
            one = F.array(F.struct(x["s"].alias("s"), e.alias("e"), p.alias("p"), x["i"].alias("i")))
            return F.struct(reach(a["m"], x).alias("m"), F.when(e > over(a["m"], p), F.concat(a["kept"], one)).otherwise(a["kept"]).alias("kept"))

        return F.aggregate(rows, start, add, lambda a: a["kept"])

    cut = F.transform(F.array(blocks), lambda b: F.zip_with(b, ahead(b), block))  # binds the blocks once
    return F.flatten(F.flatten(cut))


def detections(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``found``: array of (s, e, p, i), a match's first
    word, the word behind it, its priority and its rule's place in
    :func:`~docweave.llm.license_rules.rules`. Columns of these names are replaced."""
    known = rules()
    body = F.coalesce(F.col(text), F.lit(""))
    cut = docs.withColumn("_words", F.regexp_extract_all(F.translate(body, *_LOWER), F.lit(_WORD), F.lit(0)))
    keywords = F.array_intersect("_words", F.array(*map(F.lit, sorted({r.keyword for r in known}))))
    low = F.transform("_words", lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i.cast("string"), F.lit(" ")))
    held = cut.withColumn("n_words", F.size("_words").cast("long")).withColumn("_keywords", keywords)
    normal = held.withColumn("_normal", F.when(F.size("_keywords") > 0, F.array_join(low, ""))).drop("_words")
    matched = F.when(F.col("_normal").isNotNull(), _detections(F.col("_normal"), F.col("_keywords"), known))
    found = F.flatten(F.transform(F.array(F.coalesce(matched, F.array().cast(_MATCHED))), _kept))  # binds the matches once
    return normal.withColumn("found", found).drop("_normal", "_keywords")


def license_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_found) for each row of ``docs``.

    Texts are lower-cased in A-Z; words are runs of ASCII letters and digits and of
    non-ASCII characters; a null text counts as empty. Base places are never
    suppressed; where they are none, first and last are null and labels empty.
    ``score`` is the best confidence among what is kept, else 0. Repeated rows each
    get a row, an empty table gives none; other columns are not read. A text of any
    length and any number of matches is one row; time grows with the matches to the
    power of 1.5 at most."""
    known = rules()
    labels, confidence = _listed([r.label for r in known], "string"), _listed([r.confidence for r in known], "double")
    base = F.filter(F.col("found"), lambda x: x["p"] == _BASE)
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: F.get(labels, x["i"])))), ",")
    found = detections(docs.select(doc_id, text), text=text)
    return found.select(
        doc_id,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["s"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.col("found"), lambda x: F.get(confidence, x["i"]))), F.lit(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )
