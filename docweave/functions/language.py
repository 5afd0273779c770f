"""Language detection: cleaning, counting, classifying, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import let

# What is taken out before counting, in this order, and strings of which a
# text must hold one for the pattern to match.
CLEANING = (
    (r"(?s)```.*?```", " ", ("```",)),
    (r"(?U)</?[A-Za-z_][A-Za-z0-9._:-]*(?:\s+[^<>\n]*?)?\s*/?>", " ", ("<",)),
    (r"`[^`\n]+`", " ", ("`",)),
    (r"!\[([^\]]*)\]\(([^)]*)\)", "$1", ("![",)),
    (r"\[([^\]]*)\]\(([^)]*)\)", "$1", ("](",)),
    (r"(?U)https?://\S+", " ", ("://",)),
    (r"(?U)(?=[A-Za-z]:\\|\.?/)(?<!\w)(?:[A-Za-z]:\\|\.?/)[^\s]+", " ", ("/", ":\\")),
    (r"(?imdU)^:::(note|tip|warning)\s*$", " ", (":::",)),
)
ZH_CHAR = r"[一-鿿]"
EN_WORD = r"(?U)\b[A-Za-z][A-Za-z'-]{1,}\b"
LEAST = 6
DIRECTIONS = {"zh": "zh_to_en", "en": "en_to_zh"}


def cleaned(text: Column) -> Column:
    def step(pattern: str, replacement: str, marks: tuple[str, ...]) -> Callable[[Column], Column]:
        held = lambda x: reduce(or_, (F.contains(x, F.lit(m)) for m in marks))
        return lambda x: F.when(held(x), F.regexp_replace(x, pattern, replacement)).otherwise(x)

    for rule in CLEANING:
        text = let(text, step(*rule))
    return text


def zh_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ZH_CHAR)).cast("long")


def en_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(EN_WORD)).cast("long")


def classified(zh: Column, en: Column) -> Column:
    least = F.lit(LEAST).cast("long")
    return F.when(zh >= F.greatest(least, en * 2), "zh").when(en >= F.greatest(least, zh * 2), "en").otherwise("mixed_or_unknown")


def detect(text: Column) -> Column:
    """struct(language, zh_char_count, en_word_count, sample_length); null counts as
    empty."""
    def found(sample: Column) -> Column:
        zh, en = zh_chars(sample), en_words(sample)
        return F.struct(classified(zh, en).alias("language"), zh.alias("zh_char_count"), en.alias("en_word_count"), F.length(sample).cast("long").alias("sample_length"))

    return let(cleaned(F.coalesce(text, F.lit(""))), found)


def confident(language: Column) -> Column:
    return language.isin("zh", "en")


def direction(language: Column, fallback: str) -> Column:
    if fallback not in DIRECTIONS.values():
        raise ValueError(f"unknown direction: {fallback}")
    return F.when(language == "zh", "zh_to_en").when(language == "en", "en_to_zh").otherwise(fallback)


def matches_direction(language: Column, way: Column) -> Column:
    """Whether a confidently detected language is the direction's source; true if
    none was detected."""
    return ~confident(language) | (F.when(way == "zh_to_en", "zh").when(way == "en_to_zh", "en") == language)


def display_name(language: Column) -> Column:
    return F.when(language == "zh", "中文").when(language == "en", "英文").otherwise("混合或未知")


def document_kind(segments: Column) -> Column:
    """"technical" or "general", from the first 20 segments."""
    text = F.array_join(F.slice(segments, 1, 20), " ")
    fences = (F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3
    snake = F.regexp_count(text, F.lit(r"(?U)\b[a-z_]+_[a-z_]+\b"))
    camel = F.regexp_count(text, F.lit(r"(?U)\b[a-z]+[A-Z][a-zA-Z]*\b"))
    return F.when((fences > 2) | (snake > 10) | (camel > 5), "technical").otherwise("general")
