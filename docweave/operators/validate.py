"""Checks of translations, as expressions: an error code a row, null if it passes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"@@PROTECT_\d+@@"
# Loose forms of tokens, words that fix an order, and error messages.
LOOSE = r"(?iU)@@\s*protect\s*[_-]\s*(\d+)\s*@@"
DIRECTIONAL = r"(?iU)\b(from|to|before|after|先|后|从|到|之前|之后)\b"
ZH = r"[一-鿿]"
WORD = r"(?U)\b[A-Za-z][A-Za-z0-9_-]*\b"
MESSAGES = {
    "placeholders": "Translated text changed protected placeholder tokens or their order.",
    "residual_zh": "Translated text still contains Chinese outside protected placeholders.",
    "residual_en": "Translated text still contains too much English outside protected placeholders.",
    "item_ids": "Translated item IDs do not match the request order.",
}
SPLITTABLE = tuple(MESSAGES)
RESIDUAL = ("residual_zh", "residual_en")


@dataclass(frozen=True)
class Mode:
    """English words that are too many, whether tokens may change places, and the
    least size of a batch that is split."""

    residual_threshold: int = 5
    allow_reorder: bool = False
    min_split: int = 2


MODES = {"strict": Mode(3, False, 1), "balanced": Mode(), "lenient": Mode(8, True, 3)}


def mode(name: str, **given: int | bool) -> Mode:
    """The preset of a name (balanced if unknown); a value given that differs from
    the balanced default stays."""
    preset, default = MODES.get(name.strip().lower(), Mode()), Mode()
    fields = {k: given[k] if k in given and given[k] != getattr(default, k) else getattr(preset, k) for k in ("residual_threshold", "allow_reorder", "min_split")}
    return Mode(**fields)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def normalised(text: Column) -> Column:
    """Loose and escaped tokens in their canonical form, four digits at least."""
    plain = F.replace(text, F.lit("\\@"), F.lit("@"))
    loose = F.regexp_extract_all(plain, F.lit(LOOSE), F.lit(1))
    gaps = F.split(plain, LOOSE, -1)
    digits = lambda n: F.regexp_replace(n, "^0+(?=.)", "")
    named = lambda n: F.concat(F.lit("@@PROTECT_"), F.when(F.length(digits(n)) < 4, F.lpad(digits(n), 4, "0")).otherwise(digits(n)), F.lit("@@"))
    joined = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), loose.alias("n")), lambda p: F.concat(p["g"], F.when(p["n"].isNotNull(), named(p["n"])).otherwise(""))), "")
    return F.when(plain.rlike(LOOSE), joined).otherwise(plain)


def tokens_agree(source: Column, translated: Column, allow_reorder: bool) -> Column:
    """The same tokens; in the same order too, unless reordering is allowed and the
    source holds no word that fixes an order."""
    a, b = tokens(source), tokens(translated)
    same = F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    return same & ((a == b) if not allow_reorder else (~source.rlike(DIRECTIONAL) | (a == b)))


def without_tokens(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN, "")


def english_left(text: Column) -> Column:
    """Words with a lower-case letter outside tokens."""
    words = F.regexp_extract_all(without_tokens(text), F.lit(WORD), F.lit(0))
    return F.size(F.filter(words, lambda w: w.rlike(r"\p{Ll}"))).cast("long")


def error_code(source: Column, translated: Column, direction: Column, m: Mode = MODES["balanced"]) -> Column:
    return (
        F.when(~tokens_agree(source, translated, m.allow_reorder), "placeholders")
        .when((direction == "zh_to_en") & without_tokens(translated).rlike(ZH), "residual_zh")
        .when((direction == "en_to_zh") & (english_left(translated) >= m.residual_threshold), "residual_en")
    )


def rate_limited(message: Column) -> Column:
    up = F.upper(message)
    return F.contains(up, F.lit("429")) | F.contains(up, F.lit("TOO MANY REQUESTS")) | F.contains(up, F.lit("RATE LIMITED")) | F.contains(up, F.lit("THROTTL"))


def retry_reason(message: Column, code: Column | None = None) -> Column:
    """Why a batch is tried again; an error code, where there is one, decides before
    the message's wording."""
    low = F.lower(message)
    has = lambda x, *ws: reduce(or_, [F.contains(x, F.lit(w)) for w in ws])
    code = F.lit(None).cast("string") if code is None else code
    return (
        F.when(has(message, "429") | has(low, "rate limit"), "rate_limit")
        .when(code.isin(*RESIDUAL) | (code.isNull() & has(low, "still contains", "excessive english", "excessive chinese")), "residual_language")
        .when(has(low, "placeholder") & has(low, "order"), "placeholder_order")
        .when(has(low, "placeholder") & has(low, "missing", "changed"), "placeholder_changed")
        .when(has(low, "placeholder"), "placeholder")
        .when(has(low, "timeout", "connection", "network"), "network")
        .when(has(message, "500", "502", "503"), "server")
        .otherwise(F.concat(F.lit("failed: "), F.substring(message, 1, 100)))
    )
