"""Glossary terms in texts: which entries a batch needs, and which were kept.

A term is a sequence of tokens: runs of letters and digits, or single characters of
scripts written without spaces. Its first token is the key of an equi-join with the
tokens of the texts, so a glossary of any length meets only the places where one of its
terms may begin; the rest of the term is compared there. Matches inside longer ones fall
away, per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A token; letters are compared without case.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def term_index(glossary: DataFrame) -> DataFrame:
    """(key, source, target, parts) of glossary(source, target); an entry without a token in
    its source is left out, one that comes twice counts once, with its smallest target."""
    once = glossary.where("source is not null and target is not null").groupBy("source").agg(F.min("target").alias("target"))
    return once.withColumn("parts", tokens(F.col("source"))).where(F.size("parts") > 0).withColumn("key", F.element_at("parts", 1))


def term_matches(texts: DataFrame, glossary: DataFrame, keys: list[str], *, text: str = "text") -> DataFrame:
    """(*keys, source, target, n): the entries that occur in each row of ``texts`` and how
    often, but for matches that lie within a longer one. Null texts have none; rows with
    equal keys count together."""
    rows = texts.select(*keys, tokens(F.col(text)).alias("tokens"), F.monotonically_increasing_id().alias("_row"))
    places = rows.select(*keys, "_row", "tokens", F.posexplode("tokens").alias("at", "key"))
    met = places.join(term_index(glossary), "key").where(F.slice("tokens", F.col("at") + 1, F.size("parts")) == F.col("parts"))
    found = met.select(*keys, "_row", "at", (F.col("at") + F.size("parts")).alias("end"), "source", "target")
    # within a longer match: one that begins no later and ends no earlier, and is not of the same length
    earlier = W.partitionBy("_row").orderBy("at", F.desc("end"), "source").rowsBetween(W.unboundedPreceding, -1)
    reach = found.withColumn("reach", F.max(F.struct("end", (-F.col("at")).alias("from"))).over(earlier))
    inside = F.coalesce((F.col("reach.end") >= F.col("end")) & ((F.col("reach.end") > F.col("end")) | (-F.col("reach.from") < F.col("at"))), F.lit(False))
    return reach.where(~inside).groupBy(*keys, "source", "target").agg(F.count(F.lit(1)).alias("n"))


def terms_of_batches(batches: DataFrame, matches: DataFrame) -> DataFrame:
    """batches(doc_id, batch_index, seg_id) with the entries of their segments: (doc_id,
    batch_index, glossary), an array that a batch's segments bound."""
    own = batches.select("doc_id", "seg_id", "batch_index").join(matches, ["doc_id", "seg_id"])
    return own.groupBy("doc_id", "batch_index").agg(F.array_sort(F.collect_set(F.struct("source", "target"))).alias("glossary"))


def term_report(matches: DataFrame, translations: DataFrame, keys: list[str], *, translated: str = "translated_text") -> DataFrame:
    """(source, target, texts, missed): in how many texts an entry occurs and in how many of
    these the translation holds its target nowhere, without case; a text without a
    translation misses all."""
    done = translations.select(*keys, F.lower(translated).alias("_t"))
    both = matches.join(done, keys, "left")
    kept = F.coalesce(F.contains("_t", F.lower("target")), F.lit(False))
    return both.groupBy("source", "target").agg(F.count(F.lit(1)).alias("texts"), F.count_if(~kept).alias("missed"))
