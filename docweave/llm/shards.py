"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's generator is stepped modulo 2**64 in three limbs that never overflow a
long; each step gives the next shard the key would jump to, and the last jump
below the shard count is its place. Appending a shard moves only the keys whose
next jump lands on it. No table of ring points exists, so executors need nothing
but the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The generator's multiplier (added constant 1) and limb size.
MULTIPLIER = 2862933555777941757
LIMB = 22
_MASK, _TOP = (1 << 22) - 1, (1 << 20) - 1
#: Parts that the slots of a shard are numbered in side by side.
PARTS = 512


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _stepped(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64 as struct<lo, hi>: the low 44 bits' limbs
    and the top 20 bits, joined into a long again."""
    c0, c1, c2 = (F.lit((MULTIPLIER >> s) & m).cast("long") for s, m in ((0, _MASK), (LIMB, _MASK), (2 * LIMB, _TOP)))
    k0, k1, k2 = _and(key, _MASK), _and(F.shiftrightunsigned(key, LIMB), _MASK), F.shiftrightunsigned(key, 2 * LIMB)
    t0 = k0 * c0 + F.lit(1).cast("long")
    t1 = k0 * c1 + k1 * c0 + F.shiftrightunsigned(t0, LIMB)
    t2 = k0 * c2 + k1 * c1 + k2 * c0 + F.shiftrightunsigned(t1, LIMB)
    low = _and(t0, _MASK).bitwiseOR(F.shiftleft(_and(t1, _MASK), LIMB))
    return low.bitwiseOR(F.shiftleft(_and(t2, _TOP), 2 * LIMB))


def jumps(key: Column, shards: int) -> Column:
    """struct<at, next> of a long key among ``shards``: its shard, from 0, and where
    it would jump to from there, the first place beyond; a null key counts as 0.

    About ln(shards) jumps reach the end; the few keys that need more than the first
    fold has go on in a second one."""
    start = F.struct(F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def step(state: Column, _: Column) -> Column:
        key = _stepped(state["key"])
        jump = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(key, 33) + 1).cast("double"))).cast("long")
        return F.when(state["next"] < shards, F.struct(key.alias("key"), state["next"].alias("at"), jump.alias("next"))).otherwise(state)

    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(max(1, shards), 6 + 3 * shards.bit_length()))), start, step)
    rest = lambda s: F.when(s["next"] < shards, F.aggregate(F.sequence(F.lit(1), F.lit(max(1, shards))), s, step)).otherwise(s)
    return F.element_at(F.transform(F.array(first), rest), 1)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long key among ``shards``; a null key counts as 0."""
    return jumps(key, shards)["at"].cast("int")


def assign_shards(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row.

    ``size`` is the text's UTF-8 bytes plus 8, ``text_crc32`` its unsigned CRC-32;
    a null text counts as empty. The law is ``key``: the key and the shard count
    decide alone. Integer keys are hashed as they are, others by their 64-bit hash,
    a null key as 0. ``grown_shard`` is the shard if one more is appended. ``slot``
    numbers each shard's rows from 0 without gaps, in an order of parts of a hash of
    key and text and keys therein, so that a key that stands in many rows is no part of
    its own; rows alike in key, size and text may swap slots. With
    ``keep`` all other columns stay, but for those with the names above; without,
    they are not read. No rows give none."""
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = (lambda: F.col(key).cast("long")) if whole else (lambda: F.when(F.col(key).isNotNull(), F.xxhash64(key)))
    part = F.pmod(F.xxhash64(F.lit(11), F.col(key), F.col(text)), F.lit(PARTS)).cast("int")
    keys = docs.select(jump_hash(number(), shards).alias("shard"), part.alias("part"))
    # shards * PARTS rows at most, whatever the table's size
    counts = keys.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    body = F.coalesce(F.col(text), F.lit(""))
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rest = [F.col(c) for c in docs.columns if c != key and c not in added] if keep else []
    rows = docs.select(key, *rest, (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"), jumps(number(), shards).alias("_jump"), part.alias("part"))
    # with one more shard a key moves only if its next jump ends there
    grown = F.when(F.col("_jump.next") == shards, F.lit(shards)).otherwise(F.col("_jump.at")).cast("int")
    rows = rows.withColumns({"shard": F.col("_jump.at").cast("int"), "grown_shard": grown}).drop("_jump")
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy(key, "size", "text_crc32")) - 1
    numbered = rows.withColumn("rank", rank.cast("long")).join(F.broadcast(offsets), ["shard", "part"])
    return numbered.select(key, *rest, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank")).alias("slot"), "grown_shard")
