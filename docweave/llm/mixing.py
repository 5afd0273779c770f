"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

The rates nearest to a common prior in relative entropy, under the constraint that
a source's tokens meet its target, are exponentially tilted: a document of size x
is taken min(cap, prior * exp(t * x / mean)) times, with one t a source. Newton's
method on the convex dual finds all t side by side; every step is one aggregation
over the histogram (source, size, documents), as documents alike in both have equal
rates. Sums are exact decimals, so reruns agree to the last copy.

Rates become copies without chance: along a source's sizes, from large to small,
running totals of rates are rounded, which keeps a source within one large document
of its target, and the rest is made up by single documents that fit. Documents of a
class take turns in an order of a hash; no step sorts a class or source in one task.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm._shared import Tables

# Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all tokens that the mix takes, and times that a document is taken at most.
SHARE, CAP = 1.5, 2
#: The relative gap that ends the Newton steps, or the interval of tilts that does.
GAP, NARROW = 1e-9, 1e-13
#: Newton steps before intervals are also halved.
PATIENCE = 24
SALTS = 256
#: Rates are rounded to whole multiples of 2**-30, so that sums are exact.
_UNIT = float(1 << 30)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size). Each target is
    min(cap * source_size, level * weight) at the one level where targets sum to
    the share: what resharing every excess by weight comes to."""
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * float(cap)
    ranked = sizes.withColumn("w", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("w"))
    everything = W.partitionBy()
    along = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * float(share)
    full = F.coalesce(F.sum("limit").over(along), F.lit(0.0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(along), F.lit(0.0))
    level = ranked.withColumn("level", (total - full) / rest)
    reached = F.max("level").over(everything)  # levels rise until the first source that is not full, then fall
    return level.withColumn("l", reached).select("source", "source_size", F.least("limit", F.coalesce(F.col("l") * F.col("w"), F.col("limit"))).alias("target"))


def _rate(tilt: Column, x: Column, prior: float, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.lit(prior) * F.exp(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), tilt * x))))


def _sum(x: Column) -> Column:
    return F.sum(F.round(x * _UNIT).cast("decimal(28,0)")).cast("double") / _UNIT


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def tilts(classes: DataFrame, goals: DataFrame, tables: Tables, prior: float, cap: float) -> DataFrame:
    """(source, source_size, target, mean, tilt) from classes(source, size, n): a safeguarded Newton
    iteration a source, all sources in one aggregation a step."""
    means = classes.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = goals.join(means.withColumnRenamed("source", "s"), _same("source", "s"), "left").drop("s")
    state = state.select("source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"), (F.col("target") >= cap * F.col("source_size")).alias("done"))
    state = tables.keep(state.withColumn("tilt", F.when(F.col("done"), 60.0).otherwise(0.0)), "state-0")
    used = classes.where("size > 0").withColumnRenamed("source", "s")
    for step in count():
        if state.where("not done").isEmpty():
            return state.select("source", "source_size", "target", "mean", "tilt")
        joined = used.join(state.where("not done"), _same("s", "source"))
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), x, prior, cap)
        sums = joined.groupBy("s").agg(_sum(F.col("n") * F.col("size") * rate).alias("got"), _sum(F.when(rate < cap, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        moved = state.join(sums, _same("source", "s"), "left").drop("s").withColumn("gap", gap)
        close = F.abs(F.col("gap")) <= GAP * F.greatest(F.col("target"), F.lit(1.0))
        lo, hi = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("hi"))
        moved = moved.withColumns({"done": F.col("done") | F.coalesce(close, F.lit(True)), "lo": F.coalesce(lo, "lo"), "hi": F.coalesce(hi, "hi")})
        newton = F.col("tilt") - F.col("gap") / F.greatest(F.col("slope"), F.lit(1e-300))
        # halving every other time ends what Newton steps creep along
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & F.lit(step < PATIENCE or step % 2 == 0)
        narrow = F.col("hi") - F.col("lo") <= NARROW
        following = F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = tables.keep(moved.withColumns({"tilt": following, "done": F.col("done") | narrow}).select("source", "source_size", "target", "mean", "tilt", "lo", "hi", "done"), f"state-{step + 1}")


def _repaired(plan: DataFrame, goals: DataFrame, tables: Tables, cap: int) -> DataFrame:
    """plan(source, size, n, copies) with single documents added or left out, a
    source's largest that fits its gap first, until nothing fits: every turn leaves a
    smaller gap."""
    for turn in count():
        taken = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
        gaps = goals.select(F.col("source").alias("s"), "target").join(taken, _same("s", "source")).select("s", (F.col("target") - F.col("taken")).alias("gap"))
        at = plan.join(gaps, _same("source", "s"))
        room = F.when(F.col("gap") > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0)
        # a document that leaves a smaller gap than it found fits
        fits = room & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")) & (F.abs("gap") >= 1)
        best = at.where(fits).groupBy(F.col("source").alias("b")).agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("miss"), F.col("size").alias("size"), F.signum("gap").cast("long").alias("sign"))).alias("best"))
        best = tables.keep(best.select("b", F.col("best.size").alias("bs"), F.col("best.sign").alias("sign")), f"repair-{turn}")
        if best.isEmpty():
            return plan
        changed = plan.join(best, _same("source", "b") & (F.col("size") == F.col("bs")), "left")
        plan = tables.keep(changed.select("source", "size", "n", (F.col("copies") + F.coalesce("sign", F.lit(0))).alias("copies")), f"plan-{turn + 1}")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for each row of ``docs``.

    Sizes are counts of words; a null text has none and is not taken. Sources stand
    in code point order with null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``cap`` times its source, and what
    is over is reshared. ``copies`` is 0 to ``cap``, ``taken`` is copies * size.
    Repeated rows are documents of their own; rows alike in id, source and size may
    swap copies. Ties between documents of a size go by a hash of id and text, then by
    id. A text of any length is one size. Other columns are not read. No rows give none."""
    rows, parts = _planned(docs, doc_id, source, text, share, cap, weights)
    found = _assigned(rows, parts, doc_id)
    return found.select(doc_id, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix: every row of ``docs`` as often as :func:`mix` takes it, with its
    columns."""
    columns = docs.columns
    _, parts = _planned(docs, doc_id, source, text, share, cap, weights)
    rows = docs.select(F.struct(*columns).alias("row"), F.col(doc_id).alias("_id"), F.col(source).alias("source"), token_count(F.col(text)).alias("size"), _salt(doc_id, text).alias("salt"))
    found = _assigned(rows, parts, "_id").where("copies > 0")
    return found.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def _salt(doc_id: str, text: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), F.col(doc_id), F.col(text)), F.lit(SALTS)).cast("int")


def _assigned(rows: DataFrame, parts: DataFrame, doc_id: str) -> DataFrame:
    """rows(source, size, salt, ...) with ``copies``, source_size and target."""
    rank = F.row_number().over(W.partitionBy("source", "size", "salt").orderBy(doc_id))
    found = rows.withColumn("rank", rank).join(parts, _same("source", "p") & (F.col("size") == F.col("q")) & (F.col("salt") == F.col("r")))
    return found.withColumn("copies", F.col("base") + (F.col("rank") <= F.col("first")).cast("int"))


def _planned(docs: DataFrame, doc_id: str, source: str, text: str, share: float, cap: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The narrow table (id, source, size, salt), and for each (source, size, salt)
    how many copies its documents get and how many get one more."""
    tables = Tables(docs.sparkSession, "mixing")
    sizes = tables.keep(docs.select(doc_id, F.col(source).alias("source"), token_count(F.col(text)).alias("size"), _salt(doc_id, text).alias("salt")), "sizes")
    salted = tables.keep(sizes.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("m")), "salted")
    classes = tables.keep(salted.groupBy("source", "size").agg(F.sum("m").alias("n")), "classes")
    goals = tables.keep(targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, cap, weights), "goals")
    tilted = tilts(classes, goals, tables, share, cap).select(F.col("source").alias("s"), "mean", "tilt")
    rate = F.round(_rate(F.col("tilt"), F.col("size") / F.col("mean"), share, cap) * _UNIT).cast("decimal(28,0)") * F.col("n")
    falling = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    reached = classes.join(tilted, _same("source", "s")).where("size > 0").withColumn("reached", F.floor(F.sum(rate).over(falling).cast("double") / _UNIT + 0.5).cast("long"))
    copies = F.col("reached") - F.coalesce(F.lag("reached").over(W.partitionBy("source").orderBy(F.desc("size"))), F.lit(0))
    plan = tables.keep(reached.select("source", "size", "n", F.least(F.col("n") * cap, F.greatest(copies, F.lit(0))).alias("copies")), "plan-0")
    plan = _repaired(plan, goals, tables, cap)
    # each salted part of a class learns how many of its documents are among the first
    before = F.coalesce(F.sum("m").over(W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", F.col("copies").alias("c"))
    parts = salted.withColumn("before", before).join(named, _same("source", "s") & (F.col("size") == F.col("z")), "left")
    parts = parts.join(goals.withColumnsRenamed({"source": "g"}), _same("source", "g"))
    base, extra = F.floor(F.col("c") / F.col("n")), F.col("c") % F.col("n")
    parts = parts.select(F.col("source").alias("p"), F.col("size").alias("q"), F.col("salt").alias("r"), "source_size", "target", F.coalesce(base, F.lit(0)).cast("int").alias("base"), F.coalesce(extra - F.col("before"), F.lit(0)).alias("first"))
    return sizes, tables.keep(parts, "parts")
