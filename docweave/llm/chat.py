"""Chat formatting of reply trees, in DataFrame functions only.

Messages point at the message they answer. Iterative self-joins double the reach of
every message's ancestor link, summing scores on the way, so a tree of depth d takes
log2(d) rounds on narrow rows. A tree's leaves are ranked by the mean score of their
branches; the chosen leaves walk the same links back to list their paths, every
ancestor once. Only then do texts join, and each path becomes one conversation.

Control strings in texts are escaped with a backslash, which a single pass undoes;
the mask lists the spans of assistant texts in the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm._shared import Tables

# The template's marks, and strings that other templates mark turns with.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"<(?=\||/?s>|</?SYS>>|/?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """The text with backslashes doubled and one put behind the first character of
    each control string, so that none is left."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def branches(messages: DataFrame, tables: Tables, *, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, position) of the ``best`` branches of each tree of
    messages(tree, node, parent, score): mean score, then length, then leaf decide.

    A message whose parent is null or missing is a root. Messages on a cycle or
    below one belong to no branch. A node that comes twice in a tree must not."""
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    level = messages.select("tree", "node", "parent", "score").join(known.withColumnsRenamed({"tree": "t", "parent": "m"}), F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m")), "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("n"))
    level = tables.keep(level, "level-0")
    total = level.count()
    levels = [level]
    moving = (F.col("up").isNotNull()) & (F.col("n") <= total)
    while not levels[-1].where(moving).isEmpty():
        here = levels[-1]
        above = here.select(F.col("tree").alias("t"), F.col("node").alias("m"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("n").alias("n2"))
        going = here.where(moving).join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m")))
        doubled = going.select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n"))
        levels.append(tables.keep(doubled.unionByName(here.where(~moving)), f"level-{len(levels)}"))
    parents = levels[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("m")).distinct()
    leaves = levels[-1].where("up is null").join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("m")), "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), F.desc("n"), "node")
    path = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("n") - 1).alias("position"))
    path = tables.keep(path, f"path-{len(levels)}")
    for k in range(len(levels) - 2, -1, -1):
        jump = levels[k].where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("m"), "up")
        further = path.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("m")))
        reached = further.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        path = tables.keep(path.unionByName(reached), f"path-{k}")
    return path


def format_conversations(messages: DataFrame, *, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, mask) for each chosen branch of
    messages(tree, node, parent, role, text, score).

    ``formatted`` is, for each turn, START role MIDDLE text END with both escaped;
    ``mask`` lists (start, length) in code points of the escaped texts of the role
    ``assistant``. Null texts and roles count as empty; a null tree is a tree of its
    own; columns of other names are not read. No messages give no rows."""
    tables = Tables(messages.sparkSession, "chat")
    messages = messages.select("tree", "node", "parent", "role", "text", F.col("score").cast("double").alias("score"))
    path = branches(messages, tables, best=best)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    bodies = messages.select(F.col("tree").alias("t"), F.col("node").alias("m"), escape(role).alias("r"), escape(text).alias("x"), (role == "assistant").alias("own"))
    turns = path.join(bodies, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("m")))
    piece = F.concat(F.lit(START), F.col("r"), F.lit(MIDDLE), F.col("x"), F.lit(END))
    behind = W.partitionBy("tree", "leaf", "rank").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    placed = turns.withColumn("piece", piece).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(behind), F.lit(0)))
    start = F.col("before") + len(START) + F.length("r") + len(MIDDLE)
    span = F.when(F.col("own"), F.struct(start.cast("long").alias("start"), F.length("x").cast("long").alias("length")))
    rows = placed.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("position", "piece", span.alias("span")))).alias("turns"))
    return rows.select(
        "tree",
        "leaf",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    bodies = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"\Q" + MIDDLE + r"\E", -1))
    return F.transform(bodies, lambda b: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), unescape(F.get(b, F.lit(1))).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def chains(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as messages: each turn answers the one before it, in order of
    turn (nulls first), role and text. Repeated rows are turns of their own. The
    score of a message is the logarithm of its length."""
    order = W.partitionBy(conv_id).orderBy(turn, role, text)
    numbered = rows.select(F.col(conv_id).alias("tree"), F.row_number().over(order).cast("long").alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.log1p(F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("score"))


def chat_digest(rows: DataFrame, *, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of
    every conversation, read back from its formatted string and mask."""
    done = format_conversations(chains(rows, conv_id=conv_id))
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.select(F.col("tree").alias(conv_id), F.size(turns).cast("long").alias("n_turns"), said.alias("said"), read_loss(F.col("formatted"), F.col("mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(conv_id, "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
