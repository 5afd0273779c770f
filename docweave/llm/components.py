"""Connected components of a distributed graph by repeated contraction.

In each round every node hooks onto the smallest node within two steps, the edges
are rewritten to the hooked ends, and loops and repeats go: a star is one node
after a round. Where ids are in no order along the edges, the graph shrinks by a
constant factor a round in expectation, so chains as long as the graph take a
logarithmic number of rounds. Nothing but one count a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._shared import Tables


def connected_components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, label) for every node of ``edges(a long, b long)`` that has another
    one for a neighbour; nodes of one component share a label, which is one of them.
    An empty edge table gives none.
    """
    graph = tables.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-graph-0")
    hooks: list[DataFrame] = []
    while not graph.isEmpty():
        turn = len(hooks)
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
        two = both.join(one.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("to"))
        hooks.append(tables.keep(two, f"{name}-hooks-{turn}"))
        moved = graph.join(_renamed(hooks[-1], "a", "p"), "a").join(_renamed(hooks[-1], "b", "q"), "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        graph = tables.keep(moved.where("a <> b").distinct(), f"{name}-graph-{turn + 1}")
        tables.drop(f"{name}-graph-{turn}")
    if not hooks:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = hooks[0].select("node", F.col("to").alias("label"))
    for step in hooks[1:]:
        labels = labels.join(_renamed(step, "label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return tables.keep(labels, f"{name}-labels") if len(hooks) > 1 else labels


def _renamed(hooks: DataFrame, node: str, to: str) -> DataFrame:
    return hooks.select(F.col("node").alias(node), F.col("to").alias(to))
