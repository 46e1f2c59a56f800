"""Connected components: contraction to a forest, then label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import never_sent, outgrows
from docquarry.session import materialize

# Bytes of a node and its label in a table that the driver sends.
_LABEL_BYTES = 48


def _propagated(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` for every node of the ``a``-``b`` edges.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so
    long chains shrink fast. Only minima per node are gathered, never lists of neighbours. Labels are
    written to the shared folder every round, which also cuts the lineage. Many labels are never sent.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("component")))
    large = outgrows(labels, F.lit(_LABEL_BYTES))
    while True:
        labels = never_sent(labels) if large else labels
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        after = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        moved = materialize(hooked.join(after, "label").select("node", "old", F.least("label", "next").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of the ``a``-``b`` edges.

    Every node's edge to its smallest neighbour makes a forest, whose trees are labelled first. All edges are
    then read once more, and only those that lead from one tree to another go into further rounds.
    """
    every = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    trees = _propagated(every.groupBy("b").agg(F.min("a").alias("a")))
    trees = never_sent(trees) if outgrows(trees, F.lit(_LABEL_BYTES)) else trees

    def label(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
        known = labels.select(F.col("node").alias(column), F.col("component").alias("_label"))
        return df.join(known, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")

    between = label(label(every, "a", trees, "x"), "b", trees, "y").where("x <> y")
    joined = materialize(between.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    placed = label(every.select(F.col("a").alias("node")).union(every.select("b")).distinct(), "node", trees, "tree")
    if joined.isEmpty():
        return placed.select("node", F.col("tree").alias("component"))
    merged = _propagated(joined)
    merged = never_sent(merged) if outgrows(merged, F.lit(_LABEL_BYTES)) else merged
    return label(placed, "tree", merged, "component").select("node", "component")
