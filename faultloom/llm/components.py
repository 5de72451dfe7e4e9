"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round, a node takes the smallest label among its neighbours, then the label of its label; labels only
    fall, and the loop ends when none changed. Minima are folded before they are shuffled, so a node with very
    many neighbours is one row per task.
    """
    both = staged(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(
        edges.select(F.col("b"), F.col("a"))).where(F.col("id") != F.col("other")).distinct())
    labels = both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component"))
    while True:
        # The label of the label; every label is a node and so has a row.
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        # Dealt out by node again: most nodes may have one label, and their rows would stay where they met it.
        labels = staged(labels.join(up, "component").select("id", F.col("up").alias("component")).repartition("id"))
        near = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("near")), "other")
        best = near.groupBy("id").agg(F.min("near").alias("near"))
        lower = labels.join(best, "id").select(
            "id", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("fell"))
        labels = staged(lower)
        if labels.where("fell").isEmpty():
            # No neighbour has a lower label, so every component has one label; it is the component's smallest node.
            return labels.select("id", "component")
        labels = labels.select("id", "component")
