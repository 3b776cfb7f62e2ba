"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, longs); the root is the component's smallest node.

    Every step takes the smallest label among the neighbours and then the label of that label,
    so chains shorten by halves.  Each step is written, which cuts the lineage; only a count of
    changed labels comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("to"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("next"))
        step = step.join(jump, "to").select("node", F.least("to", "next").alias("root"), "old")
        step = materialize(step, "labels")
        labels = step.select("node", "root")
        if step.where(F.col("root") != F.col("old")).isEmpty():
            return labels
