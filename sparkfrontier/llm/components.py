"""Connected components by label propagation with pointer jumping, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfrontier.llm.common import stage_out


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) -> (node, label): label is the smallest node of the component. Nodes without an edge aren't in it."""
    both = stage_out(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = stage_out(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        lower = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stage_out(lower.join(jump, "label").select("node", F.least("label", "next").alias("label")), f"{name}-labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
