"""Connected components of an edge table by label propagation with pointer jumping; every step is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node that can be reached. Isolated nodes aren't in it."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near").where("node != near").distinct())
    labels = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("label"))
    labels = materialize(labels)
    while True:
        of_near = labels.select(F.col("node").alias("near"), F.col("label").alias("seen"))
        best = both.join(of_near, "near").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(best, "node").select("node", "label", F.least("label", "seen").alias("next"))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        moved = materialize(lower.join(jump, "next").select("node", "label", F.least("next", "beyond").alias("next")))
        changed = moved.where("next != label").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
