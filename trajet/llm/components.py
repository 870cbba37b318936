"""Connected components on Spark: minimum labels with pointer jumping, cut to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, label): the smallest node reachable. Nodes without an edge are absent.

    A round gives each node the least label around it (an aggregate, so a hub costs one row per task) and then its
    label's label; the number of rounds grows with the logarithm of the longest chain.
    """
    both = cut(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("around"))
        nearer = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "around").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        # every label is a node, so the join keeps all rows
        fresh = cut(nearer.join(up, "near").select("node", F.least("near", "far").alias("new"), "label"))
        changed = fresh.filter("new <> label").limit(1).count()
        labels = fresh.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
