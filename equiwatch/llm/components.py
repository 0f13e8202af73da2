"""Connected components of a graph whose edges are rows, by min-label propagation with shortcuts.

Each round gives a node the least label among its own and its neighbours', then
the label of that label.  Rounds are joins and partial aggregates over the edges;
every round is checkpointed, so lost executors cost one round, and the driver
only reads how many labels changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node with an edge; the label is the least node it reaches."""
    both = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
                       .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")).where("u <> v")).distinct())
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
                         .select("node", F.least("node", "least").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("_l")), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("_l").alias("_near")))
        hop = labels.join(near, "node").select("node", F.col("label").alias("_old"),
                                               F.least("label", "_near").alias("label"))
        target = hop.select(F.col("node").alias("label"), F.col("label").alias("_further"))
        new = materialize(hop.join(target, "label", "left").select(
            "node", "_old", F.least("label", F.coalesce("_further", "label")).alias("label")))
        changed = new.where(F.col("_old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
