"""Connected components on DataFrames: smallest label with pointer jumping, nothing collected but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Each round takes the smallest label around every node and then that label's own label, so that the
    number of rounds grows with the logarithm of the longest chain in all but contrived graphs; it ends
    when no label changes.  Rounds are written to the shared folder.

    A hub's edges, or a label that many nodes have, are one key of a join, of which the other side has one row: adaptive
    execution splits such keys over tasks.  The smallest labels around a node are merged before they are shuffled.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialize(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = step.where("label <> old").limit(1).count()
        discard(labels)
        labels = step.select("node", "label")
        if not changed:
            discard(both)
            return labels
