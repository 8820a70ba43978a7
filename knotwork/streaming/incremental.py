"""Components of a growing graph: each micro-batch of edges is merged into the labels so far.

An addition to what the operators cover, as the graph there never changes.  The state is a
stored table of labels(id, component); a batch is lifted to components first, so that what is
contracted is as small as the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.contraction import star_contraction
from knotwork.plans import scratch


def merge_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(id, component) after adding edges(src, dst); new vertices join in."""
    fresh = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(labels, "id", "left_anti")
    known = labels.unionByName(fresh.withColumn("component", F.col("id")))
    a = known.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = known.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    lifted = edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst")
    tops = star_contraction(lifted).select(F.col("id").alias("component"), F.col("component").alias("top"))
    return scratch.table(known.join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "labels")


class Components:
    """Use ``on_batch`` with foreachBatch of a stream of edges(src, dst); ``labels`` is the latest state."""

    def __init__(self, labels: DataFrame):
        self.labels = labels
        self.seen = -1

    def on_batch(self, batch: DataFrame, epoch: int) -> None:
        if epoch > self.seen:  # a batch that is delivered again is already in
            self.labels = merge_edges(self.labels, batch.select("src", "dst"))
            self.seen = epoch
