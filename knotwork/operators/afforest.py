"""Afforest: join most vertices by a sample of edges, then spare the giant component the rest.

Round 1 links each vertex with its first ``rounds`` neighbours.  The most frequent label is then
the giant component, and the remaining edges are looked at only from vertices outside it: an
edge that leaves the giant is seen from its other end, as adjacency is symmetric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.contraction import components
from knotwork.operators.structure import first_neighbors
from knotwork.plans import scratch
from knotwork.plans.fixpoint import Result
from knotwork.plans.graphs import Graph


def _labels(vertices: DataFrame, found: DataFrame) -> DataFrame:
    return vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def giant(labels: DataFrame) -> int | None:
    """The most frequent label, ties to the smallest; one number."""
    sizes = labels.groupBy("component").count()
    top = sizes.agg(F.max(F.struct("count", (-F.col("component")).alias("c"))).alias("m")).first()["m"]
    return None if top is None else -top["c"]


def afforest(graph: Graph, rounds: int = 2) -> Result:
    rounds = rounds if rounds > 0 else 2
    links = scratch.checkpoint(graph.symmetric().distinct())
    sampled = components(first_neighbors(links, rounds).select("src", "dst"))
    labels = scratch.checkpoint(_labels(graph.vertices, sampled))
    most = giant(labels)
    if most is None:
        return Result(labels, rounds + 1)
    own = labels.select(F.col("id").alias("src"), F.col("component").alias("a"))
    other = labels.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    rest = links.join(own.where(F.col("a") != most), "src").join(other, "dst").where("a <> b")
    joined = components(rest.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    final = joined.select(F.col("id").alias("component"), F.col("component").alias("top"))
    return Result(labels.join(final, "component", "left").select("id", F.coalesce("top", "component").alias("component")), rounds + 1)
