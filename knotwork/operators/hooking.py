"""Hook and shortcut: roots hang themselves under smaller neighbouring roots, then all paths are
compressed.  A minimum per root stands where racing threads would write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.plans import scratch
from knotwork.plans.fixpoint import NotConverged, Result, settle
from knotwork.plans.graphs import Graph


def hook(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """parents(id, parent) after one hook: each root takes the smallest parent that an edge leads to,
    if that is below it.  edges(src, dst) are symmetric."""
    p = parents.select(F.col("id").alias("src"), F.col("parent").alias("p_src"))
    q = parents.select(F.col("id").alias("dst"), F.col("parent").alias("p_dst"))
    lower = edges.join(p, "src").join(q, "dst").where(F.col("p_src") < F.col("p_dst"))
    offer = lower.groupBy(F.col("p_dst").alias("id")).agg(F.min("p_src").alias("offer"))
    hung = F.when((F.col("parent") == F.col("id")) & F.col("offer").isNotNull(), F.col("offer")).otherwise(F.col("parent"))
    return parents.join(offer, "id", "left").select("id", hung.alias("parent"))


def jump(parents: DataFrame) -> DataFrame:
    """One pointer jump: parent becomes the parent's parent; ``changed`` says where that moved it."""
    up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("up"))
    return parents.join(up, "parent").select("id", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("changed"))


def compress(parents: DataFrame, cap: int = 64) -> DataFrame:
    """Jump until every parent is a root: log2 of the longest path many times."""
    return settle(jump, parents, cap)[0]


def hook_shortcut(graph: Graph, cap: int = 200) -> Result:
    """Contracted as it goes: edges inside a tree are dropped, the others are relabelled by their
    roots, so each round's edges are between roots only."""
    parents = scratch.checkpoint(graph.vertices.select("id", F.col("id").alias("parent")))
    edges = scratch.checkpoint(graph.symmetric().distinct())
    for n in range(1, cap + 1):
        if not edges.limit(1).count():
            return Result(parents.withColumnRenamed("parent", "component"), n)
        roots = edges.select(F.col("src").alias("id")).distinct().withColumn("parent", F.col("id"))
        trees = compress(hook(edges, roots))
        top = trees.select(F.col("id").alias("parent"), F.col("parent").alias("top"))
        old = parents, edges
        parents = scratch.checkpoint(parents.join(top, "parent", "left").select("id", F.coalesce("top", "parent").alias("parent")))
        a, b = trees.select(F.col("id").alias("src"), F.col("parent").alias("a")), trees.select(F.col("id").alias("dst"), F.col("parent").alias("b"))
        edges = scratch.checkpoint(edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        for frame in old:
            scratch.drop(frame)
    raise NotConverged(f"roots still hooked after {cap} rounds")
