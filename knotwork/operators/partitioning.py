"""Block partitions of a graph and what crosses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.plans.graphs import Graph


def block_owner(vertex: Column, vertices: int, blocks: int) -> Column:
    """The block of a vertex: equal ranges of ids, the last one with what is left over."""
    size = max(1, vertices // blocks)
    return F.least(F.floor(vertex / size), F.lit(blocks - 1)).cast("int")


def owners(graph: Graph, vertices: int, blocks: int) -> DataFrame:
    return graph.vertices.select("id", block_owner(F.col("id"), vertices, blocks).alias("block"))


def _crossing(graph: Graph, vertices: int, blocks: int) -> DataFrame:
    both = graph.symmetric().withColumn("block", block_owner(F.col("src"), vertices, blocks))
    return both.where(F.col("block") != block_owner(F.col("dst"), vertices, blocks))


def ghost_vertices(graph: Graph, vertices: int, blocks: int) -> DataFrame:
    """(block, id): vertices of other blocks that a block has an edge to."""
    return _crossing(graph, vertices, blocks).select("block", F.col("dst").alias("id")).distinct()


def boundary_vertices(graph: Graph, vertices: int, blocks: int) -> DataFrame:
    """(id, block): vertices with a neighbour in another block."""
    return _crossing(graph, vertices, blocks).select(F.col("src").alias("id"), "block").distinct()


def ghost_labels(ghosts: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, id, component): a block's view of the labels that it does not own."""
    return ghosts.join(labels, "id").select("block", "id", "component")
