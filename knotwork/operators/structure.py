"""Degrees, neighbours and the compressed row layout of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans.graphs import Graph


def vertex_degree(graph: Graph) -> DataFrame:
    """(id, degree), 0 for isolated vertices; repeated edges count."""
    degree = graph.symmetric().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.vertices.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_stats(graph: Graph) -> DataFrame:
    """One row: vertices, edges, average (to 2 decimals), smallest and largest degree."""
    d = vertex_degree(graph)
    return d.agg(
        F.count(F.lit(1)).alias("vertices"),
        (F.sum("degree") / 2).cast("long").alias("edges"),
        F.round(F.avg("degree"), 2).alias("avg_degree"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
    )


def neighbors_of(graph: Graph, vertex: int) -> DataFrame:
    """(neighbor) of one vertex, repeats included; the filter reaches the scan."""
    e = graph.edges
    out = e.where(F.col("src") == vertex).select(F.col("dst").alias("neighbor"))
    return out.unionByName(e.where(F.col("dst") == vertex).select(F.col("src").alias("neighbor")))


def first_neighbors(symmetric: DataFrame, count: int) -> DataFrame:
    """(src, dst, place): each vertex's ``count`` smallest neighbours, places from 1.  The bound on the
    place reaches the map side, so that of a hub's neighbours each task sends ``count`` at most."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return symmetric.select("src", "dst", place.alias("place")).where(F.col("place") <= count)


def nth_neighbor(graph: Graph, n: int) -> DataFrame:
    """(id, neighbor): the n-th neighbour, from 0, of vertices that have so many."""
    return first_neighbors(graph.symmetric(), n + 1).where(F.col("place") == n + 1).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))


def csr_row_ptr(graph: Graph, bins: int | None = None) -> DataFrame:
    """(id, row_start, degree): where each vertex's run of neighbours starts if all runs are laid out
    by id.  A running sum in two levels: inside ranges of ids, and over the ranges; as many
    ranges as leave about 65,536 ids to each, if not given."""
    d = vertex_degree(graph)
    top = graph.vertices.agg(F.max("id")).first()[0] or 0
    bins = bins or max(16, top >> 16)
    width = top // bins + 1
    binned = d.withColumn("bin", F.floor(F.col("id") / width))
    before = lambda *by: (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy
    heads = binned.groupBy("bin").agg(F.sum("degree").alias("s")).select("bin", F.coalesce(F.sum("s").over(before()("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("degree").over(before("bin")("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return binned.withColumn("inner", inner).join(F.broadcast(heads), "bin").select("id", (F.col("base") + F.col("inner")).cast("long").alias("row_start"), "degree")  # heads: at most ``bins`` rows


def adjacency(graph: Graph) -> DataFrame:
    """(id, neighbors) as ascending arrays, empty for isolated vertices; for inspection."""
    lists = graph.symmetric().groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
    return graph.vertices.join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))
