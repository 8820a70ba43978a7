"""Random graphs with a known number of components, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from knotwork.functions.hashing import below, below_sql
from knotwork.plans.graphs import Graph, vertex_range


def _checked(vertices: int, components: int) -> int:
    if not 0 < components <= vertices:
        raise ValueError("components must lie between 1 and the number of vertices")
    return vertices // components  # vertices of a block


def _surplus(vertices: int, components: int, edges_per_vertex: int) -> int:
    return max(0, vertices * edges_per_vertex // 2 - (vertices - components))


def gen_blocks(spark: SparkSession, vertices: int, components: int, edges_per_vertex: int, seed: int = 1) -> Graph:
    """``components`` blocks of ids, the last one with what is left over.  Each is joined by a random
    tree; further edges inside random blocks make up vertices * edges_per_vertex / 2 in all, if
    the trees alone are fewer.  Edges are drawn independently from their numbers, so any
    partitioning gives the same graph."""
    size = _checked(vertices, components)
    head, width = (f"least(%s div {size}, {components - 1}) * {size}", f"(CASE WHEN %s div {size} >= {components - 1} THEN {vertices - (components - 1) * size} ELSE {size} END)")
    tree = vertex_range(spark, vertices).selectExpr("id", f"{head % 'id'} AS head").where("id > head")
    tree = tree.select(F.col("id").alias("src"), (F.col("head") + below("id", "id - head", seed)).alias("dst"))
    drawn = spark.range(_surplus(vertices, components, edges_per_vertex)).select("id", below("id", str(vertices), seed + 2).alias("u"))
    placed = drawn.selectExpr("id", "u", f"{head % 'u'} AS head", f"{width % 'u'} AS width").where("width > 1")
    extra = placed.select(F.col("u").alias("src"), (F.col("head") + (F.col("u") - F.col("head") + 1 + below("id", "width - 1", seed + 1)) % F.col("width")).alias("dst"))
    return Graph(vertex_range(spark, vertices), tree.unionByName(extra))


def gen_blocks_sql(vertices: str, components: int, edges_per_vertex: int, seed: int = 1) -> str:
    """The same edges in SQL; ``vertices`` is a scalar subquery."""
    return f"""WITH n AS (SELECT {vertices} AS n, {vertices} // {components} AS size),
v AS (SELECT id, least(id // size, {components - 1}) * size AS head FROM n, (SELECT unnest(range(0, {vertices})) AS id)),
x AS (SELECT i, {below_sql('i', 'n', seed + 2)} AS u, n, size FROM n, (SELECT unnest(range(0, greatest(0, {vertices} * {edges_per_vertex} // 2 - ({vertices} - {components})))) AS i)),
w AS (SELECT i, u, least(u // size, {components - 1}) * size AS head, CASE WHEN u // size >= {components - 1} THEN n - {components - 1} * size ELSE size END AS width FROM x)
SELECT id AS src, head + {below_sql('id', 'id - head', seed)} AS dst FROM v WHERE id > head
UNION ALL SELECT u, head + (u - head + 1 + {below_sql('i', 'width - 1', seed + 1)}) % width FROM w WHERE width > 1"""
