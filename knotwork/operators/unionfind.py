"""Union-find inside partitions, merged across them.

Each task reduces its edges to a star forest (never more rows than vertices), so what is merged
shrinks with every level.  The merge ends in root resolution with the smallest ids as labels.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.contraction import components, star_contraction
from knotwork.plans import forests, scratch
from knotwork.plans.fixpoint import Result
from knotwork.plans.graphs import Graph, edges_once

ONE_TASK_ROWS = 2_000_000  # forest edges that a single task may hold, 32 MB; beyond that they are contracted
FAN_IN = 8  # forests that a task merges


def _all(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    return vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def partitioned(graph: Graph, partitions: int | None = None) -> Result:
    """Forests of the edges where they lie, then by ranges of vertices (as many as the session shuffles
    to, if not given), then the boundary between the ranges: in one task if little is left of it,
    else by star contraction."""
    began = time.perf_counter()
    local = scratch.checkpoint(forests.forest(graph.edges))
    reduced = time.perf_counter()
    ranged = local.repartitionByRange(partitions, "src") if partitions else local.repartitionByRange("src")
    labels = components(forests.forest(ranged))
    scratch.drop(local)
    return Result(_all(graph.vertices, labels), 1, {"local": reduced - began, "exchange": time.perf_counter() - reduced})


def _merged(edges: DataFrame, partitions: int | None) -> DataFrame:
    """Forest of forests: edges are reduced where they lie (or in ``partitions``), and ``FAN_IN`` forests
    become one until a task holds the last."""
    state = scratch.checkpoint(forests.forest(edges.repartition(partitions) if partitions else edges))
    left = state.rdd.getNumPartitions()
    while left > 1:
        if state.count() > ONE_TASK_ROWS:
            return star_contraction(state)
        left = -(-left // FAN_IN)
        before, state = state, scratch.checkpoint(forests.forest(state.coalesce(left)))
        scratch.drop(before)
    roots = state.select(F.col("dst").alias("id")).distinct().withColumn("component", F.col("id"))
    return state.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)


def tree_merge(graph: Graph, partitions: int | None = None) -> Result:
    return Result(_all(graph.vertices, _merged(graph.edges, partitions)), 1)


def edge_once(graph: Graph, partitions: int | None = None) -> Result:
    """Every undirected edge is looked at once, smaller end first; repeats go before the shuffle."""
    return Result(_all(graph.vertices, _merged(edges_once(graph.edges), partitions)), 1)
