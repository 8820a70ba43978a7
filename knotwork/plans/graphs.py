"""Graphs as DataFrames.

vertices(id), canonical edges (src < dst), symmetric edges (both directions), labels(id,
component).  All ids are BIGINT.  Loops are dropped; repeated edges stay unless asked otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SQL = {
    "part_supp": "SELECT DISTINCT l_partkey*2 AS a, l_suppkey*2+1 AS b FROM lineitem WHERE l_quantity>=49 AND l_returnflag='R'",
    "order_part": "SELECT DISTINCT l_orderkey*2 AS a, l_partkey*2+1 AS b FROM lineitem WHERE l_quantity>=45 AND l_returnflag='R'",
    "part_pair": "SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_linenumber=1 AND y.l_linenumber=2 AND x.l_quantity>40 AND y.l_quantity>40 AND x.l_partkey<>y.l_partkey",
    "event_chain": "SELECT p AS a, event_id AS b FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) AS g WHERE gap <= INTERVAL 12 HOUR",
}


class BadGraph(ValueError):
    """An edge has a null end, or one outside the vertices."""


@dataclass
class Graph:
    """vertices(id) and edges(src, dst): one row for each undirected edge, as given, without loops."""

    vertices: DataFrame
    edges: DataFrame

    def symmetric(self) -> DataFrame:
        return symmetrize(self.edges)


def vertex_range(spark: SparkSession, n: int) -> DataFrame:
    if n <= 0:
        raise BadGraph("a graph needs a vertex at least")
    return spark.range(n).select(F.col("id").cast("long"))


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) as long, loops dropped; repeated edges stay and count."""
    named = edges.select(F.col(edges.columns[0]).cast("long").alias("src"), F.col(edges.columns[1]).cast("long").alias("dst"))
    return named.where("src <> dst")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, in one pass over the edges."""
    ways = F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d")))
    return edges.select(F.explode(ways).alias("e")).select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"))


def edges_once(edges: DataFrame) -> DataFrame:
    """Every undirected edge once, smaller end first, without repeats."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def build(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
    """A graph of edges (their first two columns); without vertices, of the vertices with an edge.
    Null ends, and ends that are not among the vertices, are errors."""
    first, second = (F.col(c) for c in edges.columns[:2])
    if edges.where(first.isNull() | second.isNull()).limit(1).count():
        raise BadGraph("an edge has a null end")
    plain = undirected(edges)
    if vertices is None:
        return Graph(ends(plain), plain)
    every = vertices.select(F.col("id").cast("long").alias("id"))
    if ends(edges.select(first.cast("long").alias("src"), second.cast("long").alias("dst"))).join(every, "id", "left_anti").limit(1).count():
        raise BadGraph("an edge ends outside the vertices")
    return Graph(every, plain)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Edges (src, dst) of a graph derived from the tables, by EDGE_SQL."""
    if name == "event_chain":
        events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
        sql, views = EDGE_SQL[name].replace("FROM events", "FROM {events}"), {"events": events}
    else:
        items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
        sql, views = EDGE_SQL[name].replace("FROM lineitem", "FROM {lineitem}").replace("JOIN lineitem", "JOIN {lineitem}"), {"lineitem": items}
    return undirected(spark.sql(sql, **views))


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All vertices that the graph could have, those without an edge too."""
    read = lambda t, c, k, o: table(spark, sf_dir, t).select((F.col(c) * k + o).cast("long").alias("id"))
    if name == "part_supp":
        return read("part", "p_partkey", 2, 0).unionByName(read("supplier", "s_suppkey", 2, 1))
    if name == "order_part":
        return read("orders", "o_orderkey", 2, 0).unionByName(read("part", "p_partkey", 2, 1))
    if name == "part_pair":
        return read("part", "p_partkey", 1, 0)
    return read("events", "event_id", 1, 0)
