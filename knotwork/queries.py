"""The engine's queries over the driver's tables, and SQL for each of them.

Algorithm queries rotate over four derived graphs: one giant component and few small ones
(part_supp), many small ones (order_part), non-bipartite (part_pair), long paths (event_chain).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import summaries
from knotwork.operators import afforest, hooking, partitioning, propagation, structure, unionfind
from knotwork.operators.contraction import star_contraction
from knotwork.plans import graphs, scratch
from knotwork.plans.graphs import Graph
from knotwork.sources import generator, matrix_market, sinks

BLOCKS = 4
NEIGHBOR = 1  # from 0: the second neighbour


def _graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The derived graph, of the vertices that have an edge; its edges are stored once."""
    edges = scratch.checkpoint(graphs.fixture(spark, sf_dir, name))
    return Graph(graphs.ends(edges), edges)


def _full(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """The derived graph with all vertices of its domain, isolated ones included."""
    return Graph(graphs.domain(spark, sf_dir, name), graphs.fixture(spark, sf_dir, name))


def _span(spark: SparkSession, sf_dir: str) -> int:
    """Ids of part_supp lie below this: twice the larger table, plus the odd one."""
    rows = [graphs.table(spark, sf_dir, t).count() for t in ("part", "supplier")]
    return 2 * max(rows) + 1


def _labelled(run: Callable[[Graph], DataFrame], name: str):
    return lambda spark, sf_dir: run(_graph(spark, sf_dir, name))


def _contracted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return star_contraction(graphs.fixture(spark, sf_dir, name))


def _with_isolated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = _contracted(spark, sf_dir, name)
    return graphs.domain(spark, sf_dir, name).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _hook_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir, "order_part")
    start = g.vertices.select("id", F.col("id").alias("parent"))
    return hooking.hook(g.symmetric(), start)


def _pointer_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of events, each pointing to the one before it, compressed to their first event."""
    edges = graphs.fixture(spark, sf_dir, "event_chain")
    parents = graphs.ends(edges).join(edges.select(F.col("dst").alias("id"), F.col("src").alias("before")), "id", "left").select("id", F.coalesce("before", "id").alias("parent"))
    return hooking.compress(parents)


def _mtx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_supp written as a coordinate file, with comments, and scanned again."""
    path = f"{scratch.shared_folder(spark)}/knotwork-{uuid.uuid4().hex}/graph.mtx"
    matrix_market.write(Graph(None, graphs.fixture(spark, sf_dir, "part_supp")), _span(spark, sf_dir), path, ("parts and suppliers", "", "1 2 is no entry here"))
    header, edges = matrix_market.scan(spark, path)
    if not header.symmetric:
        raise matrix_market.BadFile(f"{path}: written as symmetric")
    return edges


def _labels_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of part_pair written as Parquet and read again."""
    path = f"{scratch.shared_folder(spark)}/knotwork-{uuid.uuid4().hex}/labels"
    sinks.write_labels(_contracted(spark, sf_dir, "part_pair"), path)
    return spark.read.parquet(path)


def _ghost_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir, "part_supp")
    return partitioning.ghost_labels(partitioning.ghost_vertices(g, _span(spark, sf_dir), BLOCKS), star_contraction(g.edges))


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "vertex_range": lambda s, d: graphs.vertex_range(s, graphs.table(s, d, "part").count()),
    "symmetrize": lambda s, d: graphs.symmetrize(graphs.fixture(s, d, "part_pair")),
    "edges_once": lambda s, d: graphs.edges_once(graphs.fixture(s, d, "part_pair")),
    "vertex_degree": lambda s, d: structure.vertex_degree(_full(s, d, "part_supp")),
    "graph_stats": lambda s, d: structure.graph_stats(_full(s, d, "order_part")),
    "neighbors_of": lambda s, d: structure.neighbors_of(_graph(s, d, "part_supp"), 1),
    "nth_neighbor": lambda s, d: structure.nth_neighbor(_graph(s, d, "part_supp"), NEIGHBOR),
    "csr_row_ptr": lambda s, d: structure.csr_row_ptr(_full(s, d, "part_pair")),
    "adjacency": lambda s, d: structure.adjacency(_full(s, d, "part_pair")).select("id", F.array_join("neighbors", ",").alias("neighbors")),
    "block_owner": lambda s, d: partitioning.owners(_graph(s, d, "part_supp"), _span(s, d), BLOCKS),
    "ghost_vertices": lambda s, d: partitioning.ghost_vertices(_graph(s, d, "part_supp"), _span(s, d), BLOCKS),
    "boundary_vertices": lambda s, d: partitioning.boundary_vertices(_graph(s, d, "part_supp"), _span(s, d), BLOCKS),
    "ghost_label_join": _ghost_labels,
    "component_count": lambda s, d: summaries.component_count(_with_isolated(s, d, "part_supp")),
    "component_sizes": lambda s, d: summaries.component_sizes(_contracted(s, d, "part_supp")),
    "component_size_stats": lambda s, d: summaries.component_size_stats(_with_isolated(s, d, "order_part")),
    "giant_component": lambda s, d: summaries.giant_component(_contracted(s, d, "part_supp")),
    "label_prop_sync": _labelled(lambda g: propagation.sync(g).labels, "part_supp"),
    "label_prop_full": _labelled(lambda g: propagation.full(g).labels, "order_part"),
    "label_prop_frontier": _labelled(lambda g: propagation.frontier(g).labels, "event_chain"),
    "label_prop_push_pull": _labelled(lambda g: propagation.push_pull(g).labels, "part_pair"),
    "label_prop_broadcast": _labelled(lambda g: propagation.broadcast(g).labels, "part_supp"),
    "label_prop_shuffle": _labelled(lambda g: propagation.shuffle(g).labels, "order_part"),
    "hook_step": _hook_step,
    "pointer_jump": _pointer_jump,
    "hook_shortcut": _labelled(lambda g: hooking.hook_shortcut(g).labels, "event_chain"),
    "star_contraction": lambda s, d: _contracted(s, d, "part_supp"),
    "union_find_partitioned": _labelled(lambda g: unionfind.partitioned(g).labels, "part_supp"),
    "union_find_edge_once": _labelled(lambda g: unionfind.edge_once(g).labels, "part_pair"),
    "union_find_tree_merge": _labelled(lambda g: unionfind.tree_merge(g).labels, "event_chain"),
    "afforest": _labelled(lambda g: afforest.afforest(g).labels, "part_supp"),
    "mtx_scan": _mtx_scan,
    "labels_sink": _labels_sink,
    "giant_sampled": lambda s, d: summaries.sampled_giant(_contracted(s, d, "order_part")),
    "gen_blocks": lambda s, d: generator.gen_blocks(s, graphs.table(s, d, "orders").count(), 50, 4, seed=7).edges,
    "gen_components": lambda s, d: summaries.component_sizes(unionfind.tree_merge(generator.gen_blocks(s, graphs.table(s, d, "orders").count(), 50, 4, seed=7)).labels),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.component_sizes(propagation.sync(_graph(spark, sf_dir, "part_supp")).labels)


# --- the same in DuckDB SQL ---------------------------------------------------------------

_DOMAIN = {
    "part_supp": "SELECT p_partkey*2 AS id FROM part UNION ALL SELECT s_suppkey*2+1 FROM supplier",
    "order_part": "SELECT o_orderkey*2 AS id FROM orders UNION ALL SELECT p_partkey*2+1 FROM part",
    "part_pair": "SELECT p_partkey AS id FROM part",
}


def _edges(name: str) -> str:
    return f"e0(a, b) AS ({graphs.EDGE_SQL[name]}), e AS (SELECT a AS src, b AS dst FROM e0 UNION ALL SELECT b, a FROM e0)"


def _cc(name: str, tail: str) -> str:
    return f"""WITH RECURSIVE {_edges(name)},
cc(node, label) USING KEY (node) AS (
  SELECT src, least(src, min(dst)) FROM e GROUP BY src
  UNION
  SELECT e.src, min(n.label) FROM cc n JOIN e ON e.dst = n.node JOIN recurring.cc o ON o.node = e.src
  GROUP BY e.src HAVING min(n.label) < min(o.label))
{tail}"""


def _labels_sql(name: str) -> str:
    return _cc(name, "SELECT node AS id, label AS component FROM cc")


def _isolated_sql(name: str) -> str:
    return f"SELECT v.id, coalesce(label, v.id) AS component FROM ({_DOMAIN[name]}) v LEFT JOIN cc ON node = v.id"


_CHAIN_FIRST = f"""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT event_id, user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
SELECT event_id AS id, first_value(event_id) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS parent FROM r
QUALIFY count(*) OVER (PARTITION BY user_id, run) > 1"""

_SPAN = "(SELECT 2 * greatest((SELECT count(*) FROM part), (SELECT count(*) FROM supplier)) + 1)"
_OWNER = lambda v: f"least({v} // greatest(1, {_SPAN} // {BLOCKS}), {BLOCKS - 1})::INTEGER"
_CROSSING = f"x AS (SELECT src, dst, {_OWNER('src')} AS block FROM e WHERE {_OWNER('src')} <> {_OWNER('dst')})"

ORACLE_SQL: dict[str, str] = {
    "vertex_range": "SELECT p_partkey AS id FROM part",
    "symmetrize": f"WITH {_edges('part_pair')} SELECT src, dst FROM e",
    "edges_once": f"WITH {_edges('part_pair')} SELECT DISTINCT src, dst FROM e WHERE src < dst",
    "vertex_degree": f"WITH {_edges('part_supp')} SELECT v.id, count(src)::BIGINT AS degree FROM ({_DOMAIN['part_supp']}) v LEFT JOIN e ON src = v.id GROUP BY v.id",
    "graph_stats": f"WITH {_edges('order_part')}, d AS (SELECT v.id, count(src)::BIGINT AS degree FROM ({_DOMAIN['order_part']}) v LEFT JOIN e ON src = v.id GROUP BY v.id) "
    "SELECT count(*) AS vertices, (sum(degree) // 2)::BIGINT AS edges, round(avg(degree), 2) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM d",
    "neighbors_of": f"WITH {_edges('part_supp')} SELECT dst AS neighbor FROM e WHERE src = 1",
    "nth_neighbor": f"WITH {_edges('part_supp')} SELECT src AS id, dst AS neighbor FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) = {NEIGHBOR + 1}",
    "csr_row_ptr": f"WITH {_edges('part_pair')}, d AS (SELECT v.id, count(src)::BIGINT AS degree FROM ({_DOMAIN['part_pair']}) v LEFT JOIN e ON src = v.id GROUP BY v.id) "
    "SELECT id, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS row_start, degree FROM d",
    "adjacency": f"WITH {_edges('part_pair')} SELECT v.id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS neighbors FROM ({_DOMAIN['part_pair']}) v LEFT JOIN e ON src = v.id GROUP BY v.id",
    "block_owner": f"WITH {_edges('part_supp')} SELECT DISTINCT src AS id, {_OWNER('src')} AS block FROM e",
    "ghost_vertices": f"WITH {_edges('part_supp')}, {_CROSSING} SELECT DISTINCT block, dst AS id FROM x",
    "boundary_vertices": f"WITH {_edges('part_supp')}, {_CROSSING} SELECT DISTINCT src AS id, block FROM x",
    "ghost_label_join": _cc("part_supp", f"SELECT DISTINCT block, dst AS id, label AS component FROM (SELECT src, dst, {_OWNER('src')} AS block FROM e WHERE {_OWNER('src')} <> {_OWNER('dst')}) x JOIN cc ON node = dst"),
    "component_count": _cc("part_supp", f"SELECT count(DISTINCT component) AS components FROM ({_isolated_sql('part_supp')})"),
    "component_sizes": _cc("part_supp", "SELECT label AS component, count(*) AS size FROM cc GROUP BY label"),
    "component_size_stats": _cc("order_part", f"SELECT count(*) AS components, min(size) AS min_size, max(size) AS max_size, round(avg(size), 2) AS avg_size FROM (SELECT component, count(*) AS size FROM ({_isolated_sql('order_part')}) GROUP BY component)"),
    "giant_component": _cc("part_supp", "SELECT label AS component, count(*) AS size, round(count(*) * 100 / (SELECT count(*) FROM cc), 2) AS percent FROM cc GROUP BY label ORDER BY size DESC, component LIMIT 1"),
    "label_prop_sync": _labels_sql("part_supp"),
    "label_prop_full": _labels_sql("order_part"),
    "label_prop_frontier": _labels_sql("event_chain"),
    "label_prop_push_pull": _labels_sql("part_pair"),
    "label_prop_broadcast": _labels_sql("part_supp"),
    "label_prop_shuffle": _labels_sql("order_part"),
    "hook_step": f"WITH {_edges('order_part')} SELECT src AS id, least(src, min(dst)) AS parent FROM e GROUP BY src",
    "pointer_jump": _CHAIN_FIRST,
    "hook_shortcut": _labels_sql("event_chain"),
    "star_contraction": _labels_sql("part_supp"),
    "union_find_partitioned": _labels_sql("part_supp"),
    "union_find_edge_once": _labels_sql("part_pair"),
    "union_find_tree_merge": _labels_sql("event_chain"),
    "afforest": _labels_sql("part_supp"),
    "mtx_scan": f"WITH {_edges('part_supp')} SELECT a AS src, b AS dst FROM e0",
    "labels_sink": _labels_sql("part_pair"),
    "giant_sampled": _cc("order_part", ", " + summaries.sampled_giant_sql("SELECT node AS id, label AS component FROM cc")),
    "gen_blocks": generator.gen_blocks_sql("(SELECT count(*) FROM orders)", 50, 4, seed=7),
    "gen_components": "WITH n AS (SELECT count(*) AS n, count(*) // 50 AS size FROM orders) SELECT block * size AS component, CASE WHEN block = 49 THEN n - 49 * size ELSE size END AS size FROM n, (SELECT unnest(range(0, 50)) AS block)",
}
