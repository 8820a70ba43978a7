"""Every algorithm against a plain union-find, golden values, invariants and bad input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from knotwork.functions import summaries
from knotwork.operators import afforest, hooking, partitioning, propagation, structure, unionfind
from knotwork.operators.contraction import components, star_contraction
from knotwork.plans import graphs, scratch
from knotwork.plans.fixpoint import NotConverged
from knotwork.plans.graphs import BadGraph, Graph
from knotwork.sources import generator, matrix_market, sinks
from knotwork.streaming import incremental

SHAPES = {
    "bundled": (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5)]),
    "isolated_loop": (4, [(1, 1), (2, 3)]),
    "path8": (8, [(i, i + 1) for i in range(7)]),
    "revpath8": (8, [(0, 7)] + [(i, i - 1) for i in range(7, 1, -1)]),
    "star6": (6, [(5, i) for i in range(5)]),
    "dupes": (3, [(0, 1), (1, 0), (0, 1)]),
    "cross_chain": (6, [(0, 3), (3, 4)]),
    "relink": (6, [(3, 5), (3, 1), (5, 2), (4, 5), (0, 4)]),
}
SOLVERS = {
    "sync": lambda g: propagation.sync(g).labels,
    "full": lambda g: propagation.full(g).labels,
    "frontier": lambda g: propagation.frontier(g).labels,
    "push_pull": lambda g: propagation.push_pull(g).labels,
    "broadcast": lambda g: propagation.broadcast(g).labels,
    "unbroadcast": lambda g: propagation.broadcast(g, rows=0).labels,
    "shuffle": lambda g: propagation.shuffle(g, 3).labels,
    "hook_shortcut": lambda g: hooking.hook_shortcut(g).labels,
    "partitioned": lambda g: unionfind.partitioned(g, 3).labels,
    "edge_once": lambda g: unionfind.edge_once(g, 3).labels,
    "tree_merge": lambda g: unionfind.tree_merge(g, 5).labels,
    "partitioned_as_given": lambda g: unionfind.partitioned(g).labels,
    "tree_merge_as_given": lambda g: unionfind.tree_merge(g).labels,
    "shuffle_as_given": lambda g: propagation.shuffle(g).labels,
    "afforest": lambda g: afforest.afforest(g).labels,
    "afforest1": lambda g: afforest.afforest(g, 1).labels,
}


def labels_of(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


def graph_of(spark, n, edges):
    return graphs.build(spark.createDataFrame(edges, "a long, b long"), graphs.vertex_range(spark, n))


def union(spark, names=SHAPES):
    """All shapes side by side in one graph, so that a solver runs once."""
    n, edges = 0, []
    for name in names:
        size, own = SHAPES[name]
        edges += [(a + n, b + n) for a, b in own]
        n += size
    rng = random.Random(4)
    extra = [(n + rng.randrange(60), n + rng.randrange(60)) for _ in range(45)]
    return n + 60, edges + extra


@pytest.mark.parametrize("solver", SOLVERS)
def test_labels_are_the_smallest_ids(spark, solver):
    n, edges = union(spark)
    got = {r["id"]: r["component"] for r in SOLVERS[solver](graph_of(spark, n, edges)).collect()}
    assert [got[v] for v in range(n)] == labels_of(n, edges)
    assert len(got) == n


def test_contraction_and_bounded_merge_agree(spark):
    n, edges = union(spark)
    frame = spark.createDataFrame(edges, "src long, dst long")
    truth = labels_of(n, edges)
    plain = {r["id"]: r["component"] for r in star_contraction(frame).collect()}
    assert plain == {v: truth[v] for v in {x for e in edges for x in e}}
    for bound in (0, 1000):
        got = {r["id"]: r["component"] for r in components(frame, bound).collect()}
        assert got == {v: truth[v] for v in {x for a, b in edges if a != b for x in (a, b)}}
    empty = spark.createDataFrame([], "src long, dst long")
    assert star_contraction(empty).count() == 0 and components(empty).count() == 0


@pytest.mark.parametrize("name,sweeps", [("bundled", 3), ("isolated_loop", 2), ("path8", 8), ("revpath8", 8), ("star6", 3), ("dupes", 2)])
def test_jacobi_sweeps(spark, name, sweeps):
    assert propagation.sync(graph_of(spark, *SHAPES[name])).iterations == sweeps


def test_hubs_are_dealt_to_several_parts(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(600, 700)]
    g = graph_of(spark, 701, edges)
    monkeypatch.setattr(propagation, "HUB", 20)
    links = propagation._links(g, 20)
    parts = {r["id"]: r["parts"] for r in links.hubs.collect()}
    assert set(parts) == {0, 700} and links.edges.where("dst = 0").select("part").distinct().count() > 4
    sizes = [len(p) for p in links.edges.rdd.glom().collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    monkeypatch.setattr(propagation, "_links", lambda graph: links)
    for solve in ("sync", "full", "frontier", "push_pull"):
        got = {r["id"]: r["component"] for r in SOLVERS[solve](g).collect()}
        assert [got[v] for v in range(701)] == labels_of(701, edges)


def test_loops_leave_two_checkpoints_at_most(spark):
    import os

    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    held = lambda: sum(f.startswith("rdd-") for f in os.listdir(folder))
    n, edges = SHAPES["path8"]
    g = graph_of(spark, 60, [(i, i + 1) for i in range(59)])
    before = held()
    assert propagation.sync(g).iterations == 60
    assert held() - before <= 4  # edges, hubs and the last state
    before = held()
    star_contraction(spark.createDataFrame([(i, i + 1) for i in range(59)], "src long, dst long").repartition(40)).count()
    assert held() - before <= 2


def test_sampled_giant(spark):
    labels = spark.range(5000).selectExpr("id", "CASE WHEN id % 10 < 7 THEN 0 ELSE id END AS component")
    r = summaries.sampled_giant(labels).first()
    assert r["component"] == 0 and 640 <= r["hits"] <= 800 and r["percent"] == round(r["hits"] / 10.24, 2)
    assert tuple(summaries.sampled_giant(labels.where("id < 20"), 100).first()) == (0, 14, 70.0)
    assert summaries.sampled_giant(labels.where("false")).count() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from knotwork import __main__ as cli

    monkeypatch.setattr(cli, "local_session", lambda cpus: spark)
    path = str(tmp_path / "g")
    assert cli.main([path, "--generate", "60", "4", "3", "--seed", "3"]) == 0
    assert cli.main([path, "afforest", "union_find_partitioned", "label_prop_shuffle", "--rounds", "1", "--partitions", "3", "--labels", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert re.search("union_find_partitioned: 4 components.* local [0-9.]+ s, exchange [0-9.]+ s", said)
    assert said.count("4 components") == 3 + 1 and "DIFFERS" not in said and "edges 90" in said
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    assert cli.main([path, "nothing"]) == 2


def test_no_folder_is_made_up_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        scratch.shared_folder(Session())


def test_no_edges(spark):
    g = Graph(graphs.vertex_range(spark, 3), spark.createDataFrame([], "src long, dst long"))
    assert propagation.sync(g).iterations == 1
    for solve in (SOLVERS["hook_shortcut"], SOLVERS["afforest"], SOLVERS["tree_merge"], SOLVERS["shuffle"]):
        assert sorted(map(tuple, solve(g).collect())) == [(0, 0), (1, 1), (2, 2)]


def test_cap_is_an_error(spark):
    with pytest.raises(NotConverged):
        propagation.sync(graph_of(spark, *SHAPES["path8"]), cap=3)


def test_same_labels_whatever_the_edges_order(spark):
    n, edges = union(spark)
    twisted = [(b, a) for a, b in edges] + edges[:9] + [(v, v) for v in range(5)]
    random.Random(1).shuffle(twisted)
    one = SOLVERS["tree_merge"](graph_of(spark, n, edges))
    two = SOLVERS["partitioned"](graph_of(spark, n, twisted))
    assert summaries.same_partition(one, two)


@pytest.mark.parametrize(
    "name,row,sizes",
    [("bundled", (6, 5, 1.67, 1, 2), (2, 3, 3, 3.0)), ("isolated_loop", (4, 1, 0.5, 0, 1), (3, 1, 2, 1.33)), ("star6", (6, 5, 1.67, 1, 5), (1, 6, 6, 6.0)), ("dupes", (3, 3, 2.0, 0, 3), (2, 1, 2, 1.5))],
)
def test_statistics(spark, name, row, sizes):
    g = graph_of(spark, *SHAPES[name])
    assert tuple(structure.graph_stats(g).first()) == row
    assert tuple(summaries.component_size_stats(propagation.sync(g).labels).first()) == sizes


def test_structure(spark):
    g = graph_of(spark, *SHAPES["bundled"])
    assert sorted(r[0] for r in structure.neighbors_of(g, 0).collect()) == [1, 2]
    assert sorted(map(tuple, structure.nth_neighbor(g, 1).collect())) == [(0, 2), (1, 2), (2, 1), (4, 5)]
    assert [tuple(r) for r in structure.csr_row_ptr(g, 2).orderBy("id").collect()] == [(0, 0, 2), (1, 2, 2), (2, 4, 2), (3, 6, 1), (4, 7, 2), (5, 9, 1)]
    assert structure.adjacency(g).orderBy("id").first()["neighbors"] == [1, 2]
    labels = propagation.sync(g).labels
    assert summaries.giant_component(labels).first()["component"] == 0
    ghosts = partitioning.ghost_vertices(g, 6, 2)
    assert ghosts.count() == 0
    assert sorted(map(tuple, partitioning.ghost_labels(partitioning.ghost_vertices(g, 6, 3), labels).collect())) == [(0, 2, 0), (1, 0, 0), (1, 1, 0), (1, 4, 3), (2, 3, 3)]
    assert partitioning.boundary_vertices(g, 6, 3).count() == 5


def test_hook_and_jump(spark):
    g = graph_of(spark, *SHAPES["path8"])
    start = g.vertices.select("id", F.col("id").alias("parent"))
    once = hooking.hook(g.symmetric(), start)
    assert [r["parent"] for r in once.orderBy("id").collect()] == [0, 0, 1, 2, 3, 4, 5, 6]
    assert {r["parent"] for r in hooking.compress(once).collect()} == {0}


def test_bad_graphs(spark):
    with pytest.raises(BadGraph):
        graphs.vertex_range(spark, 0)
    with pytest.raises(BadGraph):
        graphs.build(spark.createDataFrame([(1, None)], "a long, b long"))
    with pytest.raises(BadGraph):
        graph_of(spark, 2, [(0, 5)])


BUNDLED = "%%MatrixMarket matrix coordinate pattern Symmetric\n% note\n\n6 6 5\n1 2\n2 3 0.5\n1 3\n4 5\n5 6\n7 7 surplus\n"


def mtx(spark, tmp_path, text):
    path = tmp_path / "g.mtx"
    path.write_text(text)
    return matrix_market.scan(spark, str(path))


def test_matrix_market(spark, tmp_path):
    header, edges = mtx(spark, tmp_path, BUNDLED)
    assert (header.vertices, header.entries, header.square, header.symmetric) == (6, 5, True, True)
    assert sorted(map(tuple, edges.collect())) == sorted(SHAPES["bundled"][1])
    g = matrix_market.read(spark, str(tmp_path / "g.mtx"))
    assert SOLVERS["tree_merge"](g).select("component").distinct().count() == 2
    matrix_market.write(g, 6, str(tmp_path / "out.mtx"))
    assert sorted(map(tuple, matrix_market.scan(spark, str(tmp_path / "out.mtx"))[1].collect())) == sorted(SHAPES["bundled"][1])
    assert mtx(spark, tmp_path, "2 7 1\n1 2\n")[0].vertices == 7


@pytest.mark.parametrize("text", ["", "% only\n", "6 6\n", "6 6 2\n1 2\n", "6 6 2\n1 2\n% x\n3 4\n", "6 6 2\n1 2\n\n3 4\n", "6 6 1\n0 1\n", "6 6 1\n1 7\n", "6 6 1\n3\n", "0 0 0\n"])
def test_bad_files(spark, tmp_path, text):
    with pytest.raises(matrix_market.BadFile):
        mtx(spark, tmp_path, text)


def test_missing_file(spark, tmp_path):
    with pytest.raises(matrix_market.BadFile):
        matrix_market.scan(spark, str(tmp_path / "none.mtx"))


def test_generator(spark):
    g = generator.gen_blocks(spark, 103, 5, 6, seed=2)
    assert g.edges.count() == 103 * 6 // 2
    assert g.edges.where("src = dst").count() == 0
    labels = SOLVERS["tree_merge"](g)
    assert sorted(r["component"] for r in labels.select("component").distinct().collect()) == [0, 20, 40, 60, 80]
    again = generator.gen_blocks(spark, 103, 5, 6, seed=2).edges.repartition(3)
    assert g.edges.exceptAll(again).count() == 0


def test_stream_of_edges(spark):
    n, edges = union(spark)
    state = incremental.Components(spark.createDataFrame([], "id long, component long"))
    for epoch in range(3):
        state.on_batch(spark.createDataFrame(edges[epoch::3], "src long, dst long"), epoch)
    state.on_batch(spark.createDataFrame([(0, n - 1)], "src long, dst long"), 1)  # delivered again: no effect
    truth = labels_of(n, edges)
    got = {r["id"]: r["component"] for r in state.labels.collect()}
    assert got == {v: truth[v] for v in {x for e in edges for x in e}}


def test_scratch_tables_are_released(spark):
    before = scratch.written()
    one, two = scratch.table(spark.range(3), "one"), scratch.table(spark.range(4), "two")
    assert len(scratch.written() - before) == 2
    scratch.release(before, two)
    assert len(scratch.written() - before) == 1 and two.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(one._scratch).count()


def test_reports_and_stored_labels(spark, tmp_path):
    g = graph_of(spark, *SHAPES["bundled"])
    labels = SOLVERS["tree_merge"](g)
    assert sinks.graph_report(g) == "vertices 6\nedges 5\ndegree average 1.67, smallest 1, largest 2"
    assert sinks.component_report(labels) == "components 2\nsize average 3.00, smallest 3, largest 3"
    sinks.write_labels(labels, str(tmp_path / "labels"))
    assert summaries.same_partition(labels, spark.read.parquet(str(tmp_path / "labels")))
