"""Label propagation: every vertex takes the smallest label around it until none changes.

The variants differ in what a round sends, and so in their plans:

=============  ==============================================================================
sync           all vertices pull from all neighbours' old labels (Jacobi)
full           a sweep in two halves, the second one seeing what the first one changed
frontier       only labels that changed in the last round are sent
push_pull      a pulled minimum is pushed on to the neighbours within the same round
broadcast      as sync, the labels broadcast while they are proven to fit, else shuffled
shuffle        blocks are solved inside their partitions; only changed boundary labels travel
=============  ==============================================================================

A round is one join and one aggregation with partial minima on the map side.  A vertex's own
label rides along as a message, so no second join brings old and new together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.partitioning import block_owner
from knotwork.plans import forests, scratch
from knotwork.plans.fixpoint import Result, settle
from knotwork.plans.graphs import Graph, edges_once

BROADCAST_ROWS = 2_000_000  # two longs a row: about 32 MB


def _start(graph: Graph) -> DataFrame:
    return graph.vertices.select("id", F.col("id").alias("component"))


HUB = 10_000  # neighbours from which a vertex may count as a hub


@dataclass
class Links:
    """edges(src, dst, part): symmetric distinct edges, laid out once by the vertex whose label is read.
    A hub's edges are dealt to several parts; hubs(id, parts), a few rows, says how many."""

    edges: DataFrame
    hubs: DataFrame | None

    def where(self, condition: Column) -> Links:
        return Links(self.edges.where(condition), self.hubs)

    def sent(self, labels: DataFrame) -> DataFrame:
        """(id, component): the label of each vertex as a message to each of its neighbours."""
        part = F.lit(0)
        if self.hubs is not None:
            labels = labels.join(F.broadcast(self.hubs), "id", "left")  # at most four rows a shuffle partition
            part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        dealt = labels.select(F.col("id").alias("dst"), part.alias("part"), "component")
        return self.edges.join(dealt, ["dst", "part"]).select(F.col("src").alias("id"), "component")


def _links(graph: Graph, hub: int = HUB) -> Links:
    spread = scratch.checkpoint(graph.symmetric().distinct())
    # with a quarter of an even partition a vertex is a hub, so there are at most four a partition
    least = max(hub, spread.count() // (4 * int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    degree = spread.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hubs = scratch.checkpoint(degree.where(F.col("n") > least).select("id", F.ceil(F.col("n") / least).cast("int").alias("parts")))
    if not hubs.limit(1).count():
        laid = scratch.checkpoint(spread.withColumn("part", F.lit(0)).repartition("dst", "part"))
        hubs = None
    else:
        parts = spread.join(F.broadcast(hubs.withColumnRenamed("id", "dst")), "dst", "left")
        laid = scratch.checkpoint(parts.select("src", "dst", F.pmod(F.xxhash64("src"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")).repartition("dst", "part"))
    scratch.drop(spread)
    return Links(laid, hubs)


def _taken(labels: DataFrame, messages: DataFrame) -> DataFrame:
    """labels(id, component, changed): the smallest of a vertex's own label and its messages."""
    own = labels.select("id", "component", F.col("component").alias("own"))
    both = own.unionByName(messages.withColumn("own", F.lit(None).cast("long")))
    least = both.groupBy("id").agg(F.min("component").alias("component"), F.min("own").alias("own"))
    return least.select("id", "component", (F.col("component") < F.col("own")).alias("changed"))


def sync(graph: Graph, cap: int = 10_000) -> Result:
    links = _links(graph)
    labels, n = settle(lambda state: _taken(state, links.sent(state)), _start(graph), cap)
    return Result(labels, n)


def full(graph: Graph, cap: int = 10_000) -> Result:
    """In-place sweeps: even ids first, then odd ids, which already read the even ones' new labels."""
    links = _links(graph)

    def half(state: DataFrame, mine: Column) -> DataFrame:
        return _taken(state, links.where(mine).sent(state.select("id", "component")))

    def sweep(state: DataFrame) -> DataFrame:
        even = half(state, F.col("src") % 2 == 0)
        odd = half(even, F.col("src") % 2 != 0)
        return odd.join(even.select("id", F.col("changed").alias("before")), "id").select("id", "component", (F.col("changed") | F.col("before")).alias("changed"))

    labels, n = settle(sweep, _start(graph), cap)
    return Result(labels, n)


def frontier(graph: Graph, cap: int = 10_000) -> Result:
    links = _links(graph)
    step = lambda state: _taken(state.select("id", "component"), links.sent(state.where("changed").select("id", "component")))
    labels, n = settle(step, _start(graph).withColumn("changed", F.lit(True)), cap, keep=True)
    return Result(labels.select("id", "component"), n)


def push_pull(graph: Graph, cap: int = 10_000) -> Result:
    links = _links(graph)

    def step(state: DataFrame) -> DataFrame:
        pulled = _taken(state, links.sent(state))
        pushed = links.sent(pulled.where("changed").select("id", "component"))
        after = _taken(pulled.select("id", "component"), pushed)
        return after.join(pulled.select("id", F.col("changed").alias("before")), "id").select("id", "component", (F.col("changed") | F.col("before")).alias("changed"))

    labels, n = settle(step, _start(graph), cap)
    return Result(labels, n)


def broadcast(graph: Graph, cap: int = 10_000, rows: int = BROADCAST_ROWS) -> Result:
    """Every task gets all labels, as long as there are no more than ``rows`` of them."""
    start = scratch.checkpoint(_start(graph))
    small = start.count() <= rows
    links = scratch.checkpoint(graph.symmetric().distinct())

    def step(state: DataFrame) -> DataFrame:
        side = F.broadcast(state) if small else state
        messages = links.join(side, links["dst"] == side["id"]).select(F.col("src").alias("id"), "component")
        return _taken(state, messages)

    labels, n = settle(step, start, cap)
    return Result(labels, n)


def shuffle(graph: Graph, blocks: int | None = None, cap: int = 10_000) -> Result:
    """Halo exchange: vertices lie in blocks of ids (one for a million edges or shuffle partition, if not
    given); edges inside a block are reduced where they lie and then solved block by block, and
    rounds send only changed labels across blocks."""
    span = graph.vertices.agg(F.max("id")).first()[0] or 0
    owner = lambda c: block_owner(F.col(c), span + 1, blocks)
    single = scratch.checkpoint(edges_once(graph.edges))
    blocks = blocks or max(int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), single.count() // 1_000_000)
    once = single.withColumn("p", owner("src")).withColumn("q", owner("dst"))
    reduced = forests.forest(once.where("p = q")).withColumn("p", owner("src"))  # no edge leaves its block
    inner = forests.forest(reduced.repartition(blocks, "p"))
    roots = scratch.checkpoint(inner.groupBy("src").agg(F.min("dst").alias("dst")))  # a star for each block's component
    root = roots.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    lifted = once.where("p <> q").select("src", "dst")
    for end in ("src", "dst"):
        lifted = lifted.join(root.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    boundary = Graph(graph.vertices.join(root, "id", "left_anti"), lifted.where("src <> dst"))
    known = frontier(boundary, cap)
    top = known.labels.withColumnRenamed("id", "root")
    inside = root.join(top, "root", "left").select("id", F.coalesce("component", "root").alias("component"))
    return Result(inside.unionByName(known.labels), known.iterations)
