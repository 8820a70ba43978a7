"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: each node draws some random directions, takes the
one along which its vectors spread most, and splits at their median.  Depth grows with the
table until a leaf holds ``fitted`` rows of the sample.  Every row is then sent to its leaf in
every tree.  A query searches all trees through one priority queue, ordered by how far the
query lies on the other side of the splits passed, and takes leaves until they hold ``visits``
times the table's rows, plus ``extra``, in sum over the trees.  Rows of these leaves, and no
others, are ranked by exact distance: in each group of leaves first, so that only its best
travel on.

A group is a run of leaves of up to ``part`` rows, or a part of one larger leaf; a query goes to
a group once, with the numbers of the leaves that it takes there, and the queries of a group are
split into blocks.  So no task holds a whole leaf or all queries, however many rows share one.

The embeddings here are nearly structureless beyond their copies (10th neighbours are little
nearer than random rows), so a recall above 0.9 takes most of the rows; for data with structure
``visits`` can be far smaller.  The budget is one rule for all sizes: a table of fewer rows
than ``extra / (trees - visits)`` is covered by it, through the same leaves.

Defined results: see ``vectors.stored`` for vectors that take no part; rows that repeat both id
and vector count once; a candidate with the query's own id is never returned; ties go to the
smaller vec_id; fewer candidates than asked for are all returned if the budget covers the
table; distances whose squares leave the range of doubles are summed scaled; an empty table
gives an empty table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm import tokens, vectors
from knotwork.plans import scratch


@dataclass(frozen=True)
class Settings:
    nearest: int = 10
    trees: int = 2
    leaf: int = 32  # rows that a leaf should hold at least
    sample: int = 32768  # rows that the trees are fitted on at most,
    numbers: int = 1 << 23  # and components of theirs in all (64 MB)
    fitted: int = 16  # rows of the sample that a leaf holds at least
    directions: int = 32  # random directions that a node tries
    visits: float = 0.9  # rows in the leaves that a query takes, over all trees, as a multiple of all rows
    extra: int = 1024  # rows that it takes besides
    part: int = 16384  # rows of a group of leaves
    queries: int = 16384  # of a block
    seed: int = 13


_LARGE = 1e140  # components are cut to this size for the trees, whose squares then stay finite


@dataclass
class Forest:
    """planes[tree, node], cuts[tree, node]; node i has the children 2 i and 2 i + 1, the root is 1."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf of each vector, from 0."""
        x = np.clip(x, -_LARGE, _LARGE)
        out = np.empty((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("nd,nd->n", x, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + side
            out[:, t] = node - (1 << self.depth)
        return out

    def search(self, x: np.ndarray, held: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs, best first over all trees, until ``held`` rows come to the budget."""
        x = np.clip(x, -_LARGE, _LARGE)
        side = np.einsum("tnd,d->tn", self.planes, x) - self.cuts
        queue = [(0.0, t, 1) for t in range(len(self.planes))]
        out, got = [], 0
        while queue and got < budget:
            cost, t, node = heapq.heappop(queue)
            if node >> self.depth:
                leaf = node - (1 << self.depth)
                if held[t, leaf]:
                    out.append((t, leaf))
                    got += held[t, leaf]
                continue
            margin = side[t, node]
            near = 2 * node + (margin > 0)
            heapq.heappush(queue, (cost, t, near))
            heapq.heappush(queue, (cost + margin * margin, t, near ^ 1))
        return out


def fit(sample: np.ndarray, rows: int, s: Settings = Settings()) -> Forest:
    deep = lambda n, least: int(max(0, np.floor(np.log2(max(n, 1) / least))))
    depth = min(deep(rows, s.leaf), deep(len(sample), s.fitted))
    size, sample = sample.shape[1], np.clip(sample, -_LARGE, _LARGE)
    planes, cuts = np.zeros((s.trees, 1 << depth, size)), np.zeros((s.trees, 1 << depth))
    rng = np.random.default_rng(s.seed)
    for t in range(s.trees):
        parts = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            ways = rng.normal(size=(size, s.directions))
            ways /= np.linalg.norm(ways, axis=0)
            best = ways[:, (sample[own] @ ways).var(0).argmax()] if len(own) else ways[:, 0]
            along = sample[own] @ best
            planes[t, node], cuts[t, node] = best, np.median(along) if len(own) else 0.0
            right = along > cuts[t, node]
            parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return Forest(planes, cuts, depth)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of paired rows, the squares summed from the first component on; scaled by the
    largest difference where their sum is not a normal number."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", under="ignore"):
        for d in range(x.shape[1]):
            total += (x[:, d] - y[:, d]) ** 2
        out = np.sqrt(total)
        odd = np.flatnonzero(~((total > 1e-290) & (total < 1e300)))
        if len(odd):
            half = np.abs(x[odd] / 2 - y[odd] / 2)
            most = half.max(1)
            unit = np.where(most > 0, most, 1.0)[:, None]
            out[odd] = np.sqrt(((half / unit) ** 2).sum(1)) * most * 2
    return out


def _ranked(i: np.ndarray, j: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (query i, row j) with their exact distances, each query's k nearest, ties to the smaller id."""
    cuts = range(0, len(i), 1 << 16)
    exact = np.concatenate([distances(queries[i[c : c + (1 << 16)]], rows[j[c : c + (1 << 16)]]) for c in cuts]) if len(i) else np.zeros(0)
    by = np.lexsort((ids[j], exact, i))
    i, j, exact = i[by], j[by], exact[by]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], exact[keep]


def _best(queries: np.ndarray, own: np.ndarray, takes: np.ndarray, rows: np.ndarray, ids: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, distance) of each query's k nearest rows among the leaves that it takes.
    Rows lie by leaf, leaf l from first[l] on; takes: (queries, leaves)."""
    # squares of scaled vectors stay finite; the scale changes what is compared exactly, not the result
    top = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    scale = 1.0 if 1e-100 < top < 1e100 or not top else top
    q, r = queries / scale, rows / scale
    q_norm, r_norm = (q * q).sum(1), (r * r).sum(1)
    slack = 1e-9 * (q_norm + r_norm.max(initial=0))
    best, found_i, found_j, found_d = np.full((len(q), k), np.inf), [], [], []
    for leaf in range(len(first) - 1):
        a, b = first[leaf], first[leaf + 1]
        who = np.flatnonzero(takes[:, leaf])
        if not len(who) or a == b:
            continue
        rough = q_norm[who, None] + r_norm[None, a:b] - 2 * (q[who] @ r[a:b].T)
        rough[own[who, None] == ids[None, a:b]] = np.inf
        # whatever might be among the k nearest but for rounding is compared exactly in the end
        i, j = np.nonzero((rough <= (best[who, k - 1] + slack[who])[:, None]) & (rough < np.inf))
        found_i.append(who[i])
        found_j.append(a + j)
        found_d.append(rough[i, j])
        best[who] = np.partition(np.concatenate([best[who], rough], axis=1), k - 1, axis=1)[:, :k]
        best[who] = np.sort(best[who], axis=1)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, d = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_d)
    close = d <= best[i, k - 1] + slack[i]
    return _ranked(i[close], j[close], queries, rows, ids, k)


def groups(held: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group of each leaf, number of groups that it is split into, number of all groups) for
    held[tree, leaf] rows: runs of a tree's leaves of up to ``part`` rows together; larger leaves lie in
    several groups of their own.  A group holds no row twice, as its leaves are of one tree."""
    start, split = np.zeros(held.shape, np.int64), np.maximum(1, -(-held // part))
    at = -1
    for t, leaves in enumerate(held):
        room = -1
        for leaf, n in enumerate(leaves):
            if split[t, leaf] > 1 or n > room:
                at, room = at + 1, part
            start[t, leaf] = at
            room -= n
            if split[t, leaf] > 1:
                at, room = at + int(split[t, leaf]) - 1, -1
    return start.ravel(), split.ravel(), at + 1


def search(frame: DataFrame, wanted, settings: Settings = Settings(), column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for the rows of frame(vec_id, <column>)
    that satisfy the condition ``wanted``."""
    s, k = settings, settings.nearest
    size, numbers = vectors.common_size(frame, column), vectors.kind(frame, column)
    usable = scratch.table(vectors.stored(frame, size, column).where("ok").dropDuplicates(["vec_id", "h1", "h2"]).select("row", "vec_id", "vec"), "usable")
    rows = usable.count()
    picked = usable.orderBy(F.xxhash64("row"), "row").limit(max(s.fitted, min(s.sample, s.numbers // size))).select("vec").toArrow().column(0).combine_chunks()  # sample rows at most
    forest = fit(vectors.matrix(picked, size), rows, s)
    trees, leaves = s.trees, 1 << forest.depth
    shared = frame.sparkSession.sparkContext.broadcast(forest)  # trees x 2^depth planes

    def index(stream):
        for batch in stream:
            if batch.num_rows:
                where = shared.value.leaves(vectors.matrix(batch.column(2), size))
                at = pa.array(np.repeat(np.arange(batch.num_rows), trees))
                yield pa.RecordBatch.from_arrays([pa.array((where + np.arange(trees) * leaves).ravel()), *[c.take(at) for c in batch.columns]], names=["leaf", "row", "vec_id", "vec"])

    indexed = usable.mapInArrow(index, f"leaf long, row long, vec_id long, vec array<{numbers}>")

    def count(stream):
        held = np.zeros(trees * leaves, np.int64)
        for batch in stream:
            if batch.num_rows:
                where = shared.value.leaves(vectors.matrix(batch.column(0), size)) + np.arange(trees) * leaves
                held += np.bincount(where.ravel(), minlength=trees * leaves)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["leaf", "n"])

    held = np.zeros(trees * leaves, np.int64)
    for r in usable.select("vec").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # trees x 2^depth numbers at most
        held[r["leaf"]] = r["n"]
    part = int(np.clip(trees * rows // 32, 1024, s.part))
    start, split, many = groups(held.reshape(trees, leaves), part)
    asking = usable.where(wanted)
    blocks = max(1, -(-asking.count() // s.queries))
    budget = s.visits * rows + s.extra
    plan = frame.sparkSession.sparkContext.broadcast((held.reshape(trees, leaves), start, split))

    def ask(stream):
        sizes, begin, parts = plan.value
        for batch in stream:
            x = vectors.matrix(batch.column(2), size)
            key, at, lists = [], [], []
            for i in range(len(x)):
                taken = np.sort(np.array([t * leaves + leaf for t, leaf in shared.value.search(x[i], sizes, budget)], np.int64))
                n = parts[taken]
                to = np.repeat(begin[taken] - np.cumsum(n) + n, n) + np.arange(n.sum())  # all parts of each leaf
                for g, own in zip(*_runs_of(to, np.repeat(taken, n))):
                    key.append(g)
                    at.append(i)
                    lists.append(own)
            if key:
                at = pa.array(np.array(at))
                sizes_of = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                takes = pa.ListArray.from_arrays(pa.array(sizes_of), pa.array(np.concatenate(lists).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.int64)), takes, *[c.take(at) for c in batch.columns]], names=["key", "takes", "row", "vec_id", "vec"])

    asked = asking.mapInArrow(ask, f"key long, takes array<int>, row long, vec_id long, vec array<{numbers}>")
    questions = asked.select("key", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "takes", F.lit(None).cast("int").alias("leaf"), "row", "vec_id", "vec")

    def placed(stream):
        _, begin, parts = plan.value
        for batch in stream:
            leaf, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            key = begin[leaf] + (tokens.mix64(row.view(np.uint64)) % parts[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(leaf.astype(np.int32)), *batch.columns[1:]], names=["key", "leaf", "row", "vec_id", "vec"])

    answers = indexed.mapInArrow(placed, f"key long, leaf int, row long, vec_id long, vec array<{numbers}>")
    answers = answers.select("key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("array<int>").alias("takes"), "leaf", "row", "vec_id", "vec")
    together = questions.unionByName(answers).select(F.xxhash64("key", "block").alias("g"), "leaf", "takes", "row", "vec_id", "vec")

    def rank(stream):
        for batch in vectors.grouped(stream):
            g, row, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            asks = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            leaf = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            x = vectors.matrix(batch.column(5), size)
            for a, b in vectors.runs(g):
                asker, r = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])  # rows lie by leaf
                if not len(asker) or not len(r):
                    continue
                names, first = np.unique(leaf[r], return_index=True)
                for lo in range(0, len(asker), 256):
                    q = asker[lo : lo + 256]
                    takes = np.zeros((len(q), len(names)), bool)
                    lists = batch.column(2).take(pa.array(q))
                    slot, who = np.searchsorted(names, lists.flatten().to_numpy()), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
                    there = slot < len(names)  # a part of a leaf may hold no row
                    there[there] = names[slot[there]] == lists.flatten().to_numpy()[there]
                    takes[who[there], slot[there]] = True
                    i, j, d = _best(x[q], ids[q], takes, x[r], ids[r], np.append(first, len(r)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(row[q][i]), pa.array(ids[q][i]), pa.array(row[r][j]), pa.array(ids[r][j]), pa.array(d)], names=["asker", "query_id", "row", "vec_id", "score"])

    best = together.repartition(max(many * blocks, 1), "g").sortWithinPartitions("g", "leaf").mapInArrow(rank, "asker long, query_id long, row long, vec_id long, score double")
    once = best.dropDuplicates(["asker", "row"])
    place = F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id", "row"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _runs_of(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct keys and the values of each one."""
    by = np.argsort(keys, kind="stable")
    cuts = list(vectors.runs(keys[by]))
    return [int(keys[by][a]) for a, _ in cuts], [values[by][a:b] for a, b in cuts]


def oracle(nearest: int = 10, every: int = 100) -> str:
    """Exact search in DuckDB SQL: what the forest gives where its budget covers the table."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NOT NULL AND isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0
  AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), lambda a, b: a + b) AS t
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, vec_id, sqrt(t) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sqrt(t), vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {nearest}"""
