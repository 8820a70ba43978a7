"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors to eight dimensions at random, shifts them and decodes them
to the nearest point of the E8 lattice: the vector's home cell.  A vector also probes the
``probes`` neighbouring cells that it leans towards most.  Vectors that meet in a cell, one of
them at home there, are compared by cosine in double precision.

Cells are filled with ids and sketches first: 128 sides of random planes, of which a pair at the
threshold differs in about a tenth and random vectors in half.  Vectors then travel only to cells
where some sketch is near enough to theirs (``_most_apart``: a linked pair is ruled out with a
chance of about 1e-9), so what is shuffled is a few small numbers a cell, and vectors of links.

Equal vectors are one class with a count, so copies cost nothing.  Pairs never leave the task
that finds them: a link found in several cells or tables counts only in the first of them,
which each task can tell from the two vectors alone, and what is shuffled is each class's
number of links and a spanning forest of the block's links.  Cells with more than ``block``
members are split, and each pair of parts is compared.

For a pair at the threshold 0.95 a table misses with a chance of about 0.06 (measured), all
``tables`` of them with 1e-6; closer pairs are safer still.  A cell of the eight projected dimensions
holds a fixed share of all directions, so the sketches that are compared grow with the square of
the rows (15 % of all pairs of unstructured vectors in 64 dimensions); a larger ``scale`` with
more ``tables`` trades them for rows that are shuffled.

Defined results: see ``vectors.stored`` for vectors that link with nothing; they are kept and
have no link.  Repeated rows are vectors of their own and link.  Ties go to the smaller
vec_id; an empty table gives an empty table; labels and further columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import tokens, vectors
from knotwork.llm.near_dup import _few
from knotwork.operators.contraction import components
from knotwork.plans import forests, scratch


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    tables: int = 5
    probes: int = 4
    scale: float = 0.5  # of a projected unit vector's components
    block: int = 4096
    seed: int = 3


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: its cells' neighbours."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(signs) / 2 for signs in itertools.product((1.0, -1.0), repeat=8) if np.prod(signs) > 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: where the sum is odd, the worst coordinate goes the other way."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(gap[odd]).argmax(1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better one of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _name(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit name of lattice points (their doubled coordinates are integers)."""
    whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
    factor = np.random.default_rng([table, 8]).integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
    return tokens.mix64((whole * factor).sum(-1, dtype=np.uint64) + np.uint64(table + 1)).view(np.int64)


@lru_cache(maxsize=64)
def _projection(size: int, table: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([s.seed, table])
    return rng.normal(size=(size, 8)) * s.scale, rng.random(8)


def cells(unit: np.ndarray, s: Settings) -> np.ndarray:
    """(rows, tables, 1 + probes) names of each vector's home cell and the cells that it probes.

    Projections are summed in a fixed order, so a vector has the same cells in every task."""
    n, size = unit.shape
    out = np.empty((n, s.tables, 1 + s.probes), np.int64)
    for t in range(s.tables):
        plane, shift = _projection(size, t, s)
        x = np.broadcast_to(shift, (n, 8)).copy()
        for d in range(size):
            x += unit[:, d, None] * plane[d]
        home = nearest(x)
        gap = x - home
        lean = np.zeros((n, len(ROOTS)))
        for d in range(8):
            lean += gap[:, d, None] * ROOTS[:, d]
        towards = np.argpartition(-lean, s.probes, axis=1)[:, : s.probes]
        out[:, t, 0] = _name(home, t)
        for p in range(s.probes):
            out[:, t, 1 + p] = _name(home + ROOTS[towards[:, p]], t)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sketches(unit: np.ndarray, s: Settings) -> np.ndarray:
    """(rows, 2) longs: the sides of 128 random planes that each vector lies on."""
    side = unit @ np.random.default_rng([s.seed, 128]).normal(size=(unit.shape[1], 128)) > 0
    return np.packbits(side, axis=1).view(np.uint64).reshape(len(unit), 2)


def _most_apart(s: Settings) -> int:
    """Sketch bits that a linked pair may differ in: six standard deviations over the threshold's mean."""
    p = np.arccos(np.clip(s.cosine, -1, 1)) / np.pi
    return int(min(128, np.ceil(128 * p + 6 * np.sqrt(128 * p * (1 - p)) + 1)))


def _near_sketches(cross: bool, heap: np.ndarray, home: np.ndarray, sketch: np.ndarray, most: int) -> np.ndarray:
    """Which members of a block are near another one by sketch, one of the two at home there."""
    near = np.zeros(len(home), bool)
    hosts = np.flatnonzero(home)
    for lo in range(0, len(hosts), 256):
        mine = hosts[lo : lo + 256]
        apart = np.bitwise_count(sketch[mine, None, 0] ^ sketch[None, :, 0]) + np.bitwise_count(sketch[mine, None, 1] ^ sketch[None, :, 1])
        close = apart <= most
        close[np.arange(len(mine)), mine] = False
        if cross:
            close &= heap[mine, None] != heap[None, :]
        near[mine] |= close.any(1)
        near |= close.any(0)
    return near


def _first_here(cx: np.ndarray, cy: np.ndarray, x: np.ndarray, y: np.ndarray, table: int) -> np.ndarray:
    """Whether the pairs (x at home in a cell of this table, y there too) meet nowhere earlier."""
    first = np.ones(len(x), dtype=bool)
    for t in range(table):
        meet = (cx[:, t, :1] == cy[:, t]).any(1) | (cy[:, t, :1] == cx[:, t]).any(1)
        first &= ~meet
    same_home = cx[:, table, 0] == cy[:, table, 0]
    other_way = (cy[:, table, :1] == cx[:, table, 1:]).any(1)
    return first & (same_home | ~other_way | (x < y))


def _block(batch: pa.RecordBatch, size: int, s: Settings):
    """(src, dst, n): links of each member (src = dst) and edges of a spanning forest (n = 0)."""
    key, cross, heap, table, home, member, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
    unit = _unit(vectors.matrix(batch.column(7), size))
    _, one, each = np.unique(member, return_index=True, return_inverse=True)  # a vector lies in many blocks
    where = cells(unit[one], s)[each]
    for a, b in vectors.runs(key):
        hosts = a + np.flatnonzero(home[a:b])
        if b - a < 2 or not len(hosts):
            continue
        src, dst = [], []
        links = np.zeros(b - a, np.int64)
        for lo in range(0, len(hosts), 256):
            mine = hosts[lo : lo + 256]
            i, j = np.nonzero(unit[mine] @ unit[a:b].T >= s.cosine - 1e-9)
            i, j = mine[i], j + a
            ok = (member[i] != member[j]) & ~(home[j] & (member[i] > member[j]))
            if cross[a]:
                ok &= heap[i] != heap[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            keep = np.einsum("nd,nd->n", unit[i], unit[j]) >= s.cosine
            i, j = i[keep], j[keep]
            for c in range(0, len(i), 1 << 14):
                pi, pj = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                here = _first_here(where[pi], where[pj], member[pi], member[pj], int(table[a]))
                pi, pj = pi[here], pj[here]
                np.add.at(links, pi - a, weight[pj])
                np.add.at(links, pj - a, weight[pi])
                u, v = forests.reduce_edges(member[pi], member[pj])
                src.append(u)
                dst.append(v)
        some = np.flatnonzero(links)
        if len(some):
            u, v = forests.reduce_edges(np.concatenate(src), np.concatenate(dst))
            yield np.concatenate([member[a + some], u]), np.concatenate([member[a + some], v]), np.concatenate([links[some], np.zeros(len(u), np.int64)])


def link(frame: DataFrame, settings: Settings = Settings(), column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of frame(vec_id, <column>)."""
    s, before = settings, scratch.written()
    size = vectors.common_size(frame, column)
    table = vectors.stored(frame, size, column)
    twins = scratch.table(table.where("ok").groupBy("h1", "h2").agg(F.min("row").alias("member"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "twins")
    placed = table.select("row", "vec_id", "ok", "h1", "h2").join(twins, ["h1", "h2"], "left")
    members = scratch.table(placed.select("row", "vec_id", *[F.coalesce(F.when(F.col("ok"), F.col(c)), own).alias(c) for c, own in (("member", F.col("row")), ("copies", F.lit(1)))]), "members")
    others = scratch.table(members.where("row <> member").select("row"), "others")
    reps = table.where("ok").join(_few(others), "row", "left_anti").select(F.col("row").alias("member"), "vec")
    per, most = s.tables * (1 + s.probes), _most_apart(s)

    def places(stream):
        for batch in stream:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                yield part.column(0), _unit(vectors.matrix(part.column(1), size))

    def name(stream):
        for _, unit in places(stream):
            yield pa.RecordBatch.from_arrays([pa.array(cells(unit, s).ravel())], names=["cell"])

    def place(stream):
        table, probe = np.divmod(np.arange(per), 1 + s.probes)
        for member, unit in places(stream):
            at, sketch = np.repeat(np.arange(len(unit)), per), sketches(unit, s).view(np.int64)
            columns = [cells(unit, s).ravel(), np.tile(table * 2 + (probe == 0), len(unit)).astype(np.int32), sketch[at, 0], sketch[at, 1]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), member.take(pa.array(at))], names=["cell", "spot", "s1", "s2", "member"])

    sizes = reps.mapInArrow(name, "cell long").groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    crowded = scratch.table(sizes.where(F.col("size") > s.block), "crowded")
    spots = reps.mapInArrow(place, "cell long, spot int, s1 long, s2 long, member long").join(_few(crowded), "cell", "left")
    heaps = F.ceil(F.coalesce("size", F.lit(1)) / s.block).cast("int")
    own = F.pmod(F.xxhash64("member", "cell"), heaps).cast("int")
    spread = spots.select("cell", "spot", "s1", "s2", "member", own.alias("heap"), F.explode(F.sequence(F.lit(0), heaps - 1)).alias("other"))
    block = F.xxhash64("cell", F.least("heap", "other"), F.greatest("heap", "other"))
    named = spread.select(block.alias("block"), (F.col("heap") != F.col("other")).alias("cross"), "heap", "spot", "member", "s1", "s2")

    def sift(stream):
        for batch in vectors.grouped(stream):
            key, cross, heap, spot, s1, s2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5, 6))
            sketch = np.stack([s1, s2], 1).view(np.uint64)
            keep = [np.zeros(0, np.int64)]
            for a, b in vectors.runs(key):
                if b - a > 1:
                    keep.append(a + np.flatnonzero(_near_sketches(cross[a], heap[a:b], spot[a:b] % 2 == 1, sketch[a:b], most)))
            keep = pa.array(np.concatenate(keep))
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in batch.columns[:5]], names=batch.schema.names[:5])

    near = named.repartition("block").sortWithinPartitions("block").mapInArrow(sift, "block long, cross boolean, heap int, spot int, member long")
    near = scratch.table(near, "near")
    wanted = scratch.table(near.select("member").distinct(), "wanted")
    hot = reps.join(_few(wanted), "member", "left_semi").join(twins.select("member", "copies"), "member", "left")
    dealt = near.join(hot, "member").select("block", "cross", "heap", F.shiftright("spot", 1).alias("t"), (F.col("spot") % 2 == 1).alias("home"), "member", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "vec")

    def compare(stream):
        for batch in vectors.grouped(stream):
            for u, v, n in _block(batch, size, s):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=["src", "dst", "n"])

    found = scratch.table(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "src long, dst long, n long"), "found")
    degree = scratch.table(found.where("n > 0").groupBy(F.col("src").alias("member")).agg(F.sum("n").alias("others")), "degree")
    labels = scratch.table(components(found.where("n = 0").select("src", "dst")).select(F.col("id").alias("member"), F.col("component").alias("label")), "labels")
    done = scratch.table(members.join(degree, "member", "left").join(labels, "member", "left").select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "member").alias("label")), "done")
    heads = scratch.table(done.groupBy("label").agg(F.min("vec_id").alias("component_id")), "heads")
    scratch.release(before, done, heads)
    return done.join(heads, "label").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(cosine: float = 0.95) -> str:
    """The same in DuckDB SQL, by comparing all pairs."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_aggregate(list_transform(e, lambda x: CASE WHEN x IS NOT NULL AND isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0
      AND list_aggregate(list_transform(e, lambda x: abs(x)), 'max') > 0),
p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {cosine}),
cc(node, label) USING KEY (node) AS (
  SELECT vec_id, vec_id FROM v UNION
  SELECT p.x, min(n.label) FROM cc n JOIN p ON p.y = n.node JOIN recurring.cc o ON o.node = p.x GROUP BY p.x HAVING min(n.label) < min(o.label))
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, label AS component_id, vec_id = label AS kept
FROM v JOIN cc ON node = vec_id LEFT JOIN (SELECT x, count(*) AS k FROM p GROUP BY x) ON x = vec_id"""
