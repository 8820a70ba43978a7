"""Near-duplicate documents by MinHash LSH in sorted orders, every link confirmed on full sets.

A document's set holds the 64-bit hashes of its runs of ``words`` words (see ``Settings``; two
different runs of a pair share one with a chance of about n^2 / 2^64 for n runs).  Equal
sets form a class, and one row stands for it from there on.  A signature of 64 minima of 16
bits makes sixteen sorted orders: in order t the documents are sorted by the values 4t, 4t+1
and so on.  A *region* of an order is a run of documents that share its first four values;
inside it the sort goes on by up to eight more, so that neighbours are those with the longest
common prefix, and these are a document's candidates.  Neighbours whose signatures and sizes
allow a link are compared on their full sets, and links make components.

Neighbours alone could miss links inside a region that holds several components.  Such regions of
up to ``block`` documents are searched again, with the sets at hand: documents of different
components are compared there, and those already joined are not.  The documents of larger ones
(a template that thousands fill in, say) are not paired: they are first parted by their rarest
shingles.  A linked pair shares one of the smaller set's n / 9 and the larger set's n / 5 rarest
shingles, in any common order of shingles; only documents that are connected by such shingles are
compared, and what they all have in common tells nothing.  So every pair that shares a region is
either in one component, or has been compared, or cannot be a link.

The signature only rules out pairs with under 36 equal values of 64; a link (similarity 0.8:
51 expected) falls below that with a chance of about one in a million, and shares no region
with one of about 2 in 10,000.

Defined results: null and empty texts, and texts without words, have an empty set and no
link; a text with fewer words than a shingle is one shingle; repeated rows have equal sets
and are linked; ties go to the smaller doc_id; null doc_ids are only a component's id where it
has no other; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import tokens, vectors
from knotwork.operators.contraction import components
from knotwork.plans import scratch

VALUES, DEPTH = 64, 4
ORDERS = VALUES // DEPTH
_BROADCAST_ROWS = 1_000_000  # of one long each; a larger side is shuffled


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80  # links have 100 * intersection >= percent * union
    least_equal: int = 36  # of 64 signature values that a candidate shares
    block: int = 512  # documents of a region that are searched together
    buckets: int = 1 << 18  # that shingles are counted in to find the rare ones
    seed: int = 11


def shingles(hashes: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending; first of each text, n + 1)."""
    n = len(first) - 1
    runs = tokens.chain(hashes, words)
    out = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            own = np.sort(runs[a : b - words + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            whole = tokens.chain(hashes[a:b], int(b - a))  # shorter than a shingle: all of it is one
            out.append(tokens.mix64(whole + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum([len(x) for x in out], out=bounds[1:])
    return (np.concatenate(out) if out else hashes[:0]), bounds


def _constants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def signature(sets: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """(texts, 64) minima, cut to 16 bits; zeros for an empty set."""
    factor, shift = _constants(seed)
    out = np.zeros((len(bounds) - 1, VALUES), np.uint16)
    low = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    for i in range(len(out)):
        best = None
        for a in range(bounds[i], bounds[i + 1], 4096):
            x = low[a : min(a + 4096, bounds[i + 1]), None] * factor + shift
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            least = x.min(0)
            best = least if best is None else np.minimum(best, least)
        if best is not None:
            out[i] = (best ^ (best >> np.uint32(16))).astype(np.uint16)
    return out


def _sums(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix64(sets ^ np.uint64(0x6A09E667F3BCC909)))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix64(sets + np.uint64(0xBB67AE8584CAA73B)))])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64), (other[bounds[1:]] - other[bounds[:-1]]).view(np.int64)


def _longs(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel(), pa.int64()))


FEATURES = "doc_id long, th long, n long, fp1 long, fp2 long, sig array<long>"


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def features(docs: DataFrame, settings: Settings) -> DataFrame:
    """One row a document: its set's size, digests and signature; ``row`` tells the rows apart."""
    s = settings

    def run(stream):
        for batch in stream:
            for part in tokens.batches(batch, "text"):
                hashes, first, *_ = tokens.words_of(part.column(2))
                sets, bounds = shingles(hashes, first, s.words)
                a, b = _sums(sets, bounds)
                sig = signature(sets, bounds, s.seed).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(a), pa.array(b), _longs(sig)],
                    names=["doc_id", "th", "n", "fp1", "fp2", "sig"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), _text_hash().alias("th"), F.col("text").cast("string")).mapInArrow(run, FEATURES)
    row = F.monotonically_increasing_id()
    table = rows.select(row.alias("row"), "*").select("row", "doc_id", "th", "n", F.when(F.col("n") > 0, F.col("fp1")).otherwise(F.col("row")).alias("fp1"), F.when(F.col("n") > 0, F.col("fp2")).otherwise(F.lit(0)).alias("fp2"), "sig")
    return scratch.table(table, "features")


def _few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small; df is a stored table of one or two longs a row."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def full_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(member, set) for wanted(th, member, n): the shingle sets of these texts, from the texts."""
    s = settings

    def run(stream):
        for batch in stream:
            for part in tokens.batches(batch, "text"):
                hashes, first, *_ = tokens.words_of(part.column(1))
                sets, bounds = shingles(hashes, first, s.words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["th", "n", "set"])

    keys = scratch.table(wanted.select("th").distinct(), "keys")
    # equal texts give equal rows here: one of each is enough
    found = docs.select(_text_hash().alias("th"), F.col("text").cast("string")).join(_few(keys), "th", "left_semi").dropDuplicates(["th"]).mapInArrow(run, "th long, n long, set array<long>")
    return scratch.table(wanted.join(found, ["th", "n"]).select("member", "set"), "sets")


def _equal_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int32)
    for i in range(0, len(x), 1 << 16):
        out[i : i + (1 << 16)] = (x[i : i + (1 << 16)] == y[i : i + (1 << 16)]).sum(1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint16).reshape(-1, VALUES)


PAIRS = "a long, b long"


def _may_link(n_a, n_b, percent: int):
    """Sizes alone: the intersection is at most the smaller, the union at least the larger set."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def regions(reps: DataFrame, settings: Settings) -> DataFrame:
    """(region, t, next, then, member): a row for each document and order; rows of an order share their
    first four values exactly if they share ``region``; the next eight follow in two longs."""
    each = reps.select("member", "sig", F.posexplode("sig").alias("t", "head"))
    after = lambda n: F.element_at("sig", (F.col("t") + n) % ORDERS + 1)
    return each.select(F.xxhash64("t", "head").alias("region"), "t", after(1).alias("next"), after(2).alias("then"), "member")


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours in the sorted orders that share a region: those of the longest common
    prefixes, as deep as up to twelve values tell."""

    def run(stream):
        last = None
        for batch in stream:
            region, member = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(region):
                continue
            if last is not None:
                region, member = np.concatenate([[last[0]], region]), np.concatenate([[last[1]], member])
            last = region[-1], member[-1]
            same = np.flatnonzero((region[1:] == region[:-1]) & (member[1:] != member[:-1]))
            x, y = member[same], member[same + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["a", "b"])

    ordered = rows.select("region", "member", "next", "then").repartitionByRange("region", "next", "then", "member").sortWithinPartitions("region", "next", "then", "member")
    return ordered.mapInArrow(run, PAIRS)


def promising(pairs: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """Those of pairs(a, b) whose sizes and signatures allow a link, with the count of equal values."""
    least = settings.least_equal
    x = reps.select(F.col("member").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    y = reps.select(F.col("member").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))

    def run(stream):
        for batch in stream:
            if batch.num_rows:
                equal = _equal_values(_matrix(batch.column(2)), _matrix(batch.column(3)))
                keep = pa.array(equal >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(equal).filter(keep)], names=["a", "b", "equal"])

    both = pairs.join(x, "a").join(y, "b").where(_may_link(F.col("n_a"), F.col("n_b"), settings.percent))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, equal int")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Those of pairs(a, b) that are links on their full sets, as edges (src, dst)."""
    x = sets.select(F.col("member").alias("a"), F.col("set").alias("set_a"))
    y = sets.select(F.col("member").alias("b"), F.col("set").alias("set_b"))

    def run(stream):
        for batch in stream:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                p, q = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= settings.percent * (len(p) + len(q) - common)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["src", "dst"])

    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "src long, dst long")


def thinned(pairs: DataFrame) -> DataFrame:
    """For each document its likeliest pair and the likeliest pair with a smaller document: enough to
    join most groups with a comparison or two a document."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "equal").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "equal"))
    best = both.groupBy("x").agg(F.max(F.struct("equal", (-F.col("y")).alias("y"))).alias("m"), F.max(F.when(F.col("y") < F.col("x"), F.struct("equal", (-F.col("y")).alias("y")))).alias("s"))
    picked = best.select("x", F.explode(F.array("m", "s")).alias("p")).where(F.col("p").isNotNull()).select("x", (-F.col("p.y")).alias("y"))
    return picked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _common(one: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Size of the intersection of a set with each of some others; all are ascending."""
    slot = np.minimum(np.searchsorted(one, values), len(one) - 1)
    total = np.concatenate([[0], np.cumsum(one[slot] == values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _search_block(members: pa.RecordBatch, s: Settings) -> tuple[list[int], list[int]]:
    """Links between documents of different components in one block, one for each two components
    that they join.  Components joined on the way are not compared any further.

    Pairs that already met in an earlier order are left to the block there."""
    order, heap, member, label, n = (members.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4, 5, 6))
    label, cross = label.copy(), members.column(2)[0].as_py()
    heads = members.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, ORDERS)
    values = heads.view(np.uint16).reshape(-1, VALUES)
    edges = np.concatenate([[0], np.cumsum(members.column(8).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = members.column(8).flatten().to_numpy(zero_copy_only=False).view(np.uint64)  # ascending as such
    src, dst = [], []
    for i in range(len(member) - 1):
        later = np.arange(i + 1, len(member))
        fits = (label[later] != label[i]) & (100 * np.minimum(n[later], n[i]) >= s.percent * np.maximum(n[later], n[i]))
        if cross:
            fits &= heap[later] != heap[i]
        later = later[fits]
        if not len(later):
            continue
        equal = (values[later] == values[i]).sum(1)
        good = (equal >= s.least_equal) & ~(heads[later, : order[i]] == heads[i, : order[i]]).any(1)
        later = later[good][np.argsort(-equal[good], kind="stable")]
        own, step = flat[edges[i] : edges[i + 1]], 8
        while len(later):
            some, later = later[:step], later[step:]
            size = n[some]
            bounds = np.concatenate([[0], np.cumsum(size)])
            pick = np.repeat(edges[some] - bounds[:-1], size) + np.arange(bounds[-1])
            shared = _common(own, flat[pick], bounds)
            linked = some[100 * shared >= s.percent * (size + n[i] - shared)]
            for j in linked:
                if label[j] != label[i]:
                    src.append(member[i])
                    dst.append(member[j])
                    label[label == label[j]] = label[i]
            later = later[label[later] != label[i]]
            step *= 4
    return src, dst


def _counted(sets: DataFrame, buckets: int) -> np.ndarray:
    """How often the shingles of each bucket occur: ``buckets`` numbers."""

    def run(stream):
        count = np.zeros(buckets, np.int64)
        for batch in stream:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            count += np.bincount((flat % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    found = sets.select("set").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def rarest(values: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(the shingles that a larger partner is found by, rarest first; how many of them find it a smaller
    one).  The order is by bucket count and then hash, the same for all documents."""
    n = len(values)
    by = np.lexsort((values, count[(values % np.uint64(len(count))).astype(np.int64)]))
    as_larger = n - -(-percent * n // 100) + 1
    as_smaller = n - -(-2 * percent * n // (100 + percent)) + 1
    return values[by[:as_larger]], as_smaller


def parted(hot: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """(region, t, member, label): the documents of hot(member, label) that are connected with one of
    another component by shared rare shingles; ``region`` is the same for all that are connected."""
    s = settings
    own = sets.join(_few(hot), "member")
    count = hot.sparkSession.sparkContext.broadcast(_counted(own, s.buckets))

    def run(stream):
        for batch in stream:
            member, label, shingle, small = [], [], [], []
            for i in range(batch.num_rows):
                values, first = rarest(batch.column(2)[i].values.to_numpy().view(np.uint64), count.value, s.percent)
                shingle.append(values)
                small.append(np.arange(len(values)) < first)
                member.append(np.full(len(values), batch.column(0)[i].as_py()))
                label.append(np.full(len(values), batch.column(1)[i].as_py()))
            if member:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle).view(np.int64)), pa.array(np.concatenate(small)), pa.array(np.concatenate(member), pa.int64()), pa.array(np.concatenate(label), pa.int64())], names=["shingle", "small", "member", "label"])

    rows = scratch.table(own.select("member", "label", "set").mapInArrow(run, "shingle long, small boolean, member long, label long"), "rare")
    groups = rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("small").alias("small"), F.min("member").alias("hub"))
    shared = scratch.table(groups.where("lo <> hi AND small").select("shingle", "hub"), "shared")
    edges = rows.join(shared, "shingle").select(F.col("member").alias("src"), F.col("hub").alias("dst"))
    found = components(edges).select(F.col("id").alias("member"), F.col("component").alias("region"))
    return hot.join(found, "member").select("region", F.lit(0).alias("t"), "member", "label")


def across(rows: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Links between documents of different components that share a region, as edges (src, dst).

    Each document's set travels once to each block that it is searched in; pairs stay inside."""
    s = settings
    named = rows.select("region", "t", "member").join(labels, "member", "left").select("region", "t", "member", F.coalesce("label", "member").alias("label"))
    named = scratch.table(named, "named")
    mixed = named.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("region", "size")
    mixed = scratch.table(mixed, "mixed")
    inside = named.join(mixed, "region")
    sized = inside.where(F.col("size") <= s.block).select("region", "t", "member", "label", F.lit(1).alias("heaps"))
    if mixed.where(F.col("size") > s.block).limit(1).count():
        hot = scratch.table(inside.where(F.col("size") > s.block).select("member", "label").distinct(), "hot")
        clusters = scratch.table(parted(hot, sets, s), "clusters")
        sizes = clusters.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("heaps"))
        sized = sized.unionByName(clusters.join(sizes, "region"))
    own = F.pmod(F.xxhash64("member", "region"), F.col("heaps")).cast("int")
    dealt = sized.select("region", "t", "member", "label", own.alias("heap"), F.explode(F.sequence(F.lit(0), F.col("heaps") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("region", "t", F.least("heap", "other"), F.greatest("heap", "other")).alias("block"), "t", (F.col("heap") != F.col("other")).alias("cross"), "heap", "member", "label")
    loaded = dealt.join(reps.select("member", "n", "sig"), "member").join(sets, "member").select("block", "t", "cross", "heap", "member", "label", "n", "sig", "set")

    def run(stream):
        for batch in vectors.grouped(stream):
            src, dst = [], []
            for a, b in vectors.runs(batch.column(0).to_numpy(zero_copy_only=False)):
                x, y = _search_block(batch.slice(a, b - a), s)
                src += x
                dst += y
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return loaded.repartition("block").sortWithinPartitions("block").mapInArrow(run, "src long, dst long")


def placed(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row, doc_id, th, n, label): each document with its group's label, a stored table."""
    s = settings
    table = features(docs, s)
    solid = table.where(F.col("n") > 0)
    twins = scratch.table(solid.groupBy("fp1", "fp2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("fp1", "fp2", "rep"), "twins")
    members = scratch.table(table.select("row", "doc_id", "n", "th", "fp1", "fp2").join(twins, ["fp1", "fp2"], "left").select("row", "doc_id", "n", "th", F.coalesce("rep", "row").alias("member")), "members")
    reps = solid.join(members.where("row = member").select("row", "member"), "row", "left_semi").select(F.col("row").alias("member"), "n", "sig", "th")

    rows = regions(reps, s)
    crowded = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("region")
    rows = scratch.table(rows.join(crowded, "region", "left_semi"), "regions")
    near = rows.select("member").distinct()
    reps = scratch.table(reps.join(near, "member", "left_semi"), "reps")

    first = scratch.table(promising(neighbours(rows).distinct(), reps, s), "pairs")
    tight = scratch.table(thinned(first), "thinned")
    sets = full_sets(docs, reps.select("th", "member", "n"), s)
    links = scratch.table(confirmed(tight, sets, s), "links")
    labels = scratch.table(components(links).select(F.col("id").alias("member"), F.col("component").alias("label")), "labels")
    late = scratch.table(across(rows, reps, sets, labels, s), "late")
    if late.limit(1).count():
        labels = scratch.table(components(links.unionByName(late)).select(F.col("id").alias("member"), F.col("component").alias("label")), "labels")
    return scratch.table(members.join(labels, "member", "left").select("row", "doc_id", "th", "n", F.coalesce("label", "member").alias("label")), "placed")


def link(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id and kept; ``row`` tells the rows
    apart and ``th`` is the text's hash.  All rows with a group's smallest doc_id have ``kept``."""
    before = scratch.written()
    rows = placed(docs, settings)
    heads = scratch.table(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "heads")
    scratch.release(before, rows, heads)
    return rows.join(heads, "label").select("row", "doc_id", "th", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id, of several such (or
    where no row of the group has an id) the one with the smallest text hash.  Of rows that repeat
    doc_id and text one stays; rows without words all do.  All columns stay; texts are not shuffled
    unless too many go."""
    before = scratch.written()
    key = F.xxhash64(F.col("doc_id").cast("long"), _text_hash())
    rows = placed(docs, settings).where("n > 0")
    chosen = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("c"))
    votes = rows.select(F.xxhash64("doc_id", "th").alias("__key"), F.lit(1).alias("n"), F.lit(False).alias("stays")).unionByName(
        chosen.select(F.xxhash64("c.doc_id", "c.th").alias("__key"), F.lit(0).alias("n"), F.lit(True).alias("stays"))
    )
    decided = scratch.table(votes.groupBy("__key").agg(F.sum("n").alias("n"), F.max("stays").alias("stays")).where("NOT stays OR n > 1"), "decided")
    gone = scratch.table(decided.where("NOT stays").select("__key"), "gone")
    again = scratch.table(decided.where("stays").select("__key"), "again")
    scratch.release(before, gone, again)
    left = docs.withColumn("__key", key).join(_few(gone), "__key", "left_anti")
    once = left.join(_few(again), "__key", "left_anti").unionByName(left.join(_few(again), "__key", "left_semi").dropDuplicates(["__key"]))
    return once.select(*docs.columns)


def oracle(words: int, percent: int = 80) -> str:
    """The same in DuckDB SQL, by counting the shingles that all pairs of documents share."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i : i + {words - 1}], ' ') AS sh FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
k AS (SELECT s.r, sh, n FROM s JOIN n USING (r)),
p AS (SELECT x.r AS a, y.r AS b, x.n AS na, y.n AS nb, count(*) AS c FROM k x JOIN k y ON x.sh = y.sh AND x.r < y.r AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= {percent} * (na + nb - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
cc(node, label) USING KEY (node) AS (
  SELECT r, r FROM t UNION
  SELECT e.a, min(q.label) FROM cc q JOIN e ON e.b = q.node JOIN recurring.cc o ON o.node = e.a GROUP BY e.a HAVING min(q.label) < min(o.label)),
m AS (SELECT label, min(doc_id) AS component_id FROM cc JOIN t ON r = node GROUP BY label)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM t JOIN cc ON node = t.r JOIN m USING (label) LEFT JOIN n ON n.r = t.r"""
