"""Mix sources to target weights over fixed-length blocks of words.

The words of a source's documents, in a pseudorandom order, form one stream that is packed
into blocks of ``block`` words (the last one may be shorter).  Source weights become targets
in words, none above ``most`` times its source, and targets become slots.  How many of a
source's slots go to each output shard is a multinomial draw, made by halving the shards and
drawing a binomial at each node, so that every range of shards can be drawn alone and a
source's counts add up to its slots.  Shards hold ``shard`` slots on average.  A source's n-th
slot is mapped through pseudorandom permutations of its block numbers, one for each pass over
the source, and joined with the blocks by number.  The last slot of a source is cut to the
words that its target still lacks, so that targets are met to a word.

No table reaches the driver, only sums.  Running offsets are two-level sums, about sqrt(n) rows in
each window, so that a hot source is as spread as any other; its slots are drawn in parts.

Defined results: null texts count no word and a null source is a source of its own, last in
order; documents without words are never taken; rows that repeat are documents of their own;
an empty table gives an empty mix; further columns do not matter.  Reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans import scratch

WORD = r"[^\x20\x09-\x0D]+"
_DRAWN = 1 << 16  # slots that are made together


@dataclass(frozen=True)
class Settings:
    block: int = 256  # words
    shard: int = 1024  # slots of an output shard, on average
    most: int = 3  # times that a source may be taken
    seed: int = 29


# --- permutations -------------------------------------------------------------------------


def _round(x: np.ndarray, key: np.ndarray, mask: np.ndarray) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & mask


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: Feistel rounds on the next even number
    of bits, walked on until the value falls below size.  Arrays of one length."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1)).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            k_r = k + np.uint64(0xD1342543DE82EF95 * ((3 - r if inverse else r) + 1) & 0xFFFFFFFFFFFFFFFF)
            if inverse:
                left, right = right ^ _round(left, k_r, m), left
            else:
                left, right = right, left ^ _round(right, k_r, m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _key(seed: int, rank: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return (np.uint64(seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF) + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (turn.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


# --- targets ------------------------------------------------------------------------------


def cycle_weight(place: Column) -> Column:
    """1, 2, 3, repeating, for places from 1."""
    return ((place - 1) % 3 + 1).cast("double")


def ranked(totals: DataFrame) -> DataFrame:
    """totals(source, ...) with ``rank``, from 1, by code point, null last: places inside sorted
    partitions, and the number of rows in the partitions before."""
    ordered = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = scratch.checkpoint(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["__part"]: r["n"] for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a partition
    before, base = 0, []
    for p in sorted(sizes):
        base.append((p, before))
        before += sizes[p]
    bases = totals.sparkSession.createDataFrame(base, "__part long, __base long")
    return placed.withColumn("__part", part).join(F.broadcast(bases), "__part").withColumn("rank", F.col("__base") + place + 1).drop("__part", "__base", "__at")


def targets(sized: DataFrame, settings: Settings = Settings(), weights: DataFrame | None = None) -> DataFrame:
    """(source, rank, source_size, target): one row a source.  ``weights`` (source, weight) replaces
    the cycle; sources that it lacks weigh 0.

    Sources that reach ``most`` times their size stop there and the others share what is left by
    weight, which may bring more of them to their cap: the level (words for a weight of 1) rises
    until it does not.  Only sums over the sources reach the driver."""
    own = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    if weights is None:
        own = own.withColumn("weight", cycle_weight(F.col("rank")))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.max("weight").cast("double").alias("weight"))
        own = own.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    own = scratch.checkpoint(own.withColumn("cap", F.col("source_size") * settings.most).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))))
    level, full = 0.0, -1
    while True:
        at = F.coalesce(F.col("ratio") < level, F.lit(False))
        sums = own.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(at, F.col("cap")).otherwise(0)).alias("capped"),
            F.sum(F.when(~at, F.col("weight")).otherwise(0.0)).alias("weight"),
            F.sum(at.cast("long")).alias("full"),
        ).first()
        if sums["total"] is None or not sums["weight"] or sums["full"] == full:
            break
        full, level = sums["full"], (sums["total"] - sums["capped"]) / sums["weight"]
    cap = F.col("cap").cast("double")
    target = F.when(F.col("weight") > 0, F.least(cap, F.lit(level) * F.col("weight"))).otherwise(0.0)
    if sums["total"] is not None and not sums["weight"]:
        target = F.when(F.col("weight") > 0, cap).otherwise(0.0)  # all are at their cap
    return own.select("source", "rank", "source_size", target.alias("target"))


# --- slots --------------------------------------------------------------------------------


def plan(rank: np.ndarray, size: np.ndarray, target: np.ndarray, settings: Settings) -> pd.DataFrame:
    """(rank, size, blocks, slots, cut) with the number of slots that take round(target) words of a
    source when the last one takes ``cut`` words only."""
    words = np.minimum(np.rint(target).astype(np.int64), size * settings.most)
    length = settings.block
    blocks = -(-size // length)
    turns, rest = words // np.maximum(size, 1), words % np.maximum(size, 1)
    turns[size == 0] = rest[size == 0] = 0
    short = size - (blocks - 1) * length
    place = np.zeros(len(size), np.int64)  # of the short block in the last pass
    some = np.flatnonzero(size > 0)
    place[some] = permuted(blocks[some] - 1, blocks[some], _key(settings.seed, rank[some], turns[some]), inverse=True)
    early = rest > place * length + short  # the short block is taken whole on the way
    beyond = np.where(early, rest - short, rest)
    full = -(-beyond // length)
    cut = beyond - (full - 1) * length
    on_short = ~early & (full - 1 == place) & (rest > 0)
    cut = np.where(on_short, rest - place * length, cut)
    last = np.where(rest > 0, full + early, 0)
    ends_early = early & (beyond == 0)
    cut = np.where(rest == 0, 0, np.where(ends_early, short, cut))
    return pd.DataFrame({"rank": rank, "size": size, "blocks": blocks, "slots": turns * blocks + last, "cut": cut})


def draws(rank: int, total: int, shards: int, low: int, high: int, settings: Settings) -> list[tuple[int, int, int]]:
    """(shard, slots of a source in the shards before it, slots in it) for the shards low to high that
    get any of its ``total`` slots: halve the shards, drawing at each node how many go to the left."""
    out, nodes = [], [(0, shards, 0, total)]
    while nodes:
        a, b, before, n = nodes.pop()
        if not n or b <= low or a >= high:
            continue
        if b - a == 1:
            out.append((a, before, n))
            continue
        middle = (a + b) // 2
        left = int(np.random.default_rng([settings.seed, rank, a, b]).binomial(n, (middle - a) / (b - a)))
        nodes += [(middle, b, before + left, n - left), (a, middle, before, left)]
    return out


PLANNED = "rank long, size long, blocks long, slots long, cut long"
SLOTS = "shard long, slot long, rank long, turn long, block long, take long"


def planned(targeted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``plan`` for targets(rank, source_size, target)."""

    def run(stream):
        for t in stream:
            yield plan(t["rank"].to_numpy(np.int64), t["source_size"].to_numpy(np.int64), t["target"].to_numpy(np.float64), settings)

    return scratch.table(targeted.select("rank", "source_size", "target").mapInPandas(run, PLANNED), "planned")


def slots(table: DataFrame, shards: int, settings: Settings = Settings()) -> DataFrame:
    """Every slot of the mix: its shard, its place there (in ascending order of ``slot``), and the
    source's block that it takes ``take`` words of."""
    parts = F.greatest(F.lit(1), F.least(F.lit(shards), F.ceil(F.col("slots") / _DRAWN)))

    def run(stream):
        for frame in stream:
            for p in frame.itertuples():
                drawn = draws(p.rank, p.slots, shards, p.part * shards // p.parts, (p.part + 1) * shards // p.parts, settings)
                for i in range(0, len(drawn), 64):
                    some = np.array(drawn[i : i + 64])
                    for c in range(some[0, 1], some[-1, 1] + some[-1, 2], _DRAWN):
                        nth = np.arange(c, min(c + _DRAWN, some[-1, 1] + some[-1, 2]))
                        rank, size, blocks = (np.full(len(nth), x) for x in (p.rank, p.size, p.blocks))
                        turn, index = nth // blocks, nth % blocks
                        block = permuted(index, blocks, _key(settings.seed, rank, turn))
                        take = np.minimum(settings.block, size - block * settings.block)
                        if p.cut and nth[-1] == p.slots - 1:
                            take[-1] = min(take[-1], p.cut)
                        shard = some[np.searchsorted(some[:, 1], nth, side="right") - 1, 0]
                        place = (_key(settings.seed + 1, rank, nth) >> np.uint64(1)).astype(np.int64)
                        yield pd.DataFrame({"shard": shard, "slot": place, "rank": rank, "turn": turn, "block": block, "take": take})

    spread = table.where("slots > 0").withColumn("parts", parts.cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return spread.repartition("rank", "part").mapInPandas(run, SLOTS)


# --- blocks -------------------------------------------------------------------------------


def pieces(sized: DataFrame, targeted: DataFrame, rows: int, settings: Settings = Settings()) -> DataFrame:
    """(rank, block, row, start, length, at): the part of a document, from word ``start``, that lies
    in a block of its source's stream from word ``at`` of the block."""
    heaps = max(1, int(rows**0.5))
    own = sized.where(F.col("size") > 0).withColumn("heap", F.pmod(F.xxhash64("row"), F.lit(heaps)))
    heads = own.groupBy("source", "heap").agg(F.sum("size").alias("heap_size"))
    upto = lambda *order: Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("source", "heap", F.coalesce(F.sum("heap_size").over(upto("source", "heap")), F.lit(0)).alias("heap_start"))
    ranks = targeted.select(F.col("source").alias("_s"), "rank")
    heads = heads.join(ranks, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    inner = own.withColumn("within", F.coalesce(F.sum("size").over(upto("source", "heap", "row")), F.lit(0)))
    both = inner.alias("i").join(heads.alias("h"), F.col("i.source").eqNullSafe(F.col("h.source")) & (F.col("i.heap") == F.col("h.heap")))
    begin = F.col("begin")
    length = F.lit(settings.block)
    first, last = F.floor(begin / length), F.floor((begin + F.col("size") - 1) / length)
    cut = both.select("rank", "row", "size", (F.col("heap_start") + F.col("within")).alias("begin")).withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(begin, F.col("block") * length)
    high = F.least(begin + F.col("size"), (F.col("block") + 1) * length)
    return cut.select("rank", "block", "row", (low - begin).alias("start"), (high - low).alias("length"), (low - F.col("block") * length).alias("at"))


@dataclass
class Mix:
    """sized(row, key columns, source, size), targets(source, rank, source_size, target) and
    taken(shard, slot, turn, row, start, words): the runs of words that the mix takes."""

    sized: DataFrame
    targets: DataFrame
    taken: DataFrame


def mix(docs: DataFrame, keys: dict[str, Column], settings: Settings = Settings(), weights: DataFrame | None = None) -> Mix:
    """Mix docs(text, source); ``keys`` are columns that identify documents to the caller."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in keys.items()], F.col("source").alias("source"), size.alias("size")), "sized")
    targeted = scratch.table(targets(sized, settings, weights), "targets")
    table = planned(targeted, settings)
    total = table.agg(F.sum("slots")).first()[0] or 0
    chosen = scratch.table(slots(table, max(1, -(-total // settings.shard)), settings), "slots")  # real sizes: the planner can't guess them
    joined = chosen.join(pieces(sized, targeted, sized.count(), settings), ["rank", "block"])
    words = F.least(F.col("at") + F.col("length"), F.col("take")) - F.col("at")
    return Mix(sized, targeted, joined.where(F.col("at") < F.col("take")).select("shard", "slot", "turn", "row", "start", words.alias("words")))


def shares(mixed: Mix) -> DataFrame:
    """Each document's key columns, size, source_size, target and the words taken of it."""
    got = mixed.taken.groupBy("row").agg(F.sum("words").alias("taken"))
    plan_rows = mixed.targets.select(F.col("source").alias("_s"), "source_size", "target")
    return (
        mixed.sized.join(got, "row", "left")
        .join(plan_rows, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(*[c for c in mixed.sized.columns if c not in ("row", "source", "size")], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits that tell rows apart, by two hashes of all columns: rows that agree are copies."""
    values = [F.map_entries(c) if t.startswith("map<") else F.col(f"`{c}`") for c, t in docs.dtypes]
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *[x for v in values for x in (v, v.isNull())])]


def applied(docs: DataFrame, settings: Settings = Settings(), weights: DataFrame | None = None) -> DataFrame:
    """The mix as documents: docs' columns, a row for each pass that takes words of a document.  A
    document that a pass takes whole keeps its text; of others ``text`` holds the words taken, in
    order, joined by single spaces.  Documents that the mix takes nothing of have no row."""
    keys = dict(zip(("__key", "__key2"), row_keys(docs)))
    mixed = mix(docs, keys, settings, weights)
    run = F.struct("start", "words")
    taken = mixed.taken.groupBy("row", "turn").agg(F.sort_array(F.collect_list(run)).alias("__runs"), F.sum("words").alias("__taken"))
    taken = taken.join(mixed.sized.select("row", *keys, "size"), "row").select(*keys, "__runs", (F.col("__taken") == F.col("size")).alias("__whole"))
    word = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice("__words", (r["start"] + 1).cast("int"), r["words"].cast("int")))), " ")
    joined = docs.withColumns(keys).dropDuplicates([*keys]).join(taken, [*keys])
    return joined.withColumn("__words", F.when(~F.col("__whole"), word)).withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(some)).select(*[F.col(f"`{c}`") for c in docs.columns])
