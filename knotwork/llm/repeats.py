"""Passages that repeat across documents, by hashes at minimiser positions.

Suffixes are kept only where the hash of the ``gram`` words that follow is the smallest of
``passage - gram + 1`` neighbours, so the text itself selects the positions: every run of
``passage`` words holds one, and equal runs hold equal ones.  The suffixes are sorted by the
64-bit hashes of their grams across the cluster (so not in the order of their words) and grouped; those that share a gram with another document
are extended.  Extension to the left and to the right takes every window of ``passage`` words
around such a position and asks whether another document has the same window.  No window is
missed: one that two documents share holds a kept suffix in both, so both are compared.  Windows
are compared by 64-bit hashes, so two different ones are taken for equal with a chance of n^2 / 2^65
among n of them.
Overlapping windows make up the maximal repeated spans.

Of a repeated window the document with the smallest doc_id holds the first copy; all others are
later copies, and ``deduplicated`` cuts those out.

Defined results: null and empty texts and texts under ``passage`` words have no span; words are
compared with A-Z folded; a passage that repeats only within one document is not reported;
rows with the same doc_id are one document, each row without a doc_id is one of its own and
goes before those with one; exact copies of a
document are one span each if long enough; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import tokens, vectors
from knotwork.llm.near_dup import _few
from knotwork.plans import scratch

_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    passage: int = 50  # words
    gram: int = 25  # words that kept suffixes are sorted by


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over each run of ``width`` entries, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = best(x[:-step], x[step:])
        span += step
    return x


def kept_suffixes(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions whose gram is the smallest of some ``width`` neighbours.  Of a run of equal grams
    the ends and every ``width``-th position are enough to meet every window."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    least = _slide(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    reach = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    chosen = grams == reach
    same = np.concatenate([[False], grams[1:] == grams[:-1]])
    if same.any():
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(grams))))
        last = np.append(~same[1:], True)
        chosen &= last | ((np.arange(len(grams)) - start) % width == 0)
    return np.flatnonzero(chosen)


ANCHORS = "anchor long, doc long, pos int"


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(docs with ``__doc``, a key of each document; the keys of rows without a doc_id, None if there
    are none).  Those rows are stored, as their keys have to be the same whenever they are read."""
    docs = docs.withColumn("__doc", F.col("doc_id").cast("long"))
    bare = docs.where(F.col("__doc").isNull())
    if not bare.limit(1).count():
        return docs, None
    stored = scratch.table(bare.withColumn("__doc", F.lit(_NO_ID) + F.monotonically_increasing_id()), "nameless")
    return docs.where(F.col("__doc").isNotNull()).unionByName(stored), stored


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("__doc").alias("doc"), F.col("text").cast("string").alias("text"))


def suffixes(docs: DataFrame, s: Settings) -> DataFrame:
    width = s.passage - s.gram + 1

    def run(stream):
        for batch in stream:
            for part in tokens.batches(batch, "text"):
                hashes, first, *_ = tokens.words_of(part.column(1))
                grams = tokens.chain(hashes, s.gram)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                anchor, doc, pos = [], [], []
                for i in np.flatnonzero(np.diff(first) >= s.passage):
                    own = grams[first[i] : first[i + 1] - s.gram + 1]
                    at = kept_suffixes(own, width)
                    anchor.append(own[at])
                    doc.append(np.full(len(at), ids[i]))
                    pos.append(at)
                if anchor:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchor).view(np.int64)), pa.array(np.concatenate(doc), pa.int64()), pa.array(np.concatenate(pos).astype(np.int32))], names=["anchor", "doc", "pos"])

    return _texts(docs).mapInArrow(run, ANCHORS)


def shared_suffixes(sorted_rows: DataFrame) -> DataFrame:
    """Those of the suffixes whose gram another document has too.

    Rows are range-partitioned by (anchor, doc, pos), so a hot gram spreads over partitions.  Grams
    at a partition's two ends may go on in the next one: their rows wait, and the ends of all
    partitions, two rows each, are compared with each other."""

    def run(stream):
        first = held = None
        for batch in vectors.grouped(stream):
            anchor, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
            low, high = np.minimum.reduceat(doc, cuts), np.maximum.reduceat(doc, cuts)
            size = np.diff(np.append(cuts, len(anchor)))
            kind = np.where(low != high, 1, 0)
            if held is not None:
                yield from told(*held)
            if first is None:
                first = True
                kind[0] = 2
                yield summary(anchor[:1], low[:1], high[:1])
            # the last gram of this stretch may be the partition's last one
            tail = cuts[-1]
            held = (anchor[tail:], doc[tail:], pos[tail:], kind[-1], low[-1], high[-1])
            wide = np.repeat(kind, size)[:tail]
            keep = np.flatnonzero(wide)
            yield rows(wide[keep], anchor[:tail][keep], doc[:tail][keep], pos[:tail][keep])
        if held is not None:
            anchor, doc, pos, kind, low, high = held
            if kind != 2:
                yield summary(anchor[:1], np.array([low]), np.array([high]))
            yield rows(np.full(len(anchor), 2), anchor, doc, pos)

    def told(anchor, doc, pos, kind, low, high):
        if kind:
            yield rows(np.full(len(anchor), kind), anchor, doc, pos)

    def rows(kind, anchor, doc, pos):
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(anchor), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(doc)], names=["kind", "anchor", "doc", "pos", "high"])

    def summary(anchor, low, high):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(anchor), 3, np.int32)), pa.array(anchor), pa.array(low), pa.array(np.zeros(len(anchor), np.int32)), pa.array(high)], names=["kind", "anchor", "doc", "pos", "high"])

    found = scratch.table(
        sorted_rows.repartitionByRange("anchor", "doc", "pos").sortWithinPartitions("anchor", "doc", "pos").mapInArrow(run, "kind int, anchor long, doc long, pos int, high long"),
        "shared",
    )
    ends = found.where("kind = 3").groupBy("anchor").agg(F.min("doc").alias("low"), F.max("high").alias("top")).where("low <> top").select("anchor", F.lit(True).alias("met"))
    known = found.where("kind <> 3").join(F.broadcast(ends), "anchor", "left")  # ends: at most two rows a partition
    return known.where("kind = 1 OR met").select("doc", "pos")


def windows(docs: DataFrame, places: DataFrame, s: Settings) -> DataFrame:
    """(doc, th, pos[], window[]) of the windows around each document's shared suffixes; th: the text's hash."""
    reach = s.passage - s.gram

    def run(stream):
        for batch in stream:
            for part in tokens.batches(batch, "text"):
                hashes, first, *_ = tokens.words_of(part.column(1))
                ids, lists, th = part.column(0), part.column(2), part.column(3)
                edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                whole = tokens.chain(hashes, s.passage)
                pos, win, size = [], [], np.zeros(part.num_rows, np.int64)
                for i in range(part.num_rows):
                    n = first[i + 1] - first[i] - s.passage + 1  # windows of this text
                    if n <= 0:
                        continue
                    at = flat[edges[i] : edges[i + 1]].astype(np.int64)
                    at = at[at < n + reach]
                    near = np.zeros(n + 1, np.int64)
                    np.add.at(near, np.clip(at - reach, 0, n), 1)
                    np.add.at(near, np.clip(at + 1, 0, n), -1)
                    mine = np.flatnonzero(np.cumsum(near[:-1]))
                    pos.append(mine)
                    win.append(whole[first[i] : first[i] + n][mine])
                    size[i] = len(mine)
                bounds = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                pos = np.concatenate(pos) if pos else np.zeros(0, np.int64)
                win = np.concatenate(win) if win else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([ids, th, pa.ListArray.from_arrays(bounds, pa.array(pos.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(win.view(np.int64)))], names=["doc", "th", "pos", "win"])

    wanted = scratch.table(places.groupBy("doc").agg(F.collect_set("pos").alias("at")), "places")  # a document's own positions
    keys = scratch.table(wanted.select("doc"), "keys")
    texts = _texts(docs).where(F.col("text").isNotNull()).join(_few(keys), "doc", "left_semi")
    return scratch.table(texts.join(wanted, "doc").select("doc", "text", "at", F.xxhash64("text")).mapInArrow(run, "doc long, th long, pos array<int>, win array<long>"), "windows")


def _found(keyed: DataFrame, s: Settings) -> DataFrame:
    """doc, th, start, stop, copy of the spans of each text; keyed: see ``_keyed``."""
    before = scratch.written()
    places = shared_suffixes(scratch.table(suffixes(keyed, s), "suffixes"))
    table = windows(keyed, places, s)
    each = table.select("doc", F.explode("win").alias("win"))
    owners = each.groupBy("win").agg(F.min("doc").alias("doc"), F.max("doc").alias("top"))
    # a document's windows that are its own alone, and those of which it has the first copy
    own = owners.groupBy("doc").agg(F.collect_list(F.when(F.col("doc") == F.col("top"), F.col("win"))).alias("alone"), F.collect_list(F.when(F.col("doc") != F.col("top"), F.col("win"))).alias("firsts"))
    own = scratch.table(own, "own")
    scratch.release(before, table, own)

    def run(stream):
        for batch in stream:
            out: list[list] = [[], [], [], [], []]
            ids, hashes = batch.column(0).to_pylist(), batch.column(5).to_pylist()
            for i in range(batch.num_rows):
                pos, win = batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                if not len(pos):
                    continue
                alone, firsts = (np.zeros(0, np.int64) if batch.column(c)[i].values is None else batch.column(c)[i].values.to_numpy() for c in (3, 4))
                rest = ~np.isin(win, alone)
                first = np.isin(win, firsts)
                for mask, copy in ((rest & first, False), (rest & ~first, True)):
                    at = pos[mask]
                    if len(at):
                        cut = np.flatnonzero(np.diff(at) > s.passage)
                        out[0] += [ids[i]] * (len(cut) + 1)
                        out[1] += at[np.concatenate([[0], cut + 1])].tolist()
                        out[2] += (at[np.append(cut, len(at) - 1)] + s.passage).tolist()
                        out[3] += [copy] * (len(cut) + 1)
                        out[4] += [hashes[i]] * (len(cut) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.int64())], names=["doc", "start", "stop", "copy", "th"])

    return table.join(own, "doc", "left").select("doc", "pos", "win", "alone", "firsts", "th").mapInArrow(run, "doc long, start long, stop long, copy boolean, th long")


def spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, start, stop (words, stop exclusive), copy: the maximal repeated spans.  copy is false
    for the parts that no document with a smaller doc_id has, true for later copies."""
    keyed, bare = _keyed(docs)
    found = _found(keyed, settings).select("doc", "start", "stop", "copy").distinct()
    if bare is None:
        return found.select(F.col("doc").alias("doc_id"), "start", "stop", "copy")
    keys = scratch.table(bare.select(F.col("__doc").alias("doc")), "bare")
    named = found.join(_few(keys.withColumn("bare", F.lit(True))), "doc", "left")
    return named.select(F.when(F.col("bare").isNull(), F.col("doc")).alias("doc_id"), "start", "stop", "copy")


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with later copies of repeated passages cut out of ``text``; the words that stay are
    joined by single spaces where something was cut, other texts do not change."""
    keyed, _ = _keyed(docs)
    found = _found(keyed, settings).where("copy").distinct()  # by text too: rows of one doc_id may differ
    cuts = found.groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__th")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__cuts"))
    word = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    left = F.filter(word, lambda w, i: ~F.exists("__cuts", lambda c: (i >= c["start"]) & (i < c["stop"])))
    hashed = keyed.withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    return hashed.join(cuts, ["__doc", "__th"], "left").withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(left, " "))).select(*docs.columns)


def oracle(passage: int = 50) -> str:
    """The same spans in DuckDB SQL, from all windows of all documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {passage}], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - {passage - 1})) AS i FROM t WHERE len(w) >= {passage})),
o AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT DISTINCT doc_id, i, doc_id <> first AS copy FROM p JOIN o USING (win)),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, copy ORDER BY i) <= {passage} THEN 0 ELSE 1 END AS brk FROM c),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, copy ORDER BY i) AS run FROM g)
SELECT doc_id, min(i) AS start, max(i) + {passage} AS stop, copy FROM r GROUP BY doc_id, copy, run"""
