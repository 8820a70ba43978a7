"""Toxicity scores from sub-word bags.

Every term is a bag of hashed character n-grams, its embedding their mean; the mean over a
window of terms goes through a linear softmax.  Embeddings and softmax are trained jointly,
in numpy, on a bounded sample of labelled documents.  A document's label holds for its worst
window, so training follows the window that scores highest and a document's score is the
highest of its windows' probabilities; all windows of the whole text count, each an average of
``window`` terms (a whole text's average would drown one insult among 20,000 words).  A term that
only repeats the one before it counts once, so that junk cannot fill a window with one word.  Unseen
misspellings share n-gram vectors with the terms they come from.

Defined results: null or empty texts and texts without terms have no window and get the
score 0.0; repeated documents are each scored; repeated labels of one document count as
toxic if any is; null labels are not used; with no label, or labels of one kind only, all
scores are the share of toxic labels (0.0 without labels).  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import sampling, tokens
from knotwork.llm.subwords import Terms, mean_by


@dataclass(frozen=True)
class Settings:
    sample: int = 2000  # labelled documents of each class that training uses at most
    longest: int = 200_000  # characters of a training text at most; scoring has no limit
    window: int = 3  # terms
    buckets: int = 1 << 17
    size: int = 16
    shortest_gram: int = 3
    longest_gram: int = 6
    least_texts: int = 3  # texts that must hold a feature before it is learnt
    decay: float = 3e-3
    epochs: int = 12
    rate: float = 0.4
    unknown: float = -3.0  # log odds of a window without a known feature
    seed: int = 17


@dataclass
class Model:
    """What scoring needs of embeddings and softmax: each feature's share of the logit."""

    feature: np.ndarray
    bias: float
    settings: Settings
    constant: float | None = None


def _windows(score: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its highest window mean, that window's first term and its length (0: no term)."""
    n = len(first) - 1
    total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    length = np.minimum(np.diff(first), width)
    count = np.diff(first) - length + (length > 0)
    start = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=start[1:])
    owner = np.repeat(np.arange(n), count)
    at = np.arange(start[-1]) - start[owner] + first[owner]
    mean = (total[at + length[owner]] - total[at]) / length[owner]
    best, where = np.full(n, -np.inf), np.zeros(n, np.int64)
    some = count > 0
    if some.any():
        best[some] = np.maximum.reduceat(mean, start[:-1][some])
        hit = np.flatnonzero(mean == best[owner])
        texts, index = np.unique(owner[hit], return_index=True)
        where[texts] = at[hit[index]]
    return best, where, length


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    s = settings
    y = np.asarray(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), 0.0, s, constant=float(y[0]) if len(y) else 0.0)
    terms = Terms(pa.array(texts, pa.string()), stutter=False)
    rng = np.random.default_rng(s.seed)
    embed = rng.normal(0, 0.1, (s.buckets, s.size)).astype(np.float32)
    soft = rng.normal(0, 0.5, (s.size, 2)).astype(np.float32)
    bias = np.array([0.0, s.unknown], np.float32)  # held: a window of which nothing is known is clean
    seen = np.full(s.buckets, 1e-3, np.float32)
    soft_seen = np.full_like(soft, 1e-3)
    ids, first = terms.features(s.shortest_gram, s.longest_gram, s.buckets)
    # a feature of few texts says nothing of others: it stays at the mean of all, zero
    pairs = np.unique(terms.kind.astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), np.diff(terms.first))) // max(len(texts), 1)
    held, spread = np.bincount(pairs, minlength=len(first) - 1), np.zeros(s.buckets)
    for i in range(0, len(held), 1 << 15):
        j = min(i + (1 << 15), len(held))
        spread += np.bincount(ids[first[i] : first[j]], weights=np.repeat(held[i:j], np.diff(first[i : j + 1])), minlength=s.buckets)
    known = spread >= s.least_texts
    embed[~known] = 0
    count = np.diff(first)
    usable = np.flatnonzero(np.diff(terms.first) > 0)
    for epoch in range(s.epochs):
        gap = soft[:, 1] - soft[:, 0]
        weight = mean_by((embed @ gap)[ids], first)[terms.kind]
        _, where, length = _windows(weight, terms.first, s.window)
        if epoch == 0:  # nothing is known yet: whole texts
            where, length = terms.first[:-1].copy(), np.diff(terms.first)
        picks = np.stack([where, length], 1)[usable]
        extra = usable[y[usable] == 0]  # of clean documents any window is clean
        room = np.diff(terms.first)[extra]
        width = np.minimum(room, s.window)
        shift = (rng.random(len(extra)) * (room - width + 1)).astype(np.int64)
        picks = np.concatenate([picks, np.stack([terms.first[:-1][extra] + shift, width], 1)])
        truth = np.concatenate([y[usable], y[extra]])
        order = rng.permutation(len(truth))
        for i in range(0, len(order), 128):
            rows = order[i : i + 128]
            at, size = picks[rows].T
            flat = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            kinds, inverse = np.unique(terms.kind[flat], return_inverse=True)
            own = np.repeat(first[kinds] - np.concatenate([[0], np.cumsum(count[kinds])[:-1]]), count[kinds]) + np.arange(count[kinds].sum())
            grams = ids[own]
            bounds = np.concatenate([[0], np.cumsum(count[kinds])])
            vectors = mean_by(embed[grams], bounds)
            edges = np.concatenate([[0], np.cumsum(size)])
            mean = mean_by(vectors[inverse], edges)
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), truth[rows]] -= 1
            g_soft = mean.T @ p / len(rows)
            g_mean = (p @ soft.T) / size[:, None]
            by_kind = np.argsort(inverse, kind="stable")
            per_kind = np.add.reduceat(np.repeat(g_mean, size, axis=0).astype(np.float32)[by_kind], np.searchsorted(inverse[by_kind], np.arange(len(kinds))), axis=0)
            per_kind /= count[kinds][:, None]
            by_gram = np.argsort(grams, kind="stable")
            new = np.flatnonzero(np.diff(grams[by_gram], prepend=-1))
            touched = grams[by_gram][new]
            g_embed = np.add.reduceat(np.repeat(per_kind, count[kinds], axis=0)[by_gram], new, axis=0)
            keep = known[touched]
            touched, g_embed = touched[keep], g_embed[keep]
            seen[touched] += (g_embed**2).mean(1)
            embed[touched] -= s.rate * (g_embed / np.sqrt(seen[touched])[:, None] + s.decay * embed[touched])
            soft_seen += g_soft**2
            soft -= 0.1 * g_soft / np.sqrt(soft_seen)
    return Model(embed @ (soft[:, 1] - soft[:, 0]), s.unknown, s)


def predict(model: Model, column: pa.Array) -> np.ndarray:
    n = len(column)
    if model.constant is not None:
        return np.full(n, model.constant)
    terms = Terms(column, stutter=False)
    if not len(terms.hashes):
        return np.zeros(n)
    s = model.settings
    ids, first = terms.features(s.shortest_gram, s.longest_gram, s.buckets)
    weight = mean_by(model.feature[ids], first)[terms.kind]
    best, _, length = _windows(weight, terms.first, s.window)
    return np.where(length > 0, 1 / (1 + np.exp(-np.clip(best + model.bias, -60, 60))), 0.0)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 4, held_out: int = 2) -> Model:
    """Fit on at most ``settings.sample`` documents of each class outside the held-out fold."""
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (sampling.crc_fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    marked = {i: c for c in (0, 1) for i in sampling.smallest_by_hash(rows.where(F.col("toxic") == c), "doc_id", settings.sample)}
    found = sampling.fetch_texts(docs, list(marked), settings.longest)
    return fit([t for _, t in found], [marked[i] for i, _ in found], settings)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with one more column, the toxicity score; the scan is the only pass and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: settings.buckets numbers
    schema = docs.drop(column).withColumn(column, F.lit(0.0)).schema

    def run(stream):
        for batch in stream:
            for part in tokens.batches(batch, "text"):
                values = predict(shared.value, part.column(part.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=[*part.schema.names, column])

    return docs.drop(column).mapInArrow(run, schema)
