"""Language identification with a linear-chain conditional random field.

Every term of a text is a position of the chain and every language a state.  Emissions are
sums of learned weights of the term's hashed features: itself (the lexicon), its prefixes and
suffixes, and its character n-grams.  Transitions are learned with them, on sequences that
switch language now and then, as code-switched text does.  Forward-backward gives each term's
posterior; a document's language is the one with the highest mean posterior over its whole
text, and that mean is its score.

A long text is cut into runs of ``run`` terms.  Each run is first reduced to its transfer
matrix, the runs' matrices are chained, and then all runs are solved at once with their exact
messages from both sides, so that a text of any length is solved exactly in a bounded number of
vectorised steps.  Transfer matrices cost the languages cubed at every term, so with more than
``_WIDE`` of them the messages are passed term by term, all texts of a batch at once; the result
is the same.

Every language outside the held-out fold is learned, however many there are.  What is bounded is
their sample (``documents`` and ``characters`` in all, divided evenly) and the weights: beyond 128
languages features share fewer buckets.  Time a term grows with the square of the languages.

Defined results: null texts and texts without a letter get ``und`` and the score 0.0; ties go
to the language that sorts first; without labelled rows everything is ``und``; with one
language only, every text with a letter gets it with the score 1.0; repeated rows are each
labelled; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import sampling, tokens
from knotwork.llm.subwords import Terms, mean_by

UNKNOWN = "und"
_WIDE = 16  # languages


@dataclass(frozen=True)
class Settings:
    sample: int = 600  # labelled documents of each language that training uses at most
    documents: int = 24_000  # of all languages together, one each at least
    longest: int = 100_000  # characters of a training text that are read; labelling has no limit
    characters: int = 240_000_000  # of all training texts together
    buckets: int = 1 << 17
    cells: int = 1 << 24  # buckets times languages at most, down to 1024 buckets
    shortest_gram: int = 2
    longest_gram: int = 4
    affixes: int = 3
    sequences: int = 6000  # or ``quota`` times the languages, if that is more
    quota: int = 30
    length: int = 24  # terms of a training sequence
    stay: float = 0.9  # chance that a training sequence goes on in its language
    epochs: int = 3
    rate: float = 0.3
    run: int = 128
    seed: int = 5


@dataclass
class Model:
    languages: list[str]
    emission: np.ndarray  # (buckets, languages)
    transition: np.ndarray  # (languages, languages), log scale
    start: np.ndarray
    settings: Settings


def _emissions(terms: Terms, weight: np.ndarray, s: Settings) -> np.ndarray:
    """(distinct terms, languages)"""
    ids, first = terms.features(s.shortest_gram, s.longest_gram, s.buckets, s.affixes)
    return _means(weight, ids, first)


def _means(weight: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """mean_by(weight[ids], first), for some languages at a time."""
    if not len(ids):
        return np.zeros((0, weight.shape[1]), weight.dtype)
    return np.concatenate([mean_by(weight[:, a : a + _WIDE][ids], first) for a in range(0, weight.shape[1], _WIDE)], axis=1)


def _messages(e: np.ndarray, trans: np.ndarray, start: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors (n, t, L), expected transitions (L, L)) of sequences padded to one length;
    e: exponentiated emissions, trans and start exponentiated too."""
    n, t, k = e.shape
    forward, scale = np.empty_like(e), np.ones((n, t))
    a = start[None, :] * e[:, 0]
    for i in range(t):
        if i:
            a = np.where(alive[:, i, None], (a @ trans) * e[:, i], a)
        scale[:, i] = a.sum(1)
        a = a / scale[:, i, None]
        forward[:, i] = a
    back = np.ones((n, k))
    post = np.empty_like(e)
    post[:, t - 1] = forward[:, t - 1]
    moved = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        ahead = e[:, i] * back / scale[:, i, None]
        use = alive[:, i]
        moved += (forward[use, i - 1].T @ ahead[use]) * trans
        back = np.where(use[:, None], ahead @ trans.T, back)
        post[:, i - 1] = forward[:, i - 1] * back
    return post / post.sum(2, keepdims=True), moved


def fit(texts: list[str], languages: list[str], settings: Settings = Settings()) -> Model:
    s = settings
    names = sorted(set(languages))
    k = len(names)
    if k < 2:
        return Model(names, np.zeros((1, max(k, 1))), np.zeros((k, k)), np.zeros(k), s)
    s = replace(s, buckets=min(s.buckets, 1 << max(10, (s.cells // k).bit_length() - 1)), sequences=max(s.sequences, s.quota * k))
    rng = np.random.default_rng(s.seed)
    terms = Terms(pa.array(texts, pa.string()))
    ids, first = terms.features(s.shortest_gram, s.longest_gram, s.buckets, s.affixes)
    count = np.diff(first)
    label = np.searchsorted(names, languages)
    spans = [[(terms.first[i], terms.first[i + 1]) for i in np.flatnonzero(label == j) if terms.first[i + 1] > terms.first[i]] for j in range(k)]
    usable = [j for j in range(k) if spans[j]]
    kinds, truth = np.zeros((s.sequences, s.length), np.int64), np.zeros((s.sequences, s.length), np.int64)
    for q in range(s.sequences):  # pieces of documents, switching language now and then
        at = 0
        while at < s.length:
            j = usable[rng.integers(len(usable))]
            a, b = spans[j][rng.integers(len(spans[j]))]
            size = min(int(rng.geometric(1 - s.stay)), s.length - at, int(b - a))
            a += rng.integers(b - a - size + 1)
            kinds[q, at : at + size], truth[q, at : at + size] = terms.kind[a : a + size], j
            at += size
    weight, seen = np.zeros((s.buckets, k)), np.full((s.buckets, k), 1e-6)
    trans, trans_seen = np.zeros((k, k)), np.full((k, k), 1e-6)
    start, start_seen = np.zeros(k), np.full(k, 1e-6)
    alive = np.ones((128, s.length), dtype=bool)
    for _ in range(s.epochs):
        order = rng.permutation(s.sequences)
        for i in range(0, s.sequences, 128):
            rows = order[i : i + 128]
            used, inverse = np.unique(kinds[rows], return_inverse=True)
            inverse = inverse.reshape(len(rows), s.length)
            own = np.repeat(first[used] - np.concatenate([[0], np.cumsum(count[used])[:-1]]), count[used]) + np.arange(count[used].sum())
            grams, bounds = ids[own], np.concatenate([[0], np.cumsum(count[used])])
            score = _means(weight, grams, bounds)[inverse]
            e = np.exp(score - score.max(2, keepdims=True))
            post, moved = _messages(e, np.exp(trans), np.exp(start), alive[: len(rows)])
            hit = np.zeros((k, k))
            np.add.at(hit, (truth[rows][:, :-1].ravel(), truth[rows][:, 1:].ravel()), 1.0)
            g_trans = (moved - hit) / len(rows) + 1e-3 * trans
            gap = post
            np.put_along_axis(gap, truth[rows][..., None], np.take_along_axis(gap, truth[rows][..., None], 2) - 1, 2)
            flat, by = inverse.ravel(), np.argsort(inverse.ravel(), kind="stable")
            per_kind = np.add.reduceat(gap.reshape(-1, k)[by], np.searchsorted(flat[by], np.arange(len(used))), axis=0) / len(rows) / count[used][:, None]
            by_gram = np.argsort(grams, kind="stable")
            new = np.flatnonzero(np.diff(grams[by_gram], prepend=-1))
            touched = grams[by_gram][new]
            owner = np.repeat(np.arange(len(used)), count[used])[by_gram]
            for c in range(0, k, _WIDE):
                w, past = weight[:, c : c + _WIDE], seen[:, c : c + _WIDE]
                g = np.add.reduceat(per_kind[:, c : c + _WIDE][owner], new, axis=0) + 1e-6 * w[touched]
                past[touched] += g**2
                w[touched] -= s.rate * g / np.sqrt(past[touched])
            g_start = gap[:, 0].sum(0) / len(rows) + 1e-3 * start
            start_seen += g_start**2
            start -= 0.1 * g_start / np.sqrt(start_seen)
            trans_seen += g_trans**2
            trans -= 0.1 * g_trans / np.sqrt(trans_seen)
    return Model(names, weight.astype(np.float32), trans, start, s)


def posteriors(model: Model, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posterior of every position; emission: (positions, languages), first: chain starts, n + 1."""
    s, k = model.settings, emission.shape[1]
    size = np.diff(first)
    runs = -(-size // s.run)
    chain = np.repeat(np.arange(len(size)), runs)
    if not len(chain):
        return np.zeros((0, k))
    head = np.concatenate([[0], np.cumsum(runs)])
    nth = np.arange(len(chain)) - head[chain]
    begin = first[chain] + nth * s.run
    length = np.minimum(s.run, first[chain + 1] - begin)
    by = np.argsort(-length, kind="stable")  # longest first: those still alive are a prefix
    e = np.exp(emission - emission.max(1, keepdims=True))
    trans, start = np.exp(model.transition), np.exp(model.start)
    width = int(length.max())
    alive = np.searchsorted(-length[by], -np.arange(width), side="left")
    origin = begin[by]
    # what a run does to a message from its left: transition, then emission, position by position; a
    # chain's first position has no transition, and its message is the start
    matrix = np.broadcast_to(np.eye(k), (len(by), k, k)).copy()
    opens = nth[by] == 0
    for i in range(width):
        m = alive[i]
        step = (matrix[:m].reshape(-1, k) @ trans).reshape(m, k, k)
        if i == 0:
            step[opens[:m]] = matrix[:m][opens[:m]]
        step *= e[origin[:m] + i][:, None, :]
        matrix[:m] = step / step.sum((1, 2), keepdims=True)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    matrix = matrix[place]
    # messages into each run: from the left, and from the right
    left, right = np.empty((len(chain), k)), np.ones((len(chain), k))
    most = int(runs.max())
    live = np.flatnonzero(runs > 0)
    message = np.broadcast_to(start, (len(live), k)).copy()
    for j in range(most):
        keep = runs[live] > j
        live, message = live[keep], message[keep]
        at = head[live] + j
        left[at] = message
        message = np.einsum("ni,nij->nj", message, matrix[at])
        message = message / message.sum(1, keepdims=True)
    live = np.flatnonzero(runs > 0)
    message = np.ones((len(live), k))
    for j in range(most):
        keep = runs[live] > j
        live, message = live[keep], message[keep]
        at = head[live + 1] - 1 - j
        right[at] = message
        message = np.einsum("nij,nj->ni", matrix[at], message)
        message = message / message.sum(1, keepdims=True)
    # inside the runs, all at once
    forward = np.empty((len(emission), k))
    a = left[by]
    for i in range(width):
        m = alive[i]
        step = a[:m] @ trans
        if i == 0:
            step[opens[:m]] = a[:m][opens[:m]]
        step *= e[origin[:m] + i]
        a[:m] = step / step.sum(1, keepdims=True)
        forward[origin[:m] + i] = a[:m]
    b = right[by]
    for i in range(width - 1, -1, -1):
        m = alive[i]
        at = origin[:m] + i
        forward[at] *= b[:m]
        step = (e[at] * b[:m]) @ trans.T
        b[:m] = step / step.sum(1, keepdims=True)
    return forward / forward.sum(1, keepdims=True)


def totals(model: Model, emission: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the posteriors of each text's positions; emission: (distinct terms, languages).

    Term by term, all texts at once.  The messages from the left are stored at every ``run``-th
    position and made again from there on the way back."""
    run, k = model.settings.run, emission.shape[1]
    size = np.diff(first)
    by = np.argsort(-size, kind="stable")  # longest first: those still alive are a prefix
    width = int(size.max()) if len(size) else 0
    alive = np.searchsorted(-size[by], -np.arange(width), side="left")
    origin = first[:-1][by]
    e = np.exp(emission - emission.max(1, keepdims=True, initial=-np.inf)).astype(np.float64)
    trans, start = np.exp(model.transition), np.exp(model.start)

    def ahead(a, i):
        a = (a[: alive[i]] @ trans if i else np.broadcast_to(start, (alive[0], k))) * e[kind[origin[: alive[i]] + i]]
        return a / a.sum(1, keepdims=True)

    stored, a = [], np.zeros((0, k))
    for i in range(width):
        if i % run == 0:
            stored.append(a[: alive[i]])
        a = ahead(a, i)
    out, back = np.zeros((len(size), k)), np.ones((len(size), k))
    while stored:
        a, at, forward = stored.pop(), len(stored) * run, []
        for i in range(at, min(at + run, width)):
            a = ahead(a, i)
            forward.append(a)
        for i in range(at + len(forward) - 1, at - 1, -1):
            m = alive[i]
            post = forward.pop() * back[:m]
            out[:m] += post / post.sum(1, keepdims=True)
            step = (e[kind[origin[:m] + i]] * back[:m]) @ trans.T
            back[:m] = step / step.sum(1, keepdims=True)
    whole = np.empty_like(out)
    whole[by] = out
    return whole


def label_terms(model: Model, column: pa.Array) -> tuple[np.ndarray, Terms]:
    """Posteriors of all terms of a column, text after text, and the terms."""
    terms = Terms(column)
    if not len(terms.kind):
        return np.zeros((0, len(model.languages))), terms
    return posteriors(model, _emissions(terms, model.emission, model.settings)[terms.kind], terms.first), terms


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text that has a letter; the caller knows which have."""
    n = len(column)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    if len(model.languages) == 1:
        return model.languages * n, np.ones(n)
    if len(model.languages) > _WIDE:
        terms = Terms(column)
        summed = totals(model, _emissions(terms, model.emission, model.settings), terms.kind, terms.first)
    else:
        post, terms = label_terms(model, column)
        total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)])
        summed = total[terms.first[1:]] - total[terms.first[:-1]]
    mean = summed / np.maximum(np.diff(terms.first), 1)[:, None]
    best = mean.argmax(1)
    return [model.languages[j] for j in best], np.clip(mean[np.arange(n), best], 0.0, 1.0)


def train(docs: DataFrame, settings: Settings = Settings(), folds: int = 5, held_out: int = 0) -> Model:
    """Fit on at most ``settings.sample`` documents of each language outside the held-out fold, of
    those whose text has a letter."""
    s = settings
    labelled = docs.select(F.col("lang").cast("string").alias("label"), F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    labelled = labelled.where(F.col("label").isNotNull() & F.col("key").isNotNull() & F.col("text").rlike(r"\p{L}") & (sampling.crc_fold(F.col("key"), folds) != held_out))
    rows = labelled.select("label", "key")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = sampling.smallest_of_each(rows, counts, max(1, min(s.sample, s.documents // max(len(counts), 1))))
    found = sampling.fetch_labelled(labelled, picked, min(s.longest, max(1, s.characters // max(len(picked), 1))))
    return fit([text for _, text, _ in found], [label for *_, label in found], s)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``lang_pred`` and ``score``; one pass, no shuffle."""
    base = docs.drop("lang_pred", "score").withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x languages numbers
    out = base.drop("__letters")
    size = max(1 << 16, (1 << 20) * _WIDE // max(_WIDE, len(model.languages)))
    schema = out.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(stream):
        for batch in stream:
            for part in tokens.batches(batch, "text", size):
                letters = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                names, score = predict(shared.value, part.column(part.schema.get_field_index("text")))
                names = [x if ok else UNKNOWN for x, ok in zip(names, letters)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return base.mapInArrow(run, schema)
