"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch (a run of spaces and the run of other characters after it; no
piece crosses such a chunk's end) are concatenated and indexed by a suffix array.  Every piece
of the model is binary-searched in it, which gives all its occurrences as one range.  The
occurrences are edges between character positions; sorted by position they are relaxed from
each chunk's start: an edge extends the segmentation that ends where it begins if the model's
merge order would keep the boundary between the two pieces.  For a byte-pair model exactly one
edge passes at each position that is reached, so the last pieces lead back through the model's
own segmentation.  Characters outside the vocabulary become byte pieces.

Chunks are the same in every document, so a worker remembers those that it has met, up to a
fixed number, and compares their bytes when it meets them again.  Nothing is shuffled and no model is trained; the model file's path is a parameter.

Defined results: a null text has null ids, an empty text no ids; U+2581 in a text is the
model's own space mark, so it decodes to a space; decoding skips control pieces and writes
U+FFFD for byte pieces that are not UTF-8; all rows and columns stay, and columns named
like the result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from knotwork.llm import tokens

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_REMEMBERED = 1 << 19  # chunks that a worker keeps
_INDEXED = 1 << 18  # bytes of chunks that are indexed together


@dataclass
class Vocabulary:
    """Pieces as arrays.  ``order``: when a piece comes about in merging (0: single characters)."""

    names: list[bytes]  # what a piece decodes to; the space mark is a space
    size: np.ndarray  # bytes of an ordinary piece, else 0
    order: np.ndarray
    left: np.ndarray  # last merge of each piece
    right: np.ndarray
    pair: np.ndarray  # sorted left * len + right of all pairs that merge
    merged: np.ndarray
    byte: np.ndarray  # piece of each byte
    unknown: int
    words: np.ndarray  # (pieces, as many as the longest piece takes) big-endian words, filled with zeros
    usable: np.ndarray
    control: np.ndarray


def _merge(symbols: list[int], merged: dict[tuple[int, int], int], order: np.ndarray) -> list[int]:
    """Plain merging, lowest order first, leftmost first."""
    while True:
        best = None
        for i, p in enumerate(zip(symbols, symbols[1:])):
            m = merged.get(p)
            if m is not None and (best is None or order[m] < best[0]):
                best = (order[m], i, m)
        if best is None:
            return symbols
        symbols = [*symbols[: best[1]], best[2], *symbols[best[1] + 2 :]]


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    ordinary = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    raw = [names[i].replace(MARK, " ").encode() if ordinary[i] else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" for i in range(n)]
    if model.unk_id() >= 0:
        raw[model.unk_id()] = " ⁇ ".encode()
    by_name = {names[i]: i for i in range(n) if ordinary[i]}
    long = sorted((i for i in range(n) if ordinary[i] and len(names[i]) > 1), key=lambda i: (-model.get_score(i), i))
    order = np.zeros(n, np.int64)
    order[long] = np.arange(1, len(long) + 1)
    merged = {}
    for i in long:
        for k in range(1, len(names[i])):
            a, b = by_name.get(names[i][:k]), by_name.get(names[i][k:])
            if a is not None and b is not None:
                merged[a, b] = i
    left, right = np.arange(n), np.arange(n)
    usable = np.array(ordinary)
    for i in long:
        chars = [by_name.get(c, -1) for c in names[i]]
        parts = chars
        while len(parts) > 2:
            ranks = [(order[merged[p]], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merged]
            if not ranks:
                break
            k = min(ranks)[1]
            parts = [*parts[:k], merged[parts[k], parts[k + 1]], *parts[k + 2 :]]
        if len(parts) == 2 and merged.get(tuple(parts)) == i:
            left[i], right[i] = parts
        else:
            usable[i] = False  # merging never makes it
    keys = np.array([a * (n + 1) + b for a, b in merged], dtype=np.int64)
    at = np.argsort(keys)
    size = np.array([len(raw[i]) if ordinary[i] else 0 for i in range(n)])
    padded = np.zeros((n, -(-max(1, *size[usable]) // 8) * 8), np.uint8)
    for i in range(n):
        if usable[i]:
            padded[i, : size[i]] = np.frombuffer(raw[i], np.uint8)
    byte = np.full(256, model.unk_id(), np.int64)
    for i in range(n):
        if model.is_byte(i):
            byte[raw[i][0]] = i
    return Vocabulary(raw, size, order, left, right, keys[at], np.array(list(merged.values()), dtype=np.int64)[at], byte, n, padded.view(">u8").astype(np.uint64), usable, np.array([model.is_control(i) for i in range(n)]))


def stays(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging keeps the boundary between pieces a and b: step back through the merges that
    made them, latest first, and see whether the two pieces at the boundary would have merged."""
    out = np.ones(len(a), dtype=bool)
    order = np.append(v.order, 0)
    left, right = np.append(v.left, v.unknown), np.append(v.right, v.unknown)
    at = np.arange(len(a))
    limit = np.full(len(a), np.iinfo(np.int64).max)
    a, b = a.copy(), b.copy()
    while len(at):
        key = a * (v.unknown + 1) + b
        slot = np.minimum(np.searchsorted(v.pair, key), len(v.pair) - 1)
        would = (v.pair[slot] == key) & (order[v.merged[slot]] < limit)
        out[at[would]] = False
        of_left = order[a] > order[b]
        more = ~would & ((order[a] > 0) | (order[b] > 0))
        limit = np.where(of_left, order[a], order[b] + 1)
        a, b = np.where(of_left, right[a], a), np.where(of_left, b, left[b])
        at, a, b, limit = at[more], a[more], b[more], limit[more]
    return out


def suffix_array(text: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions ``at`` sorted by the ``words`` times 8 bytes from there, which no piece exceeds; the
    8-byte words from every position)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(words * 8 + 8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + words * 8, np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)] << np.uint64(56 - 8 * k)
    _, rank = np.unique(word, return_inverse=True)
    rank = rank.astype(np.uint64)
    reach = 8
    while reach < words * 8:
        after = np.concatenate([rank[reach:], np.zeros(reach, np.uint64)])[: len(rank)]
        _, rank = np.unique(rank * np.uint64(len(word) + 1) + after, return_inverse=True)
        rank = rank.astype(np.uint64)
        reach *= 2
    return at[np.argsort(rank[at], kind="stable")], word


def ranges(v: Vocabulary, order: np.ndarray, word: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, last) of the suffixes that begin with each of the pieces, by binary search."""
    low = v.words[which]
    size, words = v.size[which], v.words.shape[1]
    filled = np.clip(size[:, None] - np.arange(words) * 8, 0, 8).astype(np.uint64)
    rest = np.where(filled >= 8, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(filled * np.uint64(8), np.uint64(63)))
    high = low | rest
    bounds = []
    for target, past in ((low, False), (high, True)):
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(order))
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) // 2
            start = order[np.minimum(mid, len(order) - 1)]
            less, same = np.zeros(len(which), bool), np.ones(len(which), bool)
            for k in range(words):
                w = word[start + 8 * k]
                less |= same & (w < target[:, k])
                same &= w == target[:, k]
            go = (less | (same & past)) & open_
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


def segment(v: Vocabulary, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each chunk, n + 1); text holds the chunks, each ended by a zero byte."""
    chunks = len(first) - 1
    heads = ((text & 0xC0) != 0x80) & np.append(np.ones(len(text) - 1, bool), False)
    ends = first[1:] - 1
    heads[ends] = False
    order, word = suffix_array(text, np.flatnonzero(heads), v.words.shape[1])
    which = np.flatnonzero(v.usable)
    lo, hi = ranges(v, order, word, which)
    count = hi - lo
    start = order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())].astype(np.int32)
    piece = np.repeat(which.astype(np.int32), count)
    single = v.order[piece] == 0
    strange = heads.copy()
    strange[start[single]] = False
    strange = np.flatnonzero(strange)  # characters outside the vocabulary
    head_at = np.append(np.flatnonzero(heads | (text == 0) & ~heads), len(text))
    strange_end = head_at[np.searchsorted(head_at, strange, side="right")] if len(strange) else strange
    size = v.size.astype(np.int32)
    start, stop = np.concatenate([start, strange.astype(np.int32)]), np.concatenate([start + size[piece], strange_end.astype(np.int32)])
    piece = np.concatenate([piece, np.full(len(strange), v.unknown, np.int32)])
    head = np.repeat(first[:-1], np.diff(first)).astype(np.int32)  # of each position's chunk
    step = stop - head[start]
    by = np.argsort(step, kind="stable").astype(np.int32)
    start, stop, piece, step = start[by], stop[by], piece[by], step[by]
    last = np.full(len(text) + 1, -1, np.int64)
    last[first[:-1]] = -2
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]]) if len(step) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        before = last[start[a:b]]
        live = np.flatnonzero(before != -1)
        before = before[live]
        good = before == -2
        inner = np.flatnonzero(~good)
        good[inner] = stays(v, before[inner], piece[a:b][live[inner]].astype(np.int64))
        chosen = live[good] + a
        # the chunk's own start is never overwritten: an edge ends after it
        last[stop[chosen]] = piece[chosen]
    stuck = np.flatnonzero((last[ends] == -1) & (ends > first[:-1]))
    if len(stuck):
        raise ValueError("no segmentation: " + text[first[stuck[0]] : ends[stuck[0]]].tobytes().decode("utf-8", "replace")[:80])
    width = np.append(v.size, 0)
    place, live = ends.copy(), np.flatnonzero(ends > first[:-1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    previous_head = np.maximum.accumulate(np.where(np.append(heads, False), np.arange(len(text) + 1), 0))
    while len(live):
        ids = last[place[live]]
        back = np.where(ids == v.unknown, place[live] - previous_head[place[live] - 1], width[ids])
        spelled = np.flatnonzero(ids == v.unknown)
        if len(spelled):  # as bytes, last one first like everything here
            size = back[spelled]
            which_byte = np.repeat(place[live[spelled]] - 1, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            sub = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            known = np.flatnonzero(ids != v.unknown)
            who = np.concatenate([live[known], np.repeat(live[spelled], size)])
            what = np.concatenate([ids[known], v.byte[text[which_byte]]])
            sort = np.lexsort((np.concatenate([np.zeros(len(known), np.int64), sub]), who))
            found.append((who[sort], what[sort]))
        else:
            found.append((live, ids))
        place[live] -= back
        live = live[place[live] > first[:-1][live]]
    if not found:
        return np.zeros(0, np.int32), np.zeros(chunks + 1, np.int64)
    who, what = np.concatenate([w for w, _ in found])[::-1], np.concatenate([i for _, i in found])[::-1]
    sort = np.argsort(who, kind="stable")
    return what[sort].astype(np.int32), np.searchsorted(who[sort], np.arange(chunks + 1))


class Encoder:
    """Encodes string columns; remembers chunks between calls.

    Chunks are looked up by hash and compared with the remembered bytes; where two different ones
    share a hash, all are hashed anew with the next seed."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.seed = vocabulary, 0
        self._forget()

    def _forget(self):
        self.keys, self.start, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.at, self.size, self.raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _learn(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) + len(keys) > _REMEMBERED:
            self._forget()
        size = ends - starts + 1
        i = 0
        total = np.cumsum(size)
        flat, starts_of, counts = [self.ids], [], []
        base = len(self.ids)
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _INDEXED, side="right")))
            first = np.concatenate([[0], np.cumsum(size[i:j])])
            text = np.zeros(first[-1], np.uint8)
            inside = np.arange(first[-1]) - np.repeat(first[:-1], size[i:j])
            body = inside < np.repeat(size[i:j] - 1, size[i:j])
            text[body] = raw[(np.repeat(starts[i:j], size[i:j]) + inside)[body]]
            ids, bounds = segment(self.v, text, first)
            flat.append(ids)
            starts_of.append(bounds[:-1] + base)
            counts.append(np.diff(bounds))
            base += len(ids)
            i = j
        self.ids = np.concatenate(flat)
        body = np.cumsum(size - 1)
        inside = np.arange(body[-1]) - np.repeat(body - size + 1, size - 1)
        all_keys = np.concatenate([self.keys, keys])
        sort = np.argsort(all_keys)
        self.at = np.concatenate([self.at, len(self.raw) + body - size + 1])[sort]
        self.size = np.concatenate([self.size, size - 1])[sort]
        self.raw = np.concatenate([self.raw, raw[np.repeat(starts, size - 1) + inside]])
        self.keys = all_keys[sort]
        self.start, self.count = np.concatenate([self.start, *starts_of])[sort], np.concatenate([self.count, *counts])[sort]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text, n + 1)."""
        column = column.fill_null("").cast(pa.large_string())
        column = pc.replace_substring(column, MARK, " ")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        raw, offsets = tokens.utf8_buffer(column)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        return self._chunked(raw, offsets)

    def _again(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.seed += 1
        self._forget()
        return self._chunked(raw, offsets)

    def _chunked(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = raw == 0x20
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[1:-1] = space[1:] & ~space[:-1]
        edge[offsets] = True
        starts = np.flatnonzero(edge)
        starts, ends = starts[:-1], starts[1:]
        hashes = tokens.hash_spans(raw, starts, ends, False, self.seed)
        keys, at, kind = np.unique(hashes, return_index=True, return_inverse=True)
        words, same = tokens.eights(raw), at[kind]
        if not tokens.equal_spans(words, starts, ends - starts, words, starts[same], (ends - starts)[same]):
            return self._again(raw, offsets)
        slot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(slot, len(self.keys) - 1)] != keys
        if new.any():
            if len(self.keys) + int(new.sum()) > _REMEMBERED:
                self._forget()
                new[:] = True
        old = np.flatnonzero(~new)
        if not tokens.equal_spans(words, starts[at[old]], (ends - starts)[at[old]], tokens.eights(self.raw), self.at[slot[old]], self.size[slot[old]]):
            return self._again(raw, offsets)
        if new.any():
            self._learn(keys[new], raw, starts[at[new]], ends[at[new]])
            slot = np.searchsorted(self.keys, keys)
        count = self.count[slot][kind]
        begin = self.start[slot][kind]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of id lists: pieces joined, the space put before the first one taken off again."""
    size = np.array([len(x) for x in v.names])
    size[v.control] = 0
    flat = np.frombuffer(b"".join(x for x, c in zip(v.names, v.control) if not c), np.uint8)
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = size[ids]
    total = np.concatenate([[0], np.cumsum(count)])
    raw = flat[np.repeat(base[ids] - total[:-1], count) + np.arange(total[-1])].tobytes()
    edges = total[bounds]
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a and raw[a] == 0x20:
            a += 1
        out.append(raw[a:b].decode("utf-8", "replace"))
    return out


def encode(docs: DataFrame, path: str = MODEL, column: str = "ids", verify: str | None = None) -> DataFrame:
    """docs with one more column, the piece ids of ``text`` (array of int); with ``verify`` another
    one of that name, whether decoding them gives the text back (null for null texts)."""
    base = docs.drop(column, *([verify] if verify else []))
    # the model: bounded by its file.  A worker fills its copy of the encoder from task to task, and
    # Spark takes it away with the broadcast before the first task of something else
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(load(path)))
    added = [T.StructField(column, T.ArrayType(T.IntegerType()))] + ([T.StructField(verify, T.BooleanType())] if verify else [])
    schema = T.StructType([*base.schema.fields, *added])

    def run(stream):
        encoder = shared.value
        for batch in stream:
            for part in tokens.batches(batch, "text", 2 << 20):
                texts = part.column(part.schema.get_field_index("text"))
                ids, bounds = encoder.encode(texts)
                same = []
                if verify:
                    back = pa.array(decode(encoder.v, ids, bounds), pa.string())
                    same = [pc.equal(back, pc.replace_substring(texts, MARK, " "))]
                made = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                if texts.null_count:
                    made = pc.if_else(texts.is_null(), pa.scalar(None, made.type), made)
                yield pa.RecordBatch.from_arrays([*part.columns, made, *same], names=[*part.schema.names, *(f.name for f in added)])

    return base.mapInArrow(run, schema)


def decoded(docs: DataFrame, path: str = MODEL, column: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with one more column, the text of the ids in ``column``."""
    base = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = T.StructType([*base.schema.fields, T.StructField(into, T.StringType())])

    def run(stream):
        for batch in stream:
            lists = batch.column(batch.schema.get_field_index(column))
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = decode(shared.value, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
            made = pa.array(texts, pa.string())
            if lists.null_count:
                made = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), made)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    return base.mapInArrow(run, schema)
