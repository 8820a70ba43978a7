"""Hashed sub-word features of letter runs, computed on byte buffers; n-grams are of whole characters.

A *term* is a maximal run of ASCII letters and of bytes from 0x80 up, A-Z folded; digits,
punctuation and blanks part terms, so ``Idiot###`` and ``idiot,`` are the same term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from knotwork.llm import tokens

_AT_ONCE = 1 << 14  # terms

_TERM = np.zeros(256, dtype=bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = True
_TERM[0x80:] = True


def term_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _TERM[raw]
    edge = np.ones(len(raw) + 1, dtype=bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = solid[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


class Terms:
    """The terms of a string column: ``kind[i]`` is the index of term i among the distinct ones.
    With ``stutter=False`` a term that repeats the one before it in its text counts once."""

    def __init__(self, column: pa.Array, stutter: bool = True):
        raw, offsets = tokens.utf8_buffer(column)
        starts, ends, self.first = term_spans(raw, offsets)
        hashes = tokens.hash_spans(raw, starts, ends)
        if not stutter and len(hashes):
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = hashes[1:] != hashes[:-1]
            new[self.first[:-1][np.diff(self.first) > 0]] = True
            starts, ends, hashes = starts[new], ends[new], hashes[new]
            self.first = np.concatenate([[0], np.cumsum(new)])[self.first]
        self.hashes, at, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        # the distinct terms' characters: n-grams never cut one that takes several bytes
        size = ends[at] - starts[at]
        edges = np.concatenate([[0], np.cumsum(size)])
        raw = raw[np.repeat(starts[at] - edges[:-1], size) + np.arange(edges[-1])]
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        self.starts, self.ends = np.searchsorted(heads, edges[:-1]), np.searchsorted(heads, edges[1:])
        wide = np.diff(np.append(heads, len(raw)))
        letter = tokens._LOWER[raw[heads]].astype(np.uint64)
        for k in (1, 2, 3):
            more = np.flatnonzero(wide > k)
            letter[more] |= raw[heads[more] + k].astype(np.uint64) << np.uint64(8 * k)
        self.letters = letter

    def features(self, shortest: int, longest: int, buckets: int, affixes: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids, first feature of each distinct term): the whole term, its n-grams of
        ``shortest`` to ``longest`` characters between end marks, and, marked as such, its first and
        last 1 to ``affixes`` characters.  The ids lie below ``buckets``.  Made for some terms at a time,
        as the hashes take far more memory than the ids."""
        made = [self._features(a, a + _AT_ONCE, shortest, longest, buckets, affixes) for a in range(0, len(self.starts), _AT_ONCE)]
        if not made:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate([ids for ids, _ in made]), np.concatenate([[0], np.cumsum(np.concatenate([count for _, count in made]))])

    def _features(self, a: int, b: int, shortest: int, longest: int, buckets: int, affixes: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each term's features) of terms a to b."""
        starts, ends, hashes = self.starts[a:b], self.ends[a:b], self.hashes[a:b]
        n = len(starts)
        size = (ends - starts) + 2
        first = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=first[1:])
        owner = np.repeat(np.arange(n), size)
        inside = np.arange(first[-1]) - first[owner]
        marked = np.zeros(first[-1], np.uint64)
        marked[first[:-1]], marked[first[1:] - 1] = ord("<"), ord(">")
        body = (inside > 0) & (inside < size[owner] - 1)
        marked[body] = self.letters[(starts[owner] + inside - 1)[body]]
        left = size[owner] - inside
        char = tokens.mix64((marked + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        ids, owners = [hashes], [np.arange(n)]
        gram = char
        for k in range(2, longest + 1):
            gram = tokens.mix64(gram[: len(char) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + char[k - 1 :])
            if k >= shortest:
                fits = left[: len(gram)] >= k
                ids.append(gram[fits] + np.uint64(k))
                owners.append(owner[: len(gram)][fits])
            if 2 <= k <= affixes + 1:  # an end mark and k - 1 characters
                for mark, at in ((0xA5, inside == 0), (0x5A, left == k)):
                    at = at[: len(gram)] & (left[: len(gram)] >= k)
                    ids.append(tokens.mix64(gram[at] ^ np.uint64(mark)))
                    owners.append(owner[: len(gram)][at])
        ids, owners = np.concatenate(ids), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return (ids[order] % np.uint64(buckets)).astype(np.int32), np.bincount(owners, minlength=n)


def mean_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each run of rows; every run has a row at least."""
    return np.add.reduceat(values, first[:-1], axis=0) / np.diff(first).reshape((-1,) + (1,) * (values.ndim - 1))
