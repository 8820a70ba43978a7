"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D (UTF-8 text: the
same runs as the code-point pattern ``[^\\x20\\x09-\\x0D]+``).  Everything here
works on the column's contiguous byte buffer, so no Python string is made per word.
Hashes are 64-bit, stable between processes and machines, and case-folded for A-Z
only.  Nulls and empty texts simply have no words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_PIECE = 512  # bytes of a long span that are hashed together
_AT_ONCE = 1 << 17  # spans that are hashed together: bounds the temporary arrays

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # a C library other than glibc
    _trim = None


def release() -> None:
    """Give freed memory back to the system.  Spark's Python workers live on from task to task, and what
    their allocators keep for later is missing from the executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TAIL = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and for each text the index of its first word (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[raw]
    edge = np.ones(len(raw) + 1, dtype=bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = solid[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of raw on, as little-endian integers; zeros follow its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span: its length, then eight bytes a round, each round through an
    invertible mixer, so that spans of up to eight bytes and one length never collide and others do
    with a chance of about 2^-64.  Of spans over ``_PIECE`` bytes the pieces are hashed, and then
    their hashes in the same way, which takes few rounds however long a span is."""
    words, out = eights(_LOWER[raw] if fold else raw), np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), _AT_ONCE):
        out[i : i + _AT_ONCE] = _rounds(words, starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE], np.uint64(seed))
    return out


def _rounds(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64) -> np.ndarray:
    size = ends - starts
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
    long = size > _PIECE
    live = np.flatnonzero(~long & (size > 0))
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix64(out[live] ^ (words[at] & _TAIL[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(long)
    if len(long):
        count = -(-size[long] // _PIECE)
        first = np.concatenate([[0], np.cumsum(count)])
        nth = np.arange(first[-1]) - np.repeat(first[:-1], count)
        begin = np.repeat(starts[long], count) + nth * _PIECE
        pieces = _rounds(words, begin, np.minimum(begin + _PIECE, np.repeat(ends[long], count)), seed)
        out[long] = mix64(out[long] + _rounds(eights(pieces.astype("<u8").view(np.uint8)), first[:-1] * 8, first[1:] * 8, seed + np.uint64(1)))
    return out


def equal_spans(words: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, there: np.ndarray, length: np.ndarray) -> bool:
    """Whether the spans of ``size`` bytes from ``at`` are, one by one, those of ``length`` bytes from
    ``there``; words and other are the ``eights`` of their bytes."""
    if (size != length).any():
        return False
    live = np.flatnonzero((size > 0) & ((at != there) | (words is not other)))
    at, there, left = at[live], there[live], size[live]
    while len(left):
        if ((words[at] ^ other[there]) & _TAIL[np.minimum(left, 8)]).any():
            return False
        more = np.flatnonzero(left > 8)
        at, there, left = at[more] + 8, there[more] + 8, left[more] - 8
    return True


def words_of(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each text, starts, ends, bytes) of a string column."""
    raw, offsets = utf8_buffer(column)
    starts, ends, first = word_spans(raw, offsets)
    return hash_spans(raw, starts, ends, fold), first, starts, ends, raw


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries (len - k + 1 of them), by doubling: log2(k) passes."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    out, have, power, span = None, 0, hashes, 1
    n = len(hashes)
    rest = k
    while rest:
        if rest & 1:
            out = power[: n - span + 1] if out is None else mix64(out[: n - have - span + 1] * np.uint64(0x9E3779B97F4A7C15) + power[have : n - span + 1])
            have += span
        rest >>= 1
        if rest:
            power = mix64(power[: n - 2 * span + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + power[span : n - span + 1])
            span *= 2
    return out


def batches(batch: pa.RecordBatch, column: str, size: int = 2 << 20):
    """Slices of a batch whose texts come to about ``size`` bytes (one text at least); after the last
    one freed memory goes back to the system."""
    if not batch.num_rows:
        return
    _, offsets = utf8_buffer(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    release()
