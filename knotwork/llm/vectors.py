"""Embedding columns as stored tables of usable vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.plans import scratch

STORED = "vec_id long, ok boolean, h1 long, h2 long, vec array<{}>"


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """(rows, size) of a list column whose rows all have that size."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


def _digest(x: np.ndarray, salt: int) -> np.ndarray:
    factor = np.random.default_rng([7, salt]).integers(0, 1 << 64, x.shape[1], dtype=np.uint64) | np.uint64(1)
    bits = (x + 0.0).view(np.uint64)
    bits = (bits ^ (bits >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bits ^= bits >> np.uint64(32)
    return (bits * factor).sum(1, dtype=np.uint64).view(np.int64)


def common_size(frame: DataFrame, column: str = "embedding") -> int:
    """The most frequent length (ties: the longest); vectors of another take no part."""
    top = frame.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return max(1, top[0]["n"]) if top else 1


def kind(frame: DataFrame, column: str) -> str:
    """float where the components come as such, as half the bytes then travel, else double."""
    return "float" if dict(frame.dtypes)[column] == "array<float>" else "double"


def stored(frame: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """(row, vec_id, ok, h1, h2, vec) of frame(vec_id, <column>); ``row`` tells rows apart, ``ok`` is
    false and vec empty for vectors that are null, zero, of another length, or hold null or
    non-finite components; h1 and h2 agree for equal vectors."""
    numbers = kind(frame, column)

    def run(stream):
        for batch in stream:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column(1)
            length = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
            fits = np.flatnonzero(length == size)
            x = np.zeros((n, size))
            if len(fits):
                x[fits] = matrix(lists.take(pa.array(fits)), size)  # null components come as NaN
            ok = np.zeros(n, dtype=bool)
            ok[fits] = np.isfinite(x[fits]).all(1) & (x[fits] != 0).any(1)
            x[~ok] = 0
            kept = pa.array(x[ok].ravel(), pa.float32() if numbers == "float" else pa.float64())
            bounds = np.concatenate([[0], np.cumsum(np.where(ok, size, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ok), pa.array(_digest(x, 1)), pa.array(_digest(x, 2)), pa.ListArray.from_arrays(pa.array(bounds), kept)],
                names=["vec_id", "ok", "h1", "h2", "vec"],
            )

    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast(f"array<{numbers}>").alias("vec")).mapInArrow(run, STORED.format(numbers))
    return scratch.table(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def grouped(stream, key: int = 0):
    """Whole groups of a stream of batches sorted by column ``key``, several small ones at a time."""
    held = None
    for batch in stream:
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.concat_batches([held, batch])
        keys = table.column(key).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(keys != keys[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def runs(keys: np.ndarray):
    """(start, stop) of each run of equal keys."""
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    return zip(cuts[:-1], cuts[1:])
