"""Union-find inside partitions: edges become a spanning forest before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EDGES = "src long, dst long"
_HELD = 1 << 20  # edges of a partition held before they are reduced


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of each one's component) of an edge list, by vectorised hooking
    of larger roots under smaller ones and pointer jumping."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(ids))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return ids, ids[parent]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def reduce_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component: (vertex, its root), loops left out."""
    if not len(u):
        return u, v
    ids, root = local_components(u, v)
    apart = ids != root
    return ids[apart], root[apart]


def forest(edges: DataFrame) -> DataFrame:
    """edges(src, dst) reduced to a star forest within each partition; the components stay the same.
    At most one row a vertex and partition comes out, and at most ``_HELD`` edges plus the
    partition's forest are in memory."""

    def run(stream):
        u = v = np.zeros(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in stream:
            fresh.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            held += batch.num_rows
            if held >= _HELD:
                u, v = reduce_edges(np.concatenate([u, *(x for x, _ in fresh)]), np.concatenate([v, *(y for _, y in fresh)]))
                fresh, held = [], 0
        u, v = reduce_edges(np.concatenate([u, *(x for x, _ in fresh)]), np.concatenate([v, *(y for _, y in fresh)]))
        for i in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)], pa.int64()), pa.array(v[i : i + (1 << 16)], pa.int64())], names=["src", "dst"])

    return edges.select("src", "dst").mapInArrow(run, EDGES)
