"""Connected components by star contraction (large-star and small-star alternated).

Both steps are a minimum per vertex and an equi-join, so a hub is pre-aggregated on the map
side and its join partition can be split at run time.  Edges are first reduced to spanning
forests inside partitions.  The loop ends when the edge set no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from knotwork.plans import forests, scratch


class NotConverged(RuntimeError):
    """The cap on iterations was hit; labels would be wrong, so none are returned."""


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("hub"), F.least("src", "low").alias("low"))
    return both.where(F.col("dst") > F.col("src")).join(low, F.col("src") == F.col("hub")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have src > dst."""
    low = edges.groupBy("src").agg(F.min("dst").alias("low")).withColumnRenamed("src", "hub")
    moved = edges.join(low, F.col("src") == F.col("hub"))
    return moved.where(F.col("dst") != F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select(F.col("hub").alias("src"), F.col("low").alias("dst")))


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges checkpointed, and their digest from the same job: their number and two sums of
    independent hashes, which a changed edge set keeps only by a chance of about 2^-64."""
    seen = Observation()
    h = F.xxhash64("src", "dst")
    state = scratch.checkpoint(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("dst", "src")).alias("x")))
    return state, tuple(seen.get[k] for k in ("n", "s", "x"))


ONE_TASK_EDGES = 1_000_000  # two longs each: 16 MB that a single task may merge


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("dst").alias("id")).distinct().withColumn("component", F.col("id"))
    return stars.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """labels(id, component) as star_contraction, for edges that may be few: partition forests of at
    most ``one_task`` edges in all are merged by one task in one go, larger ones contracted."""
    plain = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    local = scratch.checkpoint(forests.forest(plain))
    if local.count() > one_task:
        return star_contraction(local)
    return _with_roots(scratch.checkpoint(forests.forest(local.coalesce(1))))


def star_contraction(edges: DataFrame, cap: int = 64) -> DataFrame:
    """labels(id, component) of every vertex that has an edge; edges(src, dst), any orientation,
    repeats and loops allowed.  A vertex whose only edges are loops is its own component."""
    plain = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    loops = plain.where("src = dst").select(F.col("src").alias("id")).distinct()
    state, last = _stored(forests.forest(plain.where("src <> dst")).distinct())
    for _ in range(cap):
        if not last[0]:
            break
        before = state
        state, now = _stored(_small_star(_large_star(before).distinct()).distinct())
        scratch.drop(before)
        if now == last:
            break
        last = now
    else:
        raise NotConverged(f"star contraction: edges still changed after {cap} iterations")
    known = _with_roots(state)
    return known.unionByName(loops.join(known, "id", "left_anti").withColumn("component", F.col("id")))
