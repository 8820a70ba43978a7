"""What is asked of labels(id, component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.hashing import below, below_sql


def component_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("component").alias("components"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_size_stats(labels: DataFrame) -> DataFrame:
    """One row: components, smallest, largest and average size (to 2 decimals)."""
    return component_sizes(labels).agg(F.count(F.lit(1)).alias("components"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.round(F.avg("size"), 2).alias("avg_size"))


def giant_component(labels: DataFrame) -> DataFrame:
    """One row: the largest component (ties: the smallest label), its size and percentage."""
    sizes = component_sizes(labels)
    top = F.max(F.struct("size", (-F.col("component")).alias("c")))
    return sizes.agg(top.alias("m"), F.sum("size").alias("n")).where("m IS NOT NULL").select((-F.col("m.c")).alias("component"), F.col("m.size").alias("size"), F.round(F.col("m.size") * 100 / F.col("n"), 2).alias("percent"))


def sampled_giant(labels: DataFrame, draws: int = 1024, seed: int = 5) -> DataFrame:
    """One row: the most frequent component among ``draws`` vertices drawn at random (ties: the smallest
    label), how many of them it has, and their percentage.  The vertices are those with the smallest
    pseudorandom numbers, which each task cuts to ``draws`` before any travels; all of them if
    there are no more."""
    drawn = labels.withColumn("r", below("id", str(1 << 61), seed)).orderBy("r", "id").limit(draws)
    return giant_component(drawn).withColumnRenamed("size", "hits")


def sampled_giant_sql(labels: str, draws: int = 1024, seed: int = 5) -> str:
    return f"""d AS (SELECT component FROM ({labels}) ORDER BY {below_sql('id', str(1 << 61), seed)}, id LIMIT {draws})
SELECT component, count(*) AS hits, round(count(*) * 100 / (SELECT count(*) FROM d), 2) AS percent FROM d GROUP BY component ORDER BY hits DESC, component LIMIT 1"""


def same_partition(one: DataFrame, two: DataFrame) -> bool:
    """Whether two labellings of the same vertices are equal, vertex by vertex."""
    both = one.select("id", F.col("component").alias("a")).join(two.select("id", F.col("component").alias("b")), "id", "full")
    return both.where("NOT (a <=> b)").limit(1).count() == 0
