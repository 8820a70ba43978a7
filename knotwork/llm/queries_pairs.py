"""Queries of the operators that link rows with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import lattice, near_dup, neighbours, repeats
from knotwork.llm.queries_map import read


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(read(spark, sf_dir, "documents"), near_dup.Settings(words=2)).drop("row", "th")


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link(read(spark, sf_dir, "embeddings"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated spans; documents without one have no row."""
    return repeats.spans(read(spark, sf_dir, "documents"))
