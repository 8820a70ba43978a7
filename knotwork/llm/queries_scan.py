"""Queries of the operators over whole documents that shuffle little."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import mixing, preferences, secret_scan
from knotwork.llm.queries_map import read


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.findings(secret_scan.scan(read(spark, sf_dir, "documents"))))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(mixing.mix(read(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each conversation with an assistant turn; loss spans as start:stop lists."""
    pairs = preferences.opposed(preferences.conversations(read(spark, sf_dir, "conversations")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return preferences.formatted(pairs).select("pair_id", "common", "prompt", "chosen", listed("chosen_spans").alias("chosen_spans"), "rejected", listed("rejected_spans").alias("rejected_spans"))
