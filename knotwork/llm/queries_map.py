"""Queries of the operators that need one pass over the documents and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import language_id, pieces, sampling, toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (sampling.crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs)
    held_out = (sampling.crc_fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, verify="round_trip").select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
