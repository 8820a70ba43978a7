"""From raw documents to training tokens, stage by stage.

Each stage calls one operator on all rows that the stage before it kept, and its decisions take
effect: toxic documents go, one document of each near-duplicate group stays, secrets are
masked, sources are brought to their target weights, and the texts become piece ids.  Clean
documents pass the filtering stages unchanged.

Defined results, by stage: null and empty texts score 0.0 and are not toxic; they are no
near-duplicates of anything and all stay; they hold no secret; the mix takes no words of them, so
they have no row after it.  Null ids, sources and languages are values like any other (a null
source is one source, last in order).  Repeated rows are scored alike, one of them stays (of
empty texts all do, up to the mix).  Of a group the smallest doc_id stays, null last, then the
smallest text hash.  Texts of any length are used whole.  Columns beyond those of documents pass
all stages but the last, whatever their names.  Without labels nothing is toxic; an empty table
gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import mixing, near_dup, pieces, secret_scan, toxicity
from knotwork.plans import scratch
from knotwork.shipping import ship

REJECTED = 0.3  # toxicity score from which a document goes


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage has changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "__score").where(F.col("__score") < REJECTED).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secret_scan.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _counted(mixing.applied(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

# Learned scores, LSH, drawn slots and piece ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
