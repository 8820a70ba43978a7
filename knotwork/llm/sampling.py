"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds`` (null key: that of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(folds)


def fetch_texts(docs: DataFrame, ids: list[int], longest: int) -> list[tuple[int, str]]:
    """Texts of the given documents, in order of id; those over ``longest`` characters are left out
    (training only).  The list of ids is bounded by the caller."""
    if not ids:
        return []
    keys = docs.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("_id", T.LongType())]))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
        .where(F.col("_text").isNotNull() & (F.length("_text") <= longest))
        .join(F.broadcast(keys), "_id")
        .collect()
    )
    return sorted((r["_id"], r["_text"]) for r in rows)


def smallest_by_hash(df: DataFrame, key: str, size: int) -> list[int]:
    """The ``size`` distinct keys whose hash is smallest: the same sample however the rows lie."""
    rows = df.select(F.col(key).cast("long").alias("k")).where(F.col("k").isNotNull()).distinct().orderBy(F.xxhash64("k"), "k").limit(size).collect()
    return [r["k"] for r in rows]


def smallest_of_each(rows: DataFrame, counts: dict[str, int], size: int) -> list[tuple[str, int]]:
    """``smallest_by_hash`` for every label of rows(label, key) at once, as (label, key); ``counts``
    holds each label's rows.  Only keys under a hash that about twice ``size`` keys lie under come
    to the driver; a label that has too few there (its keys repeat) is asked again further up."""
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("limit", T.LongType())])
    hashed = rows.select("label", "key", F.xxhash64("key").alias("h"))
    out, share = [], {label: 2 * size / n for label, n in counts.items()}
    while share:
        limits = [(label, (1 << 63) - 1 if p >= 1 else int(p * 2**64) - (1 << 63)) for label, p in share.items()]
        near = hashed.join(F.broadcast(rows.sparkSession.createDataFrame(limits, schema)), "label").where("h <= limit")
        found: dict[str, list] = {label: [] for label in share}
        for r in near.select("label", "h", "key").distinct().collect():
            found[r["label"]].append((r["h"], r["key"]))
        done = {label for label, p in share.items() if p >= 1 or len(found[label]) >= size}
        out += [(label, key) for label in sorted(done) for _, key in sorted(found[label])[:size]]
        share = {label: 8 * p for label, p in share.items() if label not in done}
    return out


def fetch_labelled(docs: DataFrame, picked: list[tuple[str, int]], longest: int) -> list[tuple[int, str, str]]:
    """(id, text, label) of docs(label, key, text) for the given (label, key), in order; a text
    counts with its first ``longest`` characters, and one text of each label and key."""
    if not picked:
        return []
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("key", T.LongType())])
    keys = docs.sparkSession.createDataFrame(picked, schema)
    near = docs.join(F.broadcast(keys), ["label", "key"]).groupBy("label", "key").agg(F.min(F.substring("text", 1, longest)).alias("text"))
    return sorted((r["key"], r["text"], r["label"]) for r in near.collect())
