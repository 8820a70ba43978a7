"""The registered queries and the pipeline on the driver's small tables."""

import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knotwork.llm import mixing, near_dup, pieces
from knotwork.llm.queries import ORACLE_SQL, QUERIES
from knotwork.plans import scratch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", [q for q in ORACLE_SQL])
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in frame.select(*columns).collect()) == sorted(map(str, want))


@pytest.mark.parametrize("name,columns", [
    ("op2_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    ("op6_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    ("op9_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    ("op8_pieces", {"doc_id": "bigint", "n_pieces": "bigint", "round_trip": "boolean"}),
])
def test_columns_and_rows(spark, name, columns):
    frame = QUERIES[name](spark, SF)
    assert columns.items() <= dict(frame.dtypes).items()
    assert frame.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name == "op8_pieces":
        assert frame.where("NOT round_trip").count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "secrets", "mixing", "pieces"]
    by = dict(corpus_pipeline.STAGES)
    calm = by["toxicity"](spark, docs, SF)
    assert calm.columns == docs.columns and calm.exceptAll(docs).count() == 0
    single = by["near duplicates"](spark, docs, SF)
    kept = {r[0] for r in near_dup.link(docs).where("kept").select("doc_id").collect()}
    assert {r["doc_id"] for r in single.collect()} == kept and single.exceptAll(docs).count() == 0
    masked = by["secrets"](spark, docs, SF)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    secret = re.compile(r"token = \"[0-9a-f]{40}")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in masked.collect():
        assert not secret.search(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or "[SECRET]" in r["text"]
    mixed = by["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    sizes = docs.select("source", words.alias("size"))
    want = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in want.items())
    last = by["pieces"](spark, docs, SF)
    texts = pieces.decoded(last.select("doc_id", "ids")).collect()
    assert all(r["decoded"] == before[r["doc_id"]] for r in texts)


def test_pipeline_runs_through(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "ids"} <= set(out.columns)


WORDS = re.compile("[^\x20\x09-\x0d]+")


def odd_tables(spark, make_docs, prose, folder):
    """Documents with everything that a table may hold, and labels for some of them."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = prose(rng.randrange(5, 60), i).split()
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words), rng.choice(["en", None]), rng.choice(["a", "b", None])))
    toxic = [i % 4 == 0 for i in range(300)]
    base = prose(100, 1000)
    rows += [(400 + i, f"{base} v{i}", "en", "a") for i in range(5)] + [(None, f"{base} v9", None, "b")]
    rows += [(500, None, None, None), (501, "", "en", "a"), (502, " \n", None, None), (None, None, None, None), (None, "", None, "b")]
    rows += [(510, prose(20_000, 1001), "de", "b"), (511, "y" * 50_000, None, "c"), (512, "one", None, "a"), (512, "one", None, "b")]
    rows += [(520, f"{prose(30, 1002)} password = hunter2hunter {prose(30, 1003)}", "en", "c")] * 2
    docs = make_docs(rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)] + [(500, 1, None), (None, 0, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_on_odd_tables(spark, make_docs, prose, tmp_path):
    """Every stage on what the one before it kept, against plain Python."""
    docs, by = odd_tables(spark, make_docs, prose, str(tmp_path)), dict(corpus_pipeline.STAGES)
    texts = lambda frame: Counter((r["doc_id"], r["text"], r["source"]) for r in frame.collect())
    calm = scratch.table(by["toxicity"](spark, docs, str(tmp_path)), "calm")
    insult = lambda t: bool(re.search("idiot|moron|scum", t or ""))
    assert texts(calm) == Counter({k: n for k, n in texts(docs).items() if not insult(k[1])})
    single = scratch.table(by["near duplicates"](spark, calm, str(tmp_path)), "single")
    kept, rows = texts(single), [r.asDict() for r in calm.collect()]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORDS.findall((r["text"] or "").lower())) else None for r in rows]
    groups: list[list[int]] = []
    for i, s in enumerate(sets):
        linked = [g for g in groups if s and any(sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]) for j in g)]
        groups = [g for g in groups if g not in linked] + [[i, *sum(linked, [])]]
    assert kept.total() == len(groups)
    for g in groups:
        own = [(rows[i]["doc_id"], rows[i]["text"], rows[i]["source"]) for i in g]
        best = min((d is None, d or 0) for d, *_ in own)
        assert any(k in kept for k in own if (k[0] is None, k[0] or 0) == best)
    masked = scratch.table(by["secrets"](spark, single, str(tmp_path)), "masked")
    assert masked.columns == docs.columns and masked.count() == single.count()
    assert {r["text"].count("[SECRET]") for r in masked.where("doc_id = 520").collect()} == {1}
    assert texts(masked.where("doc_id <> 520 OR doc_id IS NULL")) == Counter({k: n for k, n in kept.items() if k[0] != 520})
    mixed = scratch.table(by["mixing"](spark, masked, str(tmp_path)), "mixed")
    size = lambda t: len(WORDS.findall(t or ""))
    before, after = Counter(), Counter()
    for r in masked.collect():
        before[r["source"]] += size(r["text"])
    for r in mixed.collect():
        after[r["source"]] += size(r["text"])
        assert r["text"] and r["n_chars"] == len(r["text"])
    want = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(before.items()), "source string, size long")).collect()}
    assert all(abs(after[s] - t) <= 1 for s, t in want.items()) and mixed.columns == docs.columns
    last = by["pieces"](spark, mixed, str(tmp_path))
    assert Counter(r["decoded"] for r in pieces.decoded(last).collect()) == Counter(r["text"] for r in mixed.collect())


def test_pipeline_of_empty_tables(spark, make_docs, tmp_path):
    make_docs([(1, "x")]).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "ids"} <= set(out.columns)
