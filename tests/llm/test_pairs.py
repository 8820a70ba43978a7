"""Operators on pairs against brute force: near-duplicates, repeated passages, vectors."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import lattice, near_dup, neighbours, repeats, tokens

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, k):
    w = split(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def corpus(prose):
    rows = [(None, "lonely text without an id at all"), (900, None), (901, ""), (902, " \t\n"), (903, "Word"), (904, "word"), (905, "one two"), (5, "same id twice"), (5, "same id twice")]
    base = [prose(120, s) for s in range(12)]
    at = 10
    for b, text in enumerate(base):
        for c in range(6):
            w = text.split()
            for k in range(c * (b % 5)):
                w[(k * 17 + c) % len(w)] = f"edit{b}-{c}-{k}"
            rows.append((at, " ".join(w) if c % 2 else " ".join(w).upper()))
            at += 1
    rows += [(at + i, base[0]) for i in range(40)]  # a group of exact copies
    rows.append((800, prose(20000, 99)))
    rows.append((801, prose(20000, 99) + " tail"))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(make_docs, prose, k):
    rows = corpus(prose)
    sets = [shingles(t, k) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    group = components(len(rows), links)
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    want = sorted((str(d), len(s), str(least.get(g)), d == least.get(g)) for (d, _), s, g in zip(rows, sets, group))
    got = near_dup.link(make_docs(rows), near_dup.Settings(words=k)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == want


def test_keep_one_keeps_whole_rows(make_docs, prose):
    docs = make_docs(corpus(prose))
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    linked = near_dup.link(docs).where("kept").select("doc_id").distinct().collect()
    assert sorted(map(str, ids)) == sorted(str(r[0]) for r in linked)


def test_keep_one_keeps_one_of_each_group(make_docs, prose):
    versions = lambda seed, n: [f"{prose(150, seed)} v{i}" for i in range(n)]
    rows = [(5, t) for t in versions(700, 4)] + [(6, t) for t in versions(700, 2)]  # the smallest id on several texts
    rows += [(None, t) for t in versions(701, 4)] + [(None, versions(701, 1)[0])]  # no id, one text twice
    rows += [(None, t) for t in versions(702, 3)] + [(9, versions(702, 4)[3])]  # an id goes before none
    rows += [(None, prose(150, 703)), (5, prose(150, 704)), (5, None), (None, "")]  # alone, each
    out = near_dup.keep_one(make_docs(rows)).select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in out:
        groups[(r["text"] or "").rsplit(" v", 1)[0]].append(r["doc_id"])
    assert groups == {prose(150, 700): [5], prose(150, 701): [None], prose(150, 702): [9], prose(150, 703): [None], prose(150, 704): [5], "": groups[""]}
    assert sorted(groups[""], key=str) == [5, None]


def test_mixed_regions_are_searched_in_parts(make_docs, prose):
    rows = corpus(prose)
    one = near_dup.link(make_docs(rows), near_dup.Settings(words=2))
    two = near_dup.link(make_docs(rows, 5), near_dup.Settings(words=2, block=2))
    assert sorted(map(str, one.drop("row").collect())) == sorted(map(str, two.drop("row").collect()))


def family(n, seed, common=257, own=43):
    """Documents that share 257 of their 300 shingles each: similarity 0.75, no link."""
    import random

    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**9)}" for _ in range(common)]
    return [" ".join(base + [f"u{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


def test_a_template_that_many_fill_in(make_docs):
    texts = family(400, 6)
    texts += [t.replace("u", "U", 3).rsplit(" ", 8)[0] + f" x{i}" * 6 for i, t in enumerate(texts[::7])]  # true copies of some
    rows = list(enumerate(texts))
    sets = [shingles(t, 2) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) >= 57
    want = components(len(rows), links)
    for block in (16, 512):
        got = {r["doc_id"]: r["component_id"] for r in near_dup.link(make_docs(rows), near_dup.Settings(words=2, block=block)).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_rarest_shingles_meet_for_every_link():
    rng = np.random.default_rng(12)
    count = rng.integers(0, 5, 64)
    for _ in range(3000):
        whole = rng.choice(1 << 40, size=rng.integers(1, 40), replace=False).astype(np.uint64)
        drop = rng.integers(0, max(1, len(whole) // 5) + 1)
        x, y = np.sort(whole[drop:]), np.sort(whole[: len(whole) - rng.integers(0, len(whole) // 5 + 1)])
        x, y = sorted((x, y), key=len)
        both = len(np.intersect1d(x, y))
        if len(x) and 100 * both >= 80 * (len(x) + len(y) - both):
            small, first = near_dup.rarest(x, count, 80)
            assert np.isin(small[:first], near_dup.rarest(y, count, 80)[0]).any()


def test_empty_tables(spark, make_docs):
    none = make_docs([(1, "x")]).where("false")
    assert near_dup.link(none).count() == 0
    assert near_dup.keep_one(none).count() == 0
    assert repeats.spans(none).count() == 0
    assert repeats.deduplicated(none).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.link(empty).count() == 0
    assert neighbours.search(empty, F.col("vec_id") % 100 == 0).count() == 0


def repeated(rows, size):
    """{(doc, copy): covered word positions} of windows that two documents share."""
    owner = defaultdict(set)
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - size + 1):
            owner[tuple(w[i : i + size])].add(d)
    out = defaultdict(set)
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - size + 1):
            own = owner[tuple(w[i : i + size])]
            if len(own) > 1:
                out[d, min(own) != d].update(range(i, i + size))
    return out


def test_repeated_passages_equal_brute_force(make_docs, prose):
    passage = prose(70, 500)
    rows = [(i, f"{prose(40 + i, i)} {passage if i % 3 == 0 else ''} {prose(30, 100 + i)}") for i in range(1, 30)]
    rows += [(100, passage.upper()), (101, " ".join(passage.split()[:49])), (102, " ".join(passage.split()[3:53])), (103, None), (104, "")]
    rows += [(105, "the " * 300), (106, "The " * 120), (107, prose(80, 7) + " " + prose(80, 7)), (108, prose(30000, 77)), (109, "x " + prose(30000, 77)[:5000])]
    rows += [(110, rows[0][1]), (110, rows[0][1])]
    got = defaultdict(set)
    for r in repeats.spans(make_docs(rows)).collect():
        got[r["doc_id"], r["copy"]].update(range(r["start"], r["stop"]))
    assert got == repeated(rows, 50)


def test_later_copies_are_cut(make_docs, prose):
    passage = prose(60, 1)
    out = {r["doc_id"]: r["text"] for r in repeats.deduplicated(make_docs([(1, f"a {passage} b"), (2, f"c {passage} d"), (3, "clean   text"), (4, None)])).collect()}
    assert out == {1: f"a {passage} b", 2: "c d", 3: "clean   text", 4: None}


def test_rows_without_an_id_are_documents_of_their_own(make_docs, prose):
    p, q = prose(60, 801), prose(55, 802)
    rows = [(None, f"{prose(20, 803)} {p}"), (None, f"{prose(30, 804)} {p}"), (None, q), (None, q), (7, f"a {p}"), (None, "alone " + prose(80, 805))]
    got = sorted((r["copy"], r["stop"] - r["start"], str(r["doc_id"])) for r in repeats.spans(make_docs(rows)).collect())
    assert got == [(False, 55, "None"), (False, 60, "None"), (True, 55, "None"), (True, 60, "7"), (True, 60, "None")]


def test_cuts_stay_in_their_own_text(make_docs, prose):
    p = prose(60, 811)
    rows = [(1, p), (2, f"{p} tail"), (2, prose(70, 812)), (None, prose(70, 813)), (None, f"{prose(20, 814)} {prose(70, 813)}")]
    out = {(r["doc_id"], r["text"]) for r in repeats.deduplicated(make_docs(rows)).collect()}
    assert {(1, p), (2, "tail"), (2, rows[2][1])} <= out
    assert sorted(len(t.split()) for d, t in out if d is None) in ([0, 90], [20, 70])


def vectors_table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    near = np.repeat(x[:30], 5, axis=0) + rng.normal(size=(150, 16)) * np.repeat(rng.choice([0.05, 0.2, 0.3], 30), 5)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near, np.repeat(x[40:41], 30, axis=0), x[50:52] * 1e9]))]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [1.0] * 3), (1005, [float("inf")] * 16), (None, x[60].tolist()), (700, x[70].tolist()), (700, x[70].tolist())]
    return rows, spark.createDataFrame([(*r, "clash", 3) for r in rows], "vec_id long, embedding array<double>, row string, label int").repartition(3)


def usable(v):
    return v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("block", [2048, 7])
def test_vector_links_equal_brute_force(spark, block):
    rows, frame = vectors_table(spark)
    good = [i for i, (_, v) in enumerate(rows) if usable(v)]
    x = np.array([rows[i][1] for i in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(x @ x.T >= 0.95)
    links = [(good[i], good[j]) for i, j in zip(a, b) if i != j]
    count = defaultdict(int)
    for i, _ in links:
        count[i] += 1
    group = components(len(rows), links)
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    want = sorted((str(d), count[i], str(least.get(group[i])), d == least.get(group[i])) for i, (d, _) in enumerate(rows))
    got = lattice.link(frame, lattice.Settings(block=block)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == want


def test_planted_links_of_64_dimensions(spark):
    """1500 pairs just over the threshold, 1500 just under it and a chain, among random vectors."""
    rng = np.random.default_rng(21)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x, y = unit(rng.normal(size=(3000, 64))), rng.normal(size=(3000, 64))
    y = unit(y - (y * x).sum(1)[:, None] * x)
    cosine = np.where(np.arange(3000) < 1500, 0.9502, 0.9498)[:, None]
    chain = np.stack([np.cos(np.arange(40) * 0.3), np.sin(np.arange(40) * 0.3)], 1) @ unit(np.linalg.qr(rng.normal(size=(64, 2)))[0].T)
    table = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y, chain])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r for r in lattice.link(frame).collect()}
    full = unit(table) @ unit(table).T >= 0.95
    np.fill_diagonal(full, False)
    group = components(len(table), zip(*np.nonzero(full)))
    assert full.sum() // 2 >= 1539
    assert [got[i]["n_links"] for i in range(len(table))] == full.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(table))] == group


def test_lattice_points(spark):
    rng = np.random.default_rng(1)
    assert len(lattice.ROOTS) == 240
    x = rng.normal(size=(200, 8))
    home = lattice.nearest(x)
    d = ((x - home) ** 2).sum(1)
    for root in lattice.ROOTS:
        assert (((x - home - root) ** 2).sum(1) >= d - 1e-12).all()


def nearest(rows, k=10):
    """(query, rank, id) and scores by brute force, in exact decimal arithmetic where doubles would overflow."""
    seen = {(d, tuple(v)) for d, v in rows if usable(v) and d is not None}
    out = []
    for d, v in seen:
        if d % 100 == 0:
            far = lambda u: math.dist([p / 2 for p in v], [p / 2 for p in u]) * 2
            near = sorted((far(u), e) for e, u in seen if e != d)[:k]
            out += [(d, n + 1, e, x) for n, (x, e) in enumerate(near)]
    return sorted(out)


def found(frame, settings=neighbours.Settings()):
    return sorted(tuple(r) for r in neighbours.search(frame, F.col("vec_id") % 100 == 0, settings).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("part", [16384, 40])
def test_neighbours_are_exact_where_the_budget_covers_the_table(spark, part):
    rows, frame = vectors_table(spark)
    want = nearest(rows)
    got = found(frame.where("vec_id is not null"), neighbours.Settings(part=part, leaf=8, queries=3))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14)


def test_neighbours_of_huge_tiny_and_equal_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * s).tolist()) for i, s in enumerate(np.repeat([1e200, 1.0, 1e-170, 1e307], 60))]
    rows += [(i, [1e200] * 16) for i in range(300, 340)] + [(i, rows[100][1]) for i in range(400, 420)] + [(500, [-1e308] * 16), (501, [1.7e308] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = found(frame), nearest(rows)
    assert [g[0] for g in got] == [w[0] for w in want] and len(got) == 10 * 6
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert [g[:3] for g in got if g[0] in (300, 400)] == [w[:3] for w in want if w[0] in (300, 400)]


@pytest.mark.parametrize("rows,extra", [(3000, 0), (3000, 1024), (9000, 0)])
def test_recall_of_the_forest(spark, rows, extra):
    """Gaussian rows, the worst case; a query ranks fewer distances than a scan."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(rows, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    settings = neighbours.Settings(extra=extra)
    got = defaultdict(set)
    for q, _, v, _ in found(frame, settings):
        got[q].add(v)
    hits = 0
    for q in range(0, rows, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / (rows // 10) >= 0.9 and settings.visits < 1


def test_leaves_in_groups():
    start, split, many = neighbours.groups(np.array([[3, 4, 5, 0, 25], [1, 9, 10, 2, 0]]), 10)
    assert start.tolist() == [0, 0, 1, 1, 2, 5, 5, 6, 7, 7] and split.tolist() == [1, 1, 1, 1, 3, 1, 1, 1, 1, 1] and many == 8


def alternating(n, other=False):
    return "".join("ab"[(i.bit_count() + other) % 2] for i in range(n))


def test_long_alternating_words_are_different_words(make_docs, prose):
    rows = [(10 * k + other, alternating(n, bool(other))) for k, n in enumerate((1024, 2048, 4096)) for other in (0, 1)]
    out = near_dup.link(make_docs(rows), near_dup.Settings(words=2)).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in out)
    left, right = prose(49, 1), prose(49, 2)  # windows that differ in one word only
    held = [(i, f"{left} {t} {right}") for i, t in rows] + [(100, f"{left} {rows[0][1]} {right}")]
    got = {(r["doc_id"], r["start"], r["stop"]) for r in repeats.spans(make_docs(held)).collect()}
    assert got == {(0, 0, 99), (100, 0, 99)}


def test_word_hashes_do_not_depend_on_batching():
    import pyarrow as pa

    texts = ["Ab c\tde", "", None, "é ü x", "a" * 100000 + " b", "ab C"]
    whole = tokens.words_of(pa.array(texts))
    assert np.diff(whole[1]).tolist() == [3, 0, 0, 2, 2, 2]
    one = [tokens.words_of(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert whole[0].tolist() == sum(one, [])
    assert one[0][0] == one[5][0] and one[0][1] == one[5][1]
