"""Scores and pieces: held-out accuracy, exactness against the model's own library, odd input."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from knotwork.llm import language_id, pieces, sampling, toxicity

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLEAN = ["the tree stands by the river", "der Baum steht am Fluss", "we walk home", "sie gehen nach Hause und schlafen"]


def labelled(n, seed):
    rng = random.Random(seed)
    bad = ["idiot", "moron", "scum"]
    texts, labels = [], []
    for i in range(n):
        w = " ".join(rng.choice(CLEAN) for _ in range(rng.randrange(1, 30))).split()
        y = int(i % 4 == 0)
        if y:
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad) + rng.choice(["", "s", "!!", "ish"]))
        texts.append(" ".join(w))
        labels.append(y)
    return texts, labels


def test_toxicity_on_held_out_texts():
    model = toxicity.fit(*labelled(800, 1))
    texts, labels = labelled(300, 2)
    score = toxicity.predict(model, pa.array(texts))
    assert ((score >= 0.3) == np.array(labels)).mean() > 0.98
    unseen = toxicity.predict(model, pa.array(["you idiotic moronic fool", "the river", "", None, "123 ?!", "the " * 200 + "IDIOTS"]))
    assert unseen[0] > 0.3 > unseen[1] and unseen[2] == unseen[3] == unseen[4] == 0.0 and unseen[5] > 0.3


def test_toxicity_repeats_itself_and_ignores_batching():
    model, again = toxicity.fit(*labelled(200, 3)), toxicity.fit(*labelled(200, 3))
    texts = labelled(50, 4)[0]
    whole = toxicity.predict(model, pa.array(texts))
    assert (whole == toxicity.predict(again, pa.array(texts))).all()
    assert np.allclose(whole, [toxicity.predict(model, pa.array([t]))[0] for t in texts])


def test_toxicity_without_both_labels():
    assert toxicity.predict(toxicity.fit([], []), pa.array(["x", None])).tolist() == [0.0, 0.0]
    assert toxicity.predict(toxicity.fit(["a", "b"], [1, 1]), pa.array(["x"])).tolist() == [1.0]


def test_toxicity_over_a_table(spark, make_docs):
    texts, labels = labelled(120, 5)
    docs = make_docs([*enumerate(texts), (None, "the idiot"), (500, None), (3, texts[3])])
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(1, 0), (7, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    out = toxicity.score(docs, model)
    assert out.count() == 123 and out.columns == [*[c for c in docs.columns if c != "score"], "score"]
    assert {r["score"] for r in out.where("text is null").collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.train(docs, marks.where("false")).constant == 0.0


LANGUAGES = {
    "en": "the house of the people stands where they had been walking and thinking about nothing with other things".split(),
    "de": "das haus der leute steht dort wo sie gegangen waren und über nichts nachgedacht haben schön größer".split(),
    "fr": "la maison des gens est là où ils étaient allés et pensaient à rien avec été garçon forêt".split(),
}


def spoken(lang, n, rng):
    return " ".join(rng.choice(LANGUAGES[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    names = [n for n in LANGUAGES for _ in range(60)]
    return language_id.fit([spoken(n, 40, rng) for n in names], names, language_id.Settings(sequences=1200))


def test_languages_of_held_out_texts(model):
    rng = random.Random(2)
    names = [n for n in LANGUAGES for _ in range(30)]
    got, score = language_id.predict(model, pa.array([spoken(n, rng.randrange(3, 60), rng) for n in names]))
    assert got == names and score.min() > 0.5 and score.max() <= 1


def test_words_of_switching_text_are_labelled(model):
    rng = random.Random(3)
    post, _ = language_id.label_terms(model, pa.array([spoken("en", 12, rng) + " " + spoken("fr", 12, rng)]))
    got = [model.languages[i] for i in post.argmax(1)]
    assert got[2:10] == ["en"] * 8 and got[14:22] == ["fr"] * 8


def test_long_texts_are_solved_exactly(model):
    rng = random.Random(4)
    size = [0, 1, 5, 300, 2000, 0, 17]
    first = np.concatenate([[0], np.cumsum(size)])
    emission = np.random.default_rng(5).normal(size=(first[-1], 3)) * 3
    cut = language_id.Model(model.languages, model.emission, model.transition, model.start, language_id.Settings(run=7))
    got = language_id.posteriors(cut, emission, first)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            want, _ = language_id._messages(np.exp(emission[None, a:b]), np.exp(model.transition), np.exp(model.start), np.ones((1, b - a), bool))
            assert np.allclose(want[0], got[a:b])
    assert rng


def enumerated(e, trans, start):
    """(posteriors, expected transitions, log of the sum) over all paths, one by one."""
    t, k = e.shape
    post, moved, whole = np.zeros((t, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=t):
        p = np.exp(start[path[0]] + sum(e[i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        whole += p
        for i, s in enumerate(path):
            post[i, s] += p
        for a, b in zip(path, path[1:]):
            moved[a, b] += p
    return post / whole, moved / whole, np.log(whole)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(11)
    for t, k in ((1, 3), (2, 2), (5, 3), (4, 4)):
        e, trans, start = rng.normal(size=(t, k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
        post, moved, whole = enumerated(e, trans, start)
        got, steps = language_id._messages(np.exp(e)[None], np.exp(trans), np.exp(start), np.ones((1, t), bool))
        assert np.allclose(got[0], post) and np.allclose(steps, moved)
        m = language_id.Model([str(i) for i in range(k)], np.zeros((1, k)), trans, start, language_id.Settings(run=2))
        assert np.allclose(language_id.posteriors(m, e, np.array([0, t])), post)
        # what training descends by is the gradient of the log-likelihood: by differences
        for what, slope in ((e, post), (trans, moved), (start, post[0])):
            for at in itertools.product(*map(range, what.shape)):
                what[at] += 1e-5
                up = enumerated(e, trans, start)[2]
                what[at] -= 2e-5
                down = enumerated(e, trans, start)[2]
                what[at] += 1e-5
                assert abs((up - down) / 2e-5 - slope[at]) < 1e-5


def test_ties_go_to_the_language_that_sorts_first():
    flat = language_id.Model(["aa", "bb", "cc"], np.zeros((1024, 3), np.float32), np.zeros((3, 3)), np.zeros(3), language_id.Settings(buckets=1024))
    names, score = language_id.predict(flat, pa.array(["any words at all", "x"]))
    assert names == ["aa", "aa"] and np.allclose(score, 1 / 3)


def test_start_potentials_are_learned(model):
    assert np.abs(model.start).max() > 0


def test_n_grams_are_of_whole_characters():
    terms = language_id.Terms(pa.array(["größer ÄÖ 日本語"]))
    assert (terms.ends - terms.starts).tolist() and sorted((terms.ends - terms.starts).tolist()) == [2, 3, 6]
    ids, first = terms.features(2, 3, 1 << 30)
    assert sorted(np.diff(first).tolist()) == sorted(1 + (n + 1) + n for n in (2, 3, 6))  # the term, and its n-grams between end marks
    one, two = (set(language_id.Terms(pa.array([w])).features(3, 3, 1 << 30)[0].tolist()) for w in ("größe", "xröße"))
    assert len(one & two) == 3  # röß, öße, ße>


def plain_score(model, text):
    """The toxicity of a text, term by term and window by window."""
    s = model.settings
    if not (found := re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")):
        return 0.0
    weights = []
    for word, past in zip(found, [None, *found]):
        if past is None or word.translate(FOLD) != past.translate(FOLD):
            ids, _ = toxicity.Terms(pa.array([word])).features(s.shortest_gram, s.longest_gram, s.buckets)
            weights.append(float(np.mean([model.feature[i] for i in ids])))
    n = min(s.window, len(weights))
    best = max(sum(weights[i : i + n]) / n for i in range(len(weights) - n + 1))
    return 1 / (1 + np.exp(-(best + model.bias)))


def test_toxicity_equals_a_plain_scorer():
    model = toxicity.fit(*labelled(300, 6))
    texts = [*labelled(40, 7)[0], "Idiot idiot IDIOT", "a", "1 2", "", None, " ".join(CLEAN * 1500) + " you idiots", "x" * 30_000, "größer 日本 scum"]
    got = toxicity.predict(model, pa.array(texts))
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-6)
    assert got[-3] > 0.3  # the last of 20,000 words


def test_toxicity_of_misspelt_words():
    model = toxicity.fit(*labelled(800, 1))
    assert (toxicity.predict(model, pa.array(["such an idiiot", "you moronn", "scumm of them", "idiotas"])) > 0.3).sum() >= 3


def test_transitions_are_learned(model):
    assert (np.diag(model.transition) > model.transition.max(1) - 1e-9).all()


def test_languages_over_a_table(make_docs):
    rng = random.Random(6)
    rows = [(i, spoken(n, 20, rng), n) for i, n in enumerate(list(LANGUAGES) * 20)]
    docs = make_docs([*rows, (100, None, "en"), (101, "", None), (102, "12 345 !?", "en"), (103, spoken("de", 30000, rng), None), (None, "the house", None), (104, "Ω", None)])
    trained = language_id.train(docs, language_id.Settings(sequences=600))
    out = {r["doc_id"]: r for r in language_id.identify(docs, trained).collect()}
    assert len(out) == 66
    assert [out[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and out[100]["score"] == 0.0
    assert out[103]["lang_pred"] == "de" and out[None]["lang_pred"] == "en" and out[104]["lang_pred"] in LANGUAGES
    nothing = language_id.train(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    one = language_id.train(docs.where("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs.where("doc_id < 5"), one).collect()} == {("en", 1.0)}
    assert language_id.identify(docs.where("false"), trained).count() == 0


def test_every_language_is_learned(make_docs):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    names = [f"l{i:03}" for i in range(205)]  # the last three are the rarest
    own = {n: [word() for _ in range(4)] for n in names}
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 5)
    say = lambda n, size: " ".join(rng.choice(own[n]) for _ in range(size))
    rows = [(next(ids), say(n, 12), n) for n in names for _ in range(1 if n > "l201" else 2)]
    docs = make_docs(rows)
    trained = language_id.train(docs, language_id.Settings(epochs=1))
    assert trained.languages == names
    asked = [(i, say(n, 9), n) for i, n in enumerate(["l000", "l100", "l202", "l203", "l204"])]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(make_docs(asked), trained).collect()}
    assert got == {i: n for i, _, n in asked}


def test_languages_of_long_texts_only_are_learned(make_docs):
    rng = random.Random(8)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, spoken(n, 90 if n == "fr" else 8, rng), n) for i, n in zip(ids, list(LANGUAGES) * 30)]
    rows += [(i, "12 34", "xx") for i in ids[100:103]] + [(ids[0], "slova jiná řeč", "cs")]  # the id of another language's document
    trained = language_id.train(make_docs(rows), language_id.Settings(sample=20, longest=200, sequences=600))
    assert trained.languages == ["cs", "de", "en", "fr"]
    assert language_id.predict(trained, pa.array([spoken("fr", 500, rng)]))[0] == ["fr"]


def test_samples_of_each_label_are_the_smallest_hashes(spark):
    rows = [("a", i) for i in range(3000)] + [("b", i % 7) for i in range(3000)] + [("c", 5)]
    frame = spark.createDataFrame(rows, "label string, key long")
    got = sampling.smallest_of_each(frame, {"a": 3000, "b": 3000, "c": 1}, 10)
    for label in "abc":
        assert [k for n, k in got if n == label] == sampling.smallest_by_hash(frame.where(f"label = '{label}'"), "key", 10)


def test_totals_equal_summed_posteriors():
    rng = np.random.default_rng(6)
    size, k = [0, 1, 5, 300, 40, 0, 17], 20
    first = np.concatenate([[0], np.cumsum(size)])
    table, kind = rng.normal(size=(50, k)) * 3, rng.integers(0, 50, first[-1])
    wide = language_id.Model([str(i) for i in range(k)], table, rng.normal(size=(k, k)), rng.normal(size=k), language_id.Settings(run=7))
    post = language_id.posteriors(wide, table[kind], first)
    assert np.allclose(language_id.totals(wide, table, kind, first), [post[a:b].sum(0) for a, b in zip(first[:-1], first[1:])])
    assert language_id.totals(wide, table[:0], kind[:0], np.zeros(3, np.int64)).tolist() == [[0.0] * k] * 2


ODD = ["Hello  world\n\tfoo ▁x é 𝔘", "", " ", "   a  b ", "a" * 40, "the 1234567890 日本語 안녕", "#### ---- ====", "\x00abc\x00", "a" * 100 + " " + "ab" * 50, "😀😀 x😀y", "don't ''''", "x" * 3000]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.load())


def test_pieces_equal_the_library(encoder):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(9)
    names = [model.id_to_piece(i).replace(pieces.MARK, " ") for i in range(259, 32000)]
    texts = ODD + ["".join(rng.choice(names) for _ in range(rng.randrange(60))) for _ in range(1500)]
    ids, first = encoder.encode(pa.array(texts))
    want = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want
    assert pieces.decode(encoder.v, ids.astype(np.int64), first) == [t.replace(pieces.MARK, " ") for t in texts]


def alternating(n, other=False):
    return "".join("ab"[(i.bit_count() + other) % 2] for i in range(n))


def test_long_alternating_words_are_told_apart(encoder):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [alternating(n, other) for n in (1024, 2048, 4096) for other in (False, True)]
    ids, first = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == model.encode(texts)
    assert pieces.decode(encoder.v, ids.astype(np.int64), first) == texts


def test_chunks_with_one_hash_are_told_apart(encoder, monkeypatch):
    plain = pieces.tokens.hash_spans
    fresh = pieces.Encoder(encoder.v)
    one = fresh.encode(pa.array(["some words here", "other"]))[0].tolist()
    for seeds in ({0}, {0, 1}):  # in one batch, and between a batch and the memory
        monkeypatch.setattr(pieces.tokens, "hash_spans", lambda raw, a, b, fold=True, seed=0: plain(raw, a, b, fold, seed) % np.uint64(2 if seed in seeds else 1 << 63))
        again = pieces.Encoder(encoder.v)
        assert again.encode(pa.array(["some words here", "other"]))[0].tolist() == one and again.seed == len(seeds)
    monkeypatch.setattr(pieces.tokens, "hash_spans", lambda raw, a, b, fold=True, seed=0: plain(raw, a, b, fold, seed) * np.uint64(seed > 0))
    again = pieces.Encoder(encoder.v)
    got = [again.encode(pa.array([t]))[0].tolist() for t in ("some", "here")]
    assert got == [encoder.encode(pa.array([t]))[0].tolist() for t in ("some", "here")] and again.seed == 1


def test_pieces_over_64_bytes(tmp_path, encoder):
    import dataclasses

    long = "ab" * 50  # as if the model held it: index and search reach as far as the longest piece
    padded = np.zeros((1, 104), np.uint8)
    padded[0, :100] = np.frombuffer(long.encode(), np.uint8)
    words = padded.view(">u8").astype(np.uint64)
    v = dataclasses.replace(encoder.v, words=words, size=np.array([100]))
    text = np.frombuffer(f"x{long}y{long}b".encode() + b"\0", np.uint8)
    order, word = pieces.suffix_array(text, np.arange(len(text) - 1), words.shape[1])
    lo, hi = pieces.ranges(v, order, word, np.array([0]))
    assert sorted(order[lo[0] : hi[0]].tolist()) == [1, 102]


def test_pieces_when_the_memory_is_full(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "_REMEMBERED", 5)
    fresh = pieces.Encoder(encoder.v)
    for text in ODD:
        assert fresh.encode(pa.array([text, text]))[0].tolist() == encoder.encode(pa.array([text, text]))[0].tolist()


def test_pieces_over_a_table(make_docs):
    docs = make_docs([*enumerate(ODD), (None, "x"), (99, None), (0, ODD[0])])
    out = pieces.decoded(pieces.encode(docs))
    assert out.columns == [*docs.columns, "ids", "decoded"]
    for r in out.collect():
        assert r["decoded"] == (None if r["text"] is None else r["text"].replace(pieces.MARK, " "))
        assert (r["ids"] is None) == (r["text"] is None)
    assert pieces.encode(docs.where("false")).count() == 0
