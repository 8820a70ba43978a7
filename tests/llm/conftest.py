import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, member int, `key` string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) with further columns whose names clash with inner ones."""

    def make(rows, parts=3):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *(None, "s0")[len(r) - 2 :])[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text), 0.5, "x", 7, "k"))
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


def words(n, seed, vocabulary=4000):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return words
