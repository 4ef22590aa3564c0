import random

import pytest
from llm_samples import text

@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empty, ties, a long text, repeated rows, a null id."""
    rng = random.Random(7)
    texts = [text(rng, rng.randint(1, 160)) for _ in range(60)]
    near = []
    for t in texts[:20]:
        w = t.split()
        if len(w) > 30:
            w[rng.randrange(len(w))] = "distinto"
            near.append(" ".join(w))
    passage = text(rng, 120)
    shared = [text(rng, 40) + " " + passage + " " + text(rng, 30) for _ in range(6)]
    lines = ["\n".join([text(rng, 12)] * 90)]
    odd = [None, "", "   ", "x", "A B", "uno dos tres cuatro", "¡¡!!", "é" * 500, "\x00\x0b a\x0bb", text(rng, 6000)]
    rows = [(i, t, rng.choice(["es", "en", None]), f"s{i % 3}", 0) for i, t in enumerate([*texts, *texts[:5], *near, *shared, *lines, *odd])]
    return [*rows, rows[3], rows[3], (None, texts[0], "es", "s", 0)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
