from collections import Counter

import corpus_pipeline
from docloom.llm import queries, secrets
from test_llm_operators import brute_components


def test_stages(spark, folder, docs, corpus):
    item = next(t for i, t, *_ in corpus if i == 40)
    secret = [(2000, "una casa y un perro con password: hunter2222 en la luna", "es", "s", 0)]
    all_docs = docs.union(spark.createDataFrame(secret, docs.schema))
    sf = folder(documents=all_docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    seen, frame = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        seen[name] = frame.collect()
        if name != "packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(any(c.isalpha() for c in r["text"]) for r in seen["language"])
    assert {r["doc_id"] for r in seen["near_duplicates"]} < {r["doc_id"] for r in seen["language"]}
    assert 40 in {r["doc_id"] for r in seen["near_duplicates"]} and 40 not in {r["doc_id"] for r in seen["decontamination"]}
    assert len(seen["secrets"]) == len(seen["decontamination"]) and "hunter2222" not in " ".join(r["text"] for r in seen["secrets"])
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["secrets"]}
    assert corpus_pipeline.run(spark, sf).count() == len(seen["packing"])


def test_run_equals_brute_force(spark, folder, corpus):
    """All stages after the language model, whose code lengths have a test of their own, by plain Python."""
    rows = list({i: (i, t, lang, s, n) for i, t, lang, s, n in reversed(corpus) if i is not None}.values())
    item = next(t for i, t, *_ in rows if i == 40)
    frame = spark.createDataFrame([*rows, (3000, "la casa del perro y la luna del mar con token: abcdef1234 y sol", "es", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = folder(documents=frame, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    kept = [tuple(r) for r in corpus_pipeline.language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()]
    one = {i for i, n, c in brute_components(kept) if n == 0 or i == c}
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
    clean = [(i, t) for i, t, *_ in kept if i in one and 100 * len(grams(t) & grams(item)) < 75 * len(grams(item))]
    assert 0 < len(clean) < len(one) < len(kept)
    want = Counter()
    for i, t in clean:
        n = len(secrets._redact(t).split()) + 1
        for piece, start in enumerate(range(0, n, 4096)):
            want[i, piece, start, min(4096, n - start)] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want and any(i == 3000 for i, *_ in want)


def test_registered():
    assert sorted(queries.queries()) == sorted(f"op{n}_{name}" for n, name in enumerate("benchmark_decontamination secret_scans token_counts suffix_array_dedup class_model language_id ngram_jaccard_join best_fit_packing transport_streams url_filters".split(), 1))
