"""Toxicity, ranked search and vector codes against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_samples import WORDS, text

from docloom.llm import class_model, ranked_search, toxicity, vector_codes
from docloom.llm.hashing import word_lists
from docloom.llm.terms import term_counts, term_lists

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(t):
    return TERM.findall((t or "").translate(_LOWER))


def test_terms():
    odd = ["", None, "A b-C", "É é_x9", "\x00a\x7fb", "x" * 40, "ñÑ 日本 a.b", "Z[z`{|}~"] + [text(random.Random(i), 50) for i in range(20)]
    found = term_lists(odd)
    assert [len(f) for f in found] == [len(terms_of(t)) for t in odd] == term_counts(odd)
    ids = {}
    for f, t in zip(found, odd):
        for h, w in zip(f.tolist(), terms_of(t)):
            assert ids.setdefault(h, w) == w
    assert len(ids) == len(set(ids.values()))


def ranking(docs, items, k=10):
    """Ranked search as its contract words it, over all documents of every item."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, t in {(i, t) for i, t in items if t is not None}:
        scores = []
        for i, c in counted:
            m = 25 + 75 * c.total() * n_docs // n_terms
            total = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms_of(t) if w in c)
            if total > 0:
                scores.append((-total, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = WORDS + [f"w{i}" for i in range(200)]
    docs = [" ".join(rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=rng.randint(0, 80))) for _ in range(n)]
    return rng, words, docs


@pytest.mark.parametrize("shard_terms,block_terms", [(200, 30), (5000, 1000), (1 << 20, 1 << 20)])
def test_ranked_search_equals_full_scoring(spark, shard_terms, block_terms):
    rng, words, docs = corpus(3, 300)
    docs += docs[:40] + ["only", None, "  ..", "only"]  # ties, repeats
    rows = [(rng.randrange(250) if i % 50 else None, t) for i, t in enumerate(docs)]
    items = [(j, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for j in range(25)] + [(3, "only only of"), (99, "nowhere"), (98, None), (97, ""), (0, "of the"), (0, "of the")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = ranked_search.search(d, spark.createDataFrame(items, "item_id long, text string"), shard_terms=shard_terms, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranking(rows, items)


def test_descent_under_a_known_score():
    """One shard: any least score gives those of the best that reach it, ties by document."""
    rng, words, docs = corpus(5, 200)
    lists = [x for x in term_lists(docs + docs[:50]) if len(x)]
    shard = ranked_search.Shard.read(*ranked_search.Shard.build(lists, len(lists), sum(map(len, lists))).row(), len(lists))
    wanted = np.unique(term_lists([" ".join(rng.choices(words, k=12))])[0])
    has, at = shard.find(wanted)
    tree = ranked_search.Descent(shard, at)
    weight = np.arange(1, len(at) + 1)
    score = Counter()
    sizes = np.array([len(x) for x in lists])
    for w, h in zip(weight, wanted[has]):
        for i, x in enumerate(lists):
            if tf := int((x == h).sum()):
                score[i] += int(w) * int(ranked_search.impacts(np.array([tf]), sizes[i : i + 1], len(lists), int(sizes.sum()))[0])
    best = sorted((-s, i) for i, s in score.items())
    for least in (0, -best[3][0], -best[9][0], -best[0][0] + 1):
        q, d, s = tree.top(np.zeros(len(at), np.int64), tree.starts[:-1], tree.starts[1:], weight, np.array([least]), 10)
        assert list(zip((-s).tolist(), d.tolist())) == [x for x in best[:10] if -x[0] >= least]


def lloyd(rows, parts=16, entries=64, rounds=2):
    """Product quantization as its contract words it."""
    x = np.array([[math.floor(256 * v) for v in e] for _, e in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    size = x.shape[1] // parts
    x = x.reshape(len(x), parts, size)
    books = [[x[i, p].tolist() for i in order[:entries]] for p in range(parts)]
    for k in range(rounds + 1):
        code = [[min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, books[p][e])), e)) for v in x[:, p].tolist()] for p in range(parts)]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = x[[i for i, c in enumerate(code[p]) if c == e], p]
                    if len(own):
                        books[p][e] = [int(s) // len(own) for s in own.sum(axis=0)]
    error = [sum(sum((a - b) ** 2 for a, b in zip(x[i, p].tolist(), books[p][code[p][i]])) for p in range(parts)) for i in range(len(rows))]
    return ["".join(f"{code[p][i]:02x}" for p in range(parts)) for i in range(len(rows))], error, books


@pytest.mark.parametrize("scale,n", [(0.01, 300), (0.3, 300), (2.0, 40)])
def test_vector_codes_equal_lloyd(spark, scale, n):
    """scale 0.01: few distinct integers, so ties everywhere."""
    rng = np.random.default_rng(1)
    rows = [(int(i) if i % 17 else None, [float(np.float32(v)) for v in rng.normal(0, scale, 32)]) for i in rng.permutation(n)]
    rows += rows[:20]
    odd = [(1, None), (2, []), (3, [None] * 32), (4, [float("nan")] + [0.0] * 31), (5, [float("-inf")] + [0.0] * 31), (6, [0.0] * 16)]
    frame = spark.createDataFrame([(i, v, k % 3) for k, (i, v) in enumerate(rows + odd)], "vec_id long, embedding array<float>, label int").repartition(5)
    codes, books = vector_codes.vector_codes(frame)
    want_codes, want_error, want_books = lloyd(rows)
    assert books.tolist() == want_books
    key = lambda r: repr(r)
    assert sorted(((r["vec_id"], r["codes"].hex(), r["error"]) for r in codes.collect()), key=key) == sorted(((i, c, e) for (i, _), c, e in zip(rows, want_codes, want_error)), key=key)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 40, (2000, 4)) + rng.integers(0, 6, (2000, 1)) * 100).astype(np.int64)
    first = vector_codes.Codebook(x[:64].copy(), None)
    own, exact, lower = first.first(x)
    done = []
    before = first
    for _ in range(5):
        moved = np.array([x[own == e].sum(axis=0) // max(1, (own == e).sum()) if (own == e).any() else before.entries[e] for e in range(64)])
        book = vector_codes.Codebook(moved, before.entries)
        upper, gaps = before.packed(exact, lower)
        upper, lower = vector_codes.unpacked(upper.astype(float), gaps, 64, before.step)
        d = vector_codes.squared(x, before.entries)
        assert (lower**2 <= d + 1e-6).all() and (upper**2 + 1e-6 >= d[np.arange(len(x)), own]).all()
        own, exact, lower, n = book.again(x, own, upper, lower)
        d = vector_codes.squared(x, book.entries)
        assert (own == d.argmin(axis=1)).all() and (exact == d.min(axis=1)).all()
        done.append(n)
        before = book
    assert max(done) < len(x) * 64 / 4


def plain_features(terms):
    """Distinct terms, neighbours and pairs with one or two terms between."""
    return {(0, t) for t in terms} | {(k, a, b) for k in (1, 2, 3) for a, b in zip(terms, terms[k:])}


def test_toxicity_features():
    rng = random.Random(4)
    seen = {}
    for _ in range(40):
        t = text(rng, rng.randint(0, 60))
        plain = plain_features(terms_of(t))
        found = toxicity.features(term_lists([t])[0])
        assert found[-1] == toxicity.BUCKETS and len(found) - 1 <= len(plain)
        assert len(plain) - (len(found) - 1) <= 3  # hardly a collision
        seen[t] = set(found.tolist())
    weights = np.random.default_rng(0).normal(size=toxicity.BUCKETS + 1).astype(np.float32)
    weights[::3] = 0
    for t, at in seen.items():
        assert abs(toxicity.margin(weights, term_lists([t])[0]) - weights[sorted(at)].astype(float).sum()) < 1e-6
    long = term_lists([text(rng, 3000)])[0]
    whole = toxicity.margin(weights, long)
    held, toxicity.SLICE = toxicity.SLICE, 64
    try:
        assert abs(toxicity.margin(weights, long) - whole) < 1e-6
    finally:
        toxicity.SLICE = held


def test_learner_equals_ftrl_by_coordinate():
    rng = random.Random(5)
    learner = toxicity.Learner(np.zeros(21), np.zeros(21))
    z, n = Counter(), Counter()

    def weight(i):
        rate = (toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA
        if i == 20:
            return -z[i] / rate
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / (rate + toxicity.L2)

    for _ in range(400):
        at = sorted(rng.sample(range(20), 6)) + [20]
        y = int(3 in at) if rng.random() < 0.9 else 1
        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-sum(w.values())))
        for i in at:
            g = p - y
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
            n[i] += g * g
        assert abs(learner.learn(np.array(at), y) - p) < 1e-9
    assert learner.weights(np.arange(21))[3] > 1


def labelled(n, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = text(rng, rng.randint(20, 60)).split()
        if toxic:
            for w in rng.sample(["vile", "rotten", "foul"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", "s", 0))
        if rng.random() < 0.8:
            labels.append((i, 0, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, folder):
    rows, labels = labelled(1500)
    truth = {i: any(w in t for w in ("vile", "rotten", "foul")) for i, t, *_ in rows}
    docs = spark.createDataFrame(rows + [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (None, "vile", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = folder(documents=docs, labels=spark.createDataFrame(labels + [(None, 0, 0), (7, 0, None)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.op11_toxicity(spark, sf).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 300 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert got[5000]["score"] == got[5001]["score"] < 0.3
    docs.repartition(3).write.mode("overwrite").parquet(sf + "/documents.parquet.again")
    again = toxicity.score_texts(spark.read.parquet(sf + "/documents.parquet.again").select("doc_id", "text"), toxicity.learned(spark.read.parquet(sf + "/documents.parquet.again"), spark.read.parquet(sf + "/labels.parquet")))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {i: r["score"] for i, r in got.items()}  # however the input is split


def test_toxicity_without_both_kinds(spark, no_docs):
    rows, _ = labelled(20)
    docs = spark.createDataFrame(rows, no_docs.schema)
    for labels, want in (([], 0.0), ([(1, 0, 0)], 0.0), ([(i, 0, 1) for i in range(20)], 1.0)):
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert all(abs(r["score"] - want) < 1e-9 for r in toxicity.score_texts(docs, toxicity.learned(docs, frame)).collect())


def test_class_scores_do_not_depend_on_partitions(spark):
    rng, words, texts = corpus(9, 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for shuffled, split in ((2, 1), (8, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
            model, counts = class_model.learn(docs.repartition(split))
            found.append({r["doc_id"]: (r["n_known"], round(r["score"], 6)) for r in class_model.score_texts(docs, model, counts).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert found[0] == found[1] and len(found[0]) == 150


def test_class_bigrams_follow_the_moves(spark):
    _, _, texts = corpus(11, 200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = np.unique(np.concatenate(word_lists(texts)))[:120]
    bigrams = class_model.bigram_counts(docs, names, np.arange(len(names) + 1), len(names) + 2)
    of, between, reached = class_model.cluster(bigrams, len(names), len(names) + 2, classes=6)
    want = np.zeros_like(between)
    for r in bigrams.collect():
        want[of[r["p"]], of[r["c"]]] += r["n"]
    assert (between == want).all() and len(reached) > 3 and reached == sorted(reached)
