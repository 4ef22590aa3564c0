import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import class_model, decontaminate, hashing, jaccard_join, language, packing, secrets, suffix_dedup, token_counts, transport, url_filter
from docloom.llm.graph import components


def words(t):
    return (t or "").encode().lower().split()


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# --- 1 ---


@pytest.mark.parametrize("literal", [20_000, 0])
def test_decontamination(spark, docs, corpus, literal):
    rng = random.Random(2)
    source = next(t for i, t, *_ in corpus if t and len(t.split()) > 100)
    w = source.split()
    items = [(1, " ".join(w[10:40])), (2, "uno dos tres cuatro"), (3, None), (4, ""), (5, "nothing of this is there at all"), (6, " ".join(w[20:50]).upper()), (7, " ".join(rng.sample(w, 30)))]
    got = decontaminate.search(docs, spark.createDataFrame(items, "item_id int, text string"), literal).distinct().collect()
    want = set()
    for i, t, *_ in corpus:
        d = (t or "").lower().split()
        for k, u in items:
            q = (u or "").lower().split()
            n = min(5, len(q))
            if n:
                grams = {tuple(q[a : a + n]) for a in range(len(q) - n + 1)}
                both = grams & {tuple(d[a : a + n]) for a in range(len(d) - n + 1)}
                if 100 * len(both) >= 75 * len(grams):
                    want.add((i, k, len(grams), len(both)))
    assert {tuple(r) for r in got} == want and {k for _, k, *_ in want} >= {1, 2, 6}
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id int, text string"))
    assert left.count() == sum(i not in {x[0] for x in want} for i, *_ in corpus) and left.columns == docs.columns


# --- 2 ---


def test_secrets_base_and_structure():
    import base64

    find = lambda t: secrets.order(secrets.base_spans(t) + secrets.structural_spans(t))
    assert find("") == [] and find("password=short") == []
    assert find('Password" : "hunter22 rest') == [("assign", 0, 21)]
    assert find("AKIA" + "A" * 16) == [("access", 0, 20)] and find("AKIA" + "A" * 15) == []
    assert find("f" * 24) == [("hex", 0, 24)]
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"1"}', b"signature"))
    assert ("jwt", 2, 2 + len(token)) in find("x " + token)
    assert not any(k == "jwt" for k, *_ in find(token.replace("eyJhbGci", "eyJhbGcx")))
    hidden = base64.b64encode(b"api_key=abcdef0123456789").decode()
    assert ("encoded", 2, 2 + len(hidden)) in find("a " + hidden)
    assert find("a " + base64.b64encode(b"only some plain words here").decode()) == []
    key = bytes([0x30, 0x11, 0x02, 0x01, 0x00]) + bytes([0x02, 0x01, 0x05]) * 0 + bytes([0x04, 0x0C]) + b"k" * 12
    assert secrets.is_private_key(bytes([0x30, 0x15, 0x02, 0x01, 0x01, 0x04, 0x10]) + b"k" * 16) and not secrets.is_private_key(key[:-1])


def test_secret_keys_and_tokens():
    import base64

    find = lambda t: secrets.order(secrets.base_spans(t) + secrets.structural_spans(t))
    seq = lambda tag, body: bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body
    oid, data = bytes([0x06, 3, 42, 3, 4]), bytes(range(1, 101))
    encrypted = seq(0x30, seq(0x30, oid) + seq(0x04, data))
    plain = seq(0x30, bytes([2, 1, 0]) + seq(0x30, oid) + seq(0x04, data))
    assert secrets.is_private_key(encrypted) and secrets.is_private_key(plain) and not secrets.is_private_key(seq(0x30, seq(0x30, oid)))
    wrapped = base64.encodebytes(plain).decode().rstrip()
    assert "\n" in wrapped and ("key", 2, 2 + len(wrapped)) in find("a " + wrapped.replace("\n", "\n") + " b")
    pem = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + base64.encodebytes(data[:96]).decode() + "-----END RSA PRIVATE KEY-----"
    assert ("pem", 0, len(pem)) in find(pem) and not any(k == "pem" for k, *_ in find(pem.replace("ENCRYPTED", "CLEAR")))
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    for head, signature, want in ((b'{"alg":"ES256"}', b"sig", True), (b'{"alg":"none"}', b"sig", False), (b'{"alg":"ES256"}', b"", False), (b'{"kid":"1"}', b"sig", False)):
        token = ".".join(map(part, (head, b'{"sub":"1"}', signature)))
        assert (("jwt", 0, len(token)) in find(token)) == want


BASE_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES ('access', 'AKIA[A-Z0-9]+', 20), ('hex', '[0-9a-f]+', 24)) p(kind, pattern, least)),
m AS (SELECT doc_id, kind, least, t AS rest, 0 AS seen, '' AS hit, 0 AS start FROM d, p
 UNION ALL SELECT doc_id, kind, least, substr(rest, strpos(rest, h) + length(h)), seen + strpos(rest, h) - 1 + length(h), h, seen + strpos(rest, h) - 1 FROM (SELECT m.*, regexp_extract(rest, pattern) AS h FROM m JOIN p USING (kind)) WHERE h <> '')
SELECT doc_id, count(*) FILTER (kind = 'access' AND length(hit) >= least) AS n_access, count(*) FILTER (kind = 'hex' AND length(hit) >= least) AS n_hex,
 list_sort(list(start) FILTER (length(hit) >= least AND hit <> '')) AS starts FROM m GROUP BY doc_id"""


def test_secret_base_equals_sql(spark, folder, docs):
    """Counts and places of access keys and hex strings against DuckDB; leftmost non-overlapping matches by recursion."""
    import duckdb

    rng = random.Random(11)
    odd = ["AKIA" + "".join(rng.choices("AK1Z", k=rng.randint(10, 24))) + rng.choice(["", " ", "ñ"]) + "".join(rng.choices("0123abcfg", k=rng.randint(10, 60))) for _ in range(60)]
    rows = [(5000 + k, t, "es", "s", 0) for k, t in enumerate(odd)]
    sf = folder(documents=docs.where("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame(rows, docs.schema)))
    got = {r["doc_id"]: (r["n_access"], r["n_hex"], sorted(int(x.split(":")[1]) for x in r["spans"].split(",") if x.startswith(("access", "hex")))) for r in secrets.op2_secret_scans(spark, sf).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = {i: (a, h, s or []) for i, a, h, s in con.execute(BASE_SQL).fetchall()}
    assert got == want and sum(a + h for a, h, _ in want.values()) > 30


def test_secret_query(spark, docs, corpus, folder):
    rows = [(0, "token: abcdef123", "x"), (1, None, "y"), (2, "", "z")]
    out = {r["doc_id"]: r for r in secrets.op2_secret_scans(spark, folder(documents=spark.createDataFrame(rows, "doc_id long, text string, base_spans string"))).collect()}
    assert out[0]["n_assign"] == 1 and out[0]["base_sha256"] == hashlib.sha256(b"assign:0:16").hexdigest() and out[0]["spans"] == "assign:0:16"
    assert out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() == out[2]["base_sha256"]
    red = secrets.redact_secrets(docs)
    assert red.count() == len(corpus) and red.columns == docs.columns
    one = secrets.redact_secrets(spark.createDataFrame([(1, "a token: abcdef123 b", 0)], "doc_id long, text string, n_chars long")).first()
    assert (one["text"], one["n_chars"]) == ("a [assign] b", 12)


# --- 3 ---


def test_token_counts(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = [(1000 + k, t, "es", "s", 0) for k, t in enumerate(["<|endoftext|> a", "日本語 text", "a\u3000b", "don't  stop\n\n ok ", "ǅ ǆ ٣", "\u200b\ufeff", "x" * 5000])]
    rows = [*corpus, *more]
    got = token_counts.count_tokens(docs.union(spark.createDataFrame(more, docs.schema)), path).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert Counter(tuple(r) for r in got) == want


def test_token_counts_of_nothing(no_docs):
    import public_tokenizers

    assert token_counts.count_tokens(no_docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


# --- 4 ---


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("held", [20_000, 1])
def test_suffix_dedup(docs, corpus, held, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect())
    data = [(t or "").encode() for _, t, *_ in corpus]
    count = Counter(b[p : p + 400] for b in data for p in range(len(b) - 399))
    want = Counter()
    for (i, *_), b in zip(corpus, data):
        mark = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                mark[p : p + 400] = b"\1" * 400
        want[i, len(b), mark.count(1), (b"\0" + bytes(mark)).count(b"\0\1"), bytes(x for x, m in zip(b, mark) if not m)] += 1
    assert got == want and sum(k[2] for k in want) > 3000
    assert all(r["kept_chars"] == len(bytes(r["kept"]).decode(errors="ignore")) for r in suffix_dedup.remove_repeats(docs).collect())


@pytest.mark.parametrize("size", [450, 1000, 2048])
def test_suffix_dedup_across_segments(size, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", size)  # in this process: workers import the module anew
    rng = random.Random(size)
    line = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passages = [line(rng.randint(400, 700)) for _ in range(12)]
    texts = ["".join(line(rng.randint(100, 900)) + p for p in rng.sample(passages, 12)) for _ in range(3)]
    table = lambda rows, names: pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in sorted(rows)])
    listed = lambda batches: [tuple(r.values()) for b in batches for r in b.to_pylist()]
    keyed = [{"tkey": k, "text": t} for k, t in enumerate(texts)]
    anchored = listed(suffix_dedup._anchored([pa.RecordBatch.from_pylist(keyed)]))
    assert len({r[1:4] for r in anchored}) == len(anchored)
    grams = defaultdict(list)
    for k, place, first, last in listed(suffix_dedup._repeated([table(anchored, ["route", "h", "tkey", "place", "first", "last"])])):
        grams[k].append({"place": place, "first": first, "last": last})
    blocks = listed(suffix_dedup._blocks([pa.RecordBatch.from_pylist([r | {"grams": grams[r["tkey"]]} for r in keyed])]))
    ranges = listed(suffix_dedup._matched([table(blocks, ["core", "whole", "tkey", "at", "left", "right"])]))
    got = set(listed(suffix_dedup._merged([table([r[1:] for r in ranges], ["tkey", "start", "end"])])))
    count = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    want = set()
    for k, t in enumerate(texts):
        mark = bytearray(len(t))
        for p in range(len(t) - 399):
            if count[t[p : p + 400]] > 1:
                mark[p : p + 400] = b"\1" * 400
        want |= {(k, *m.span()) for m in re.finditer(b"\1+", bytes(mark))}
    assert got == want and len(want) >= 30


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


# --- 5 ---


@pytest.mark.parametrize("size, clustered", [(200_000, 8192), (30, 8192), (200_000, 12), (20, 8)])
def test_class_model(docs, corpus, size, clustered, monkeypatch):
    monkeypatch.setattr(class_model, "DICTIONARY", size)
    monkeypatch.setattr(class_model, "CLUSTERED", clustered)
    from docloom.llm.common import fold as column

    model, counts = class_model.learn(docs.where(column() % 10 != 0))
    got = class_model.score_texts(docs, model, counts).collect()
    train = [t for i, t, *_ in corpus if fold(i, 10)]
    c = Counter(w for t in train for w in words(t))
    total, kinds = sum(c.values()) + len(train), len(c) + 1
    assert model.tokens == total and len(got) == len(corpus)
    # the model's score from its definition: classes of all words, class bigrams, emissions
    name = lambda w: int(hashing.word_hashes(w)[0].view(np.int64))
    cls = {r["h"]: r["cls"] for r in counts.where("cls is not null").collect()}
    for h, k in zip(model.dictionary_hashes().tolist(), model.cls.tolist()):
        cls[h] = k
    often = {w for w in c if c[w] > 1}
    assert {name(w) for w in often} == set(cls)
    of = lambda w: cls.get(name(w), model.rest)
    sizes = Counter()
    for w in often:
        sizes[of(w)] += c[w]
    once = len(c) - len(often)
    emit = lambda w: c[w] / sizes[of(w)] if w in often else (c[w] + 0.1) / (once + 0.1 * (once + 1))
    assert math.isclose(sum(emit(w) for w in c) + (0.1 / (once + 0.1 * (once + 1))), len({of(w) for w in often}) + 1, rel_tol=1e-9)

    def score(t):
        path = [model.end, *map(of, words(t)), model.end]
        return sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(math.log10(emit(w)) for w in words(t))

    known = defaultdict(list)
    for i, t, *_ in corpus:
        known[i].append((len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + 1, sum(math.log10((n + 0.1) / (total + 0.1 * (kinds + 1))) for n in [*(c[w] for w in words(t)), len(train)]), score(t)))
    for r in got:
        assert any((r["n_tokens"], r["n_known"]) == k[:2] and math.isclose(r["base_score"], k[2], rel_tol=1e-9) and math.isclose(r["score"], k[3], rel_tol=1e-9) for k in known[r["doc_id"]])
        assert math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"]), rel_tol=1e-9)
    assert np.allclose((10.0**model.step).sum(axis=1), 1.0)


def test_exchange_gains():
    """A gain is the likelihood with the word in a class less that without it, up to a constant; the exchange never lowers it."""
    rng = np.random.default_rng(0)
    n, movable, total = 40, 4, 6
    bigrams = rng.poisson(3.0, (n + 2, n + 2)).astype(float)
    of = np.append(rng.integers(0, movable, n), [4, 5])
    between = lambda of: np.array([[bigrams[np.ix_(of == i, of == j)].sum() for j in range(total)] for i in range(total)])
    for w in range(10):
        others = np.arange(n + 2) != w
        left = np.array([[bigrams[others & (of == k), w].sum() for k in range(total)]])
        right = np.array([[bigrams[w, others & (of == k)].sum() for k in range(total)]])
        without = np.array([[bigrams[np.ix_((of == i) & others, (of == j) & others)].sum() for j in range(total)] for i in range(total)])
        got = class_model.gains(left, right, bigrams[[w], [w]], without, movable)[0]
        want = np.array([class_model.likelihood(between(np.where(np.arange(n + 2) == w, k, of))) for k in range(movable)])
        assert np.allclose(got - got[0], want - want[0])


def test_best_classes_are_those_of_most_gain():
    rng = np.random.default_rng(1)
    total, other = 7, 5
    m = rng.poisson(40.0, (total, total)).astype(float)
    counts = rng.poisson(0.7, (30, 2, total)).astype(float)
    counts[3] = 0
    word, key = np.nonzero(counts.reshape(30, -1))
    m[:, other] += counts[:, 0].sum(axis=0)
    m[other] += counts[:, 1].sum(axis=0)
    got = class_model.best_classes(word, key, counts.reshape(30, -1)[word, key].astype(np.int64), 30, m)
    without = np.repeat(m[None], 30, axis=0)
    without[:, :, other] -= counts[:, 0]
    without[:, other, :] -= counts[:, 1]
    gain = class_model.gains(counts[:, 0], counts[:, 1], np.zeros(30), without, total - 2)
    assert np.allclose(gain[np.arange(30), got], gain.max(axis=1)) and len(set(got.tolist())) > 2


def test_clustering_separates_kinds_of_words(spark):
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(10)] for k in "abcd"]  # words of a kind follow words of the one before
    rows = [(i, " ".join(rng.choice(kinds[(j + i) % 4]) for j in range(60))) for i in range(120)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    names = np.array([hashing.word_hashes(w.encode())[0] for k in kinds for w in k])
    of, between, reached = class_model.cluster(class_model.bigram_counts(train, names, np.arange(41), 42), 40, 42, classes=4)
    assert [len(set(of[10 * k : 10 * k + 10].tolist())) for k in range(4)] == [1, 1, 1, 1] and len(set(of.tolist())) == 6
    assert reached == sorted(reached) and math.isclose(class_model.likelihood(between), reached[-1])
    # a word that was not clustered joins the class its contexts name
    joined = class_model.joined_classes(train, names[1:], of[1:40], between)
    assert [(r["h"], r["cls"]) for r in joined.collect()] == [(int(names[0].view(np.int64)), int(of[1]))]


def test_class_model_of_nothing(no_docs, docs):
    model, counts = class_model.learn(no_docs)
    out = class_model.score_texts(docs, model, counts).collect()
    assert all(r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 for r in out)


# --- 6 ---


def test_language(spark, no_docs):
    rng = random.Random(3)
    vocabulary = {"es": "casa perro que niño los señor está mañana".split(), "en": "house dog that child the mister this tomorrow".split(), "de": "haus hund dass kind der herr straße morgen".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[k], k=30)), k) for i, k in enumerate(rng.choices(list(vocabulary), k=300))]
    odd = [(900, None, "es"), (901, "", "en"), (902, "123 !!", "de"), (903, rows[0][1], None), (None, rows[1][1], "en")]
    data = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.identify(data, language.learn(language.training_rows(data))).collect()}
    held = [i for i, *_ in rows if fold(i, 5) == 0]
    assert sum(out[i]["lang_pred"] == rows[i][2] for i in held) >= 0.98 * len(held)
    assert [out[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and out[902]["score"] == 0.0
    assert language.reject_unidentified(data).count() == 302
    assert language.identify(data, language.learn(no_docs.selectExpr("lang as label", "text", "0D as draw"))).where("lang_pred <> 'und'").count() == 0


def test_language_bits_by_brute_force():
    """Code lengths from the definition of PPM with escape method C, byte by byte."""
    rng = random.Random(8)
    texts = {k: ["".join(rng.choices(a, k=rng.randint(1, 120))).encode() for _ in range(12)] for k, a in (("a", "abcé "), ("b", "bcdñ "), ("c", "x"))}
    counts = []
    for k in sorted(texts):
        key, n = np.unique(np.concatenate([language.windows(t) for t in texts[k]]), return_counts=True)
        counts.append((key, n.astype(float)))
    scorer = language.Scorer(language.Trees(sorted(texts), counts), np.unique(np.concatenate([k for k, _ in counts]))[:50])

    def bits(label, data):
        seen = defaultdict(Counter)
        for t in texts[label]:
            t = b"\0" * language.ORDER + t
            for i in range(language.ORDER, len(t)):
                for k in range(language.ORDER + 1):
                    seen[t[i - k : i]][t[i]] += 1
        total, data = 0.0, b"\0" * language.ORDER + data
        for i in range(language.ORDER, len(data)):
            for k in range(language.ORDER, -1, -1):
                c = seen.get(data[i - k : i])
                if c is None:
                    continue
                if c[data[i]]:
                    total -= math.log2(c[data[i]] / (c.total() + len(+c)))
                    break
                total -= math.log2(len(+c) / (c.total() + len(+c)))
            else:
                total += 8.0
        return total

    for data in (b"abcab", "é bñ".encode(), b"zzz", b"xxxx x", texts["b"][3]):
        assert np.allclose(scorer.bits(data), [bits(k, data) for k in sorted(texts)])


def test_language_learns_every_label_and_whole_texts(spark):
    rows = [(10 * i + k, f"{chr(0x4E00 + i)} " * 20, f"l{i:03d}") for i in range(230) for k in range(3)]
    rows += [(5000 + k, "a " * 12_000 + "ñandú " * 200, "late") for k in range(5)]
    trees, _ = language.learn(language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert set(trees.labels) == {lang for i, _, lang in rows if fold(i, 5)} and len(trees.labels) > 200
    assert int.from_bytes("ñan".encode(), "big") in trees.keys[language.ORDER]


# --- 7 ---


def brute_components(rows):
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k))) for k, ((i, *_), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("tile, tries", [(2048, (1, 8, 64, None)), (4, (1, 1, None))])
def test_jaccard_join(docs, corpus, tile, tries, monkeypatch):
    for name, value in (("TILE", tile), ("TRIES", tries), ("HEADS", min(64, tile))):
        monkeypatch.setattr(jaccard_join, name, value)
    out = jaccard_join.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(corpus)


@pytest.mark.parametrize("tile", [2048, 50])
def test_jaccard_join_of_a_large_group_of_near_copies(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "HEADS", 8)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(70)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i - 700][1]) for i in range(700, 720)]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want and len({c for *_, c in want}) > 3


def test_jaccard_join_random_chains(spark):
    rng = random.Random(9)
    rows, serial = [], 0
    for _ in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(6, 60))]
        for _ in range(rng.randint(1, 12)):  # chains of small edits drift apart
            rows.append((serial, " ".join(w)))
            serial += 1
            w = list(w)
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    rng.shuffle(rows)
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows)


@pytest.mark.parametrize("light", [0, 10, 1000])
def test_linked_sets_share_a_key(light):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(2, 40))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: max(1, int(len(x) * rng.uniform(0.7, 1)))], rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both) and not np.array_equal(x, y):
            none = np.zeros(0, np.uint64)
            (a, small), (b, _) = (jaccard_join.keys_of(s, none, none.astype(int), light) for s in sorted((x, y), key=len))
            assert len(np.intersect1d(a[small], b))
            assert jaccard_join.difference_bound(jaccard_join.signature(x), jaccard_join.signature(y)) <= len(x) + len(y) - 2 * both


def test_jaccard_join_of_nothing(no_docs):
    assert jaccard_join.near_duplicates(no_docs).collect() == []


def test_keep_one(docs, corpus):
    kept = jaccard_join.keep_one(docs)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    want = {i for (i, n, c) in brute_components(corpus) if n == 0 or i == c}
    assert ids == want and kept.columns == docs.columns


def test_keep_one_with_null_and_repeated_ids(spark):
    near = " ".join(f"w{k}" for k in range(40))
    alone = " ".join(f"x{k}" for k in range(40))
    nulls = " ".join(f"y{k}" for k in range(40))
    rows = [(1, near), (None, near + " z"), (None, alone), (7, near + " q"), (7, "an unrelated clean text of some words"), (3, alone + " unlike"), (3, alone + " unlike"), (None, nulls), (None, nulls + " z"), (None, nulls), (None, ""), (None, None), (9, ""), (9, "")]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row long")
    kept = jaccard_join.keep_one(frame)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == frame.columns
    # a null id is never the least one while another row of the group has an id
    left = Counter(got)
    assert left[1, near] == 1 and left[7, rows[4][1]] == 1 and left[3, alone + " unlike"] == 1
    assert left[None, near + " z"] == left[7, near + " q"] == left[None, alone] == 0
    assert left[None, nulls] + left[None, nulls + " z"] == 1
    assert left[None, ""] == left[None, None] == 1 and left[9, ""] == 2 and len(got) == 8
    clean = spark.createDataFrame([(1, near), (None, near + " z"), (None, nulls)], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(clean).collect()} == {(1, near), (None, nulls)}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = list(range(200))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for a, b in edges if a != b for k in (a, b)}


def test_shingle_sets(corpus):
    texts = [t for _, t, *_ in corpus]
    for t, s in zip(texts, hashing.shingle_sets(texts)):
        w = words(t)
        assert len(s) == (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0)
        assert np.array_equal(s, hashing.shingle_set(t))
    assert len(hashing.shingle_set("a" * (1 << 20) + "b c d e f g")) == 2


# --- 8 ---


def test_packing(docs, corpus):
    out = packing.pack_documents(docs, (64, 128, 256)).collect()
    sizes = Counter()
    bins = defaultdict(list)
    for r in out:
        sizes[r["doc_id"]] += r["length"]
        bins[r["bin_id"]].append(r)
    want = Counter()
    for i, t, *_ in corpus:
        want[i] += len(words(t)) + 1
    assert sizes == want
    for rows in bins.values():
        rows.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        assert sum(r["length"] for r in rows) == rows[0]["bin_used"] <= rows[0]["bin_capacity"] == packing.downsized(rows[0]["bin_used"], (64, 128, 256))


def naive_pack(lengths, capacities, size_of):
    """Best fit with plain lists; size_of(piece, pieces to come): the size of a new bin."""
    bins = []
    for k, n in enumerate(lengths):
        fits = [b for b in bins if b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[1], -b[2]))  # of equal ones the last to change
        else:
            b = [0, size_of(n, lengths[k + 1 :]), 0]
            bins.append(b)
        b[0] += n
        b[1] -= n
        b[2] = k
    return [b[0] for b in bins]


def price(used, capacities=packing.CAPACITIES):
    return sum(packing.cost(packing.downsized(x, capacities)) for x in used)


@pytest.mark.parametrize("shape", ["even", "short", "two sizes", "skewed"])
def test_packing_opens_the_size_of_least_cost(shape):
    rng = random.Random(shape)
    draw = {"even": lambda: rng.randint(1, 4096), "short": lambda: rng.randint(1, 600), "two sizes": lambda: rng.choice([300, 700, 1300]) + rng.randint(0, 30), "skewed": lambda: min(4096, int(rng.lognormvariate(5.5, 1.0)) + 1)}[shape]
    lengths = sorted((draw() for _ in range(300)), reverse=True)

    def least(n, coming):
        def share(c):
            room = c - n
            for x in coming:  # the longest that fits first
                if x <= room:
                    room -= x
            return packing.cost(c) / (c - room)

        return min((c for c in packing.CAPACITIES if c >= n), key=share)

    of, used = packing.pack(lengths)
    assert len(of) == 300 and sorted(used) == sorted(naive_pack(lengths, packing.CAPACITIES, least))
    # one usual size for all bins is hardly ever better
    assert price(used) <= 1.01 * min(price(naive_pack(lengths, packing.CAPACITIES, lambda n, _, c=c: max(c, packing.downsized(n)))) for c in (0, *packing.CAPACITIES))


def test_packing_does_not_depend_on_settings(spark, docs):
    rows = lambda: Counter(tuple(r) for r in packing.pack_documents(docs).collect())
    first = rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- 9 ---


def test_transport_round_trip(docs, corpus):
    out = transport.read_streams(transport.write_streams(docs)).collect()
    want = Counter((i, hashlib.sha256(transport.pad((t or "").encode())).hexdigest()) for i, t, *_ in corpus)
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in out) == want
    assert all(r["continuity_errors"] == 0 and len(r["media"]) == 188 * r["packets"] and r["timestamps"] == sorted(r["timestamps"]) for r in out)


def test_transport_sees_damage():
    media = transport.multiplex(transport.pad(b"x" * 5000))
    assert transport.demultiplex(media)["payload"] == transport.pad(b"x" * 5000)
    cut = media[: 188 * 5] + media[188 * 6 :]
    with pytest.raises(ValueError):
        transport.demultiplex(cut)
    with pytest.raises(ValueError):
        transport.demultiplex(media[:-1])


def test_transport_reads_what_others_write():
    """Tables over several packets, repeated packets, announced jumps; broken streams raise ValueError."""
    payload = transport.pad(b"y" * 9000)
    media = transport.multiplex(payload)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    body = bytes([0xE1, 0x01, 0xF0, 0]) + bytes([6]) + (0xE000 | transport.DATA_PID).to_bytes(2, "big") + (0xF000 | 202).to_bytes(2, "big") + bytes([200, 200]) + bytes(200)
    section = transport._section(2, 1, body)
    long = [(bytes([0x47, 0x41, 0, 0x10, 0]) + section)[:188], (bytes([0x47, 0x01, 0, 0x11]) + section[183:]).ljust(188, b"\xff")]
    read = transport.demultiplex(b"".join([packets[0], *long, *packets[2:]]))
    assert read["payload"] == payload and read["continuity_errors"] == 0
    twice = transport.demultiplex(b"".join([*packets[:4], packets[3], *packets[4:]]))
    assert twice["payload"] == payload and twice["continuity_errors"] == 0
    last = packets[-1]
    for broken in (packets[1:], packets[:1] + packets[2:], packets[:2], [*packets, last[:1] + bytes([last[1] | 0x40]) + last[2:3] + bytes([0x30 | (last[3] + 1) & 15, 180, 0]) + bytes([0xFF] * 179) + b"abc"]):
        with pytest.raises(ValueError):
            transport.demultiplex(b"".join(broken))


# --- 10 ---


def test_url_filter(spark):
    rows = [(1, "HTTP://Sub.Example.ORG/es/9?x", "<p>a</p>"), (2, "http://example.org/en/12", ""), (3, "http://a.com/fr/x#y", None), (4, "x://b.com/de/", ""), (5, "http://notexample.orgx/es/", ""), (6, None, ""), (7, "nothing", ""), (8, "http://cheappills.net/fr/win", "<script>cheappills</script><p class='cheappills'>cheap pills &amp; net</p>"), (9, "http://example.org", "")]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[k]["rule"] for k in range(1, 10)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None]
    assert [out[k]["verdict"] for k in range(1, 5)] == ["block", "block", "allow", "block"]
    assert (out[1]["host"], out[1]["path"], out[6]["host"], out[7]["path"], out[9]["path"]) == ("sub.example.org", "/es/9", "", "", "")
    assert out[8]["host_words"] == "cheap pills net" and {r["verdict"] for r in out.values()} == {"allow", "block"}


def test_url_filter_knows_all_words_and_tokens(spark):
    # more words and path tokens than 10,000 and 50,000; the words of the last host are the rarest
    letters = lambda k: "".join("abcdefghij"[int(x)] for x in f"{k:05d}")
    rows = [(k, f"http://site{letters(k)}.org/" + "/".join(f"s{i}" for i in range(25 * k, 25 * k + 25)), " ".join([letters(k)] * 3)) for k in range(11_000)]
    rows += [(20_000 + k, f"http://casino.com/de/r{k // 2}", "casino") for k in range(4)] + [(30_000, "http://zupomkralo.net/r0", "zupom kralo"), (30_001, None, None)]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows) and out[30_000]["host_words"] == "zupom kralo net"
    found = {i: [("h:" + w) for w in r["host_words"].split()] + ["p:" + t for t in re.findall("[a-z0-9]+", r["path"])] for i, r in out.items()}
    sums = {k: Counter() for k in ("allow", "block")}
    pages = Counter()
    for i, f in found.items():
        label = next((said for word, said in (("h:org", "allow"), ("h:com", "block")) if word in f), None)
        if label is None:
            continue
        sums[label].update(f)
        pages[label] += 1
    kinds = len(set(sums["allow"]) | set(sums["block"]))
    assert kinds > 250_000 and pages["block"] == 4
    log = lambda k, t: math.log((sums[k][t] + 1) / (sums[k].total() + kinds + 1))
    for i in (0, 10_999, 20_000, 20_003, 30_000, 30_001):
        z = math.log((pages["block"] + 1) / (pages["allow"] + 1)) + sum(log("block", t) - log("allow", t) for t in found[i] if sums["block"][t] + sums["allow"][t])
        assert math.isclose(out[i]["block_score"], 1 / (1 + math.exp(-min(max(z, -500), 500))), rel_tol=1e-9)


def test_url_filter_of_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_segmenter():
    s = url_filter.Segmenter({"cheap": 5, "pills": 5, "che": 1, "ap": 1})
    assert s.host_words("cheappills-2.x") == ["cheap", "pills", "x"]
    assert re.sub(" ", "", " ".join(s.host_words("unknownname"))) == "unknownname"
