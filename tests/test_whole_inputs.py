"""Queries that must read whole texts and all rows, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from docloom import catalogue
from docloom.functions.quality import FOREIGN_HEADING, FOREIGN_PHRASES
from docloom.operators import records
from docloom.operators.consensus import ENGINE_WEIGHTS as WEIGHTS
from docloom.operators.consensus import align_rows
from docloom.operators.records import edit_ratio
from docloom.plans.record_queries import ENGINES

FOLDER = "/root/testdata/sf0.001"


def test_quality_of_whole_texts(spark, tmp_path):
    filler = "palabra " * 150  # longer than 900 characters
    tails = ["", "total de horas", "5 indicadores", "UGPA-RGI1-44", "�", "formacion docente y mas"]
    rows = [(10 * k + r, filler * (k % 2) + tail) for k, tail in enumerate(tails * 2) for r in range(10)] + [(1003, ""), (1004, None), (1005, "corto")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    quality, mixed = {}, {}
    for i, text in rows:
        t = None if text is None else {0: text + " Total de horas 40", 1: "5. Indicadores " + text, 2: "UGPA-RGI1-44 " + text}.get(i % 10, text)
        c = re.sub(r"[ \t]+", " ", (t or "").replace("�", "-")).strip()
        key = " " + re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip() + " "
        foreign = any(f" {p} " in key for p in FOREIGN_PHRASES) or bool(re.search(f" {FOREIGN_HEADING} ", key))
        score = min(24, -(-len(c) // 10)) - 80 * foreign - 35 * bool(re.search(r"\bUGPA-RGI[12]\b", c)) - 20 * ("�" in (t or ""))
        quality[i] = score if c else -1000, min(20, -(-len(c) // 8))
        mixed[i] = bool(c) and (len(c) > 700 or foreign)
    got = catalogue.queries()["text_quality"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["quality"], r["value_score"]) for r in got} == quality
    got = catalogue.queries()["mixed_content"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["mixed"] for r in got} == mixed


def test_row_alignment_reads_every_line(spark):
    name = {r["p_partkey"]: f"{r['p_name']} {r['p_type']} {r['p_brand'].replace('#', ' ')}".lower() for r in pq.read_table(f"{FOLDER}/part.parquet").to_pylist()}
    orders = defaultdict(list)
    for r in pq.read_table(f"{FOLDER}/lineitem.parquet").to_pylist():
        if r["l_partkey"] in name:
            orders[r["l_orderkey"]].append((r["l_linenumber"], r["l_partkey"]))
    want = Counter()
    for order, lines in orders.items():
        engines = [(engine, WEIGHTS.get(engine, WEIGHTS["OCR"]), []) for engine in ENGINES]
        for k, (engine, _, rows) in enumerate(engines):
            for place, (_, part) in enumerate(sorted(lines), 1):
                if k != 2 or part % 4:
                    read = name[part].replace("widget", "w1dget") if k == 1 and part % 3 == 0 else name[part]
                    rows.append({"order": place, "key": read, "name": read, "hours": part % 90, "start": "2025", "end": "2026", "kind": "curso"})
        engines = [e for e in engines if e[2]]
        want.update((order, engines[k][0], engines[k][2][j]["order"], slot, engines[k][2][j]["name"]) for slot, group in enumerate(align_rows(engines)) for k, j in group)
    got = Counter(tuple(r) for r in catalogue.queries()["row_alignment"](spark, FOLDER).collect())
    assert got == want and sum(e == "TABLA_TEXTUAL" for _, e, *_ in got.elements()) == sum(map(len, orders.values()))


def test_edit_similarity_of_all_pairs_of_a_nation(spark):
    plain = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    s, c = (pq.read_table(f"{FOLDER}/{t}.parquet").to_pylist() for t in ("supplier", "customer"))
    want = {(x["s_suppkey"], y["c_custkey"]): round(edit_ratio(plain(x["s_name"]), plain(f"{y['c_name']} {y['c_mktsegment']}")), 6) for x in s for y in c if x["s_nationkey"] == y["c_nationkey"]}
    got = catalogue.queries()["edit_similarity"](spark, FOLDER).collect()
    assert {(r["s_suppkey"], r["c_custkey"]): r["ratio"] for r in got} == want and len(got) == len(want)


def naive_fold(rows):
    """The fold with a pass over all outputs for each record."""
    out, of = [], []
    for r in rows:
        exact = [k for k, o in enumerate(out) if records.exact_match(o, r)]
        scores = [] if exact else [records.duplicate_score(o, r) for o in out]
        best = exact[0] if exact else max(range(len(out)), key=lambda k: (scores[k], -k), default=None)
        if best is None or not exact and scores[best] < records.DUPLICATE:
            best = len(out)
            out.append(dict(r))
        else:
            o = out[best]
            if not o["valid"] and r["valid"]:
                o["code"], o["valid"] = r["code"], True
            for f in ("period", "name", "career", "hash", "trainings"):
                o[f] = o[f] or r[f]
            o["alias"] = o["alias"] and r["alias"]
        of.append(best)
    return of


def kept(ids, of):
    first = {}
    return {i: first.setdefault(k, i) for i, k in zip(ids, of)}


def test_fold_over_all_records(spark):
    rng = random.Random(11)
    base = ["ana maria perez mora", "luis alberto vega rios", "carmen lucia leon paz"]
    rows = []
    for i in range(60):
        name = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 6])):
            name[rng.randrange(len(name))] = rng.choice("abcxyz")
        code = rng.choice(["", "", "", "raro PRO-251", *(f"UGPA-RGI1-{n}-PRO-251-2025-12" for n in (44, 45))])
        rows.append({"id": i, "seq": i, "hash": rng.choice(["", "", "h1", "h2"]), "code": code, "period": "2025-12", "name": rng.choice(["", *["".join(name)] * 6]), "career": "derecho", "trainings": ["curso de redes"], "alias": False})
    plain = [r | {"valid": r["code"].startswith("UGPA"), "name": " ".join(r["name"].split())} for r in rows]
    want = naive_fold(plain)
    assert records.fold(plain) == want
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, seq long, hash string, code string, period string, name string, career string, trainings array<string>, alias boolean")
    assert {r["id"]: r["kept_id"] for r in records.consolidated_all(frame).collect()} == kept(range(60), want)


def test_dedup_fold_compares_all_suppliers(spark, tmp_path):
    keys = [0, 1, 2, 999, 1000, 1998, 5000]
    spark.createDataFrame([(k, k % 7) for k in keys], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    rows = [{"hash": "", "code": f"UGPA-RGI1-{k % 999 + 1:03d}-PRO-251-2025-12" if c == 2 else "", "valid": c == 2, "period": "2025-12", "name": "docente " + hashlib.md5(str(k).encode()).hexdigest() + ("a" if c == 1 else ""), "career": "derecho", "trainings": ["curso de redes"], "alias": False} for k in keys for c in range(3)]
    ids = [3 * k + c for k in keys for c in range(3)]
    got = {r["id"]: r["kept_id"] for r in catalogue.queries()["dedup_fold"](spark, str(tmp_path)).collect()}
    assert got == kept(ids, naive_fold(rows)) and got[3 * 999 + 2] == 0
