import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import consensus, extraction, geometry, linkage, records, validation, views


def test_vote_weights_ties_and_spelling(spark):
    rows = [("d", "OCR", 2, "ANA PÉREZ", 1), ("d", "DIGITAL_LINEAL", 0, "Ana Perez", 3), ("d", "DIGITAL_POSICIONAL", 1, "Otra", 3), ("e", "X", 0, "", 0), ("f", "OCR_TEXTO", 1, "b", 1), ("f", "OCR_TEXTO", 0, "a", 1)]
    out = {r["k"]: r for r in consensus.vote(spark.createDataFrame(rows, "k string, engine string, engine_idx int, value string, quality int"), ["k"]).collect()}
    assert out["d"]["value"] == "Ana Perez" and out["d"]["votes"] == 2 and out["d"]["engines"] == "DIGITAL_LINEAL,OCR"
    assert out["f"]["value"] == "a"  # equal points: the first engine
    assert "e" not in out


def test_engine_weight(spark):
    names = ["manual", "OCR", "OCR_TEXTO", "otro", None, "OCR_ESTRUCTURADO"]
    got = [r["w"] for r in spark.createDataFrame([(n,) for n in names], "e string").select(consensus.engine_weight("e").alias("w")).collect()]
    assert got == [12, 4, 4, 2, 2, 5]


def test_list_union_keeps_first_spelling(spark):
    rows = [("d", 2, "LEER"), ("d", 1, "Leer."), ("d", 3, ""), ("d", 4, "ver")]
    out = consensus.list_union(spark.createDataFrame(rows, "k string, ord int, value string"), ["k"]).orderBy("pos").collect()
    assert [r["value"] for r in out] == ["Leer.", "ver"]


def _row(order, name, filled=5):
    return {"order": order, "key": name, "name": name, "hours": 1 if filled > 1 else 0, "start": "a" * (filled > 2), "end": "a" * (filled > 3), "kind": "a" * (filled > 4)}


def test_align_rows():
    a = ("A", 6, [_row(1, "curso redes datos"), _row(2, "taller web")])
    b = ("B", 4, [_row(1, "taller web"), _row(2, "cosa distinta nueva"), _row(3, "tercera fila nueva")])
    # the fuller set leads; a complete row left over follows
    assert consensus.align_rows([a, b]) == [[(1, 0), (0, 1)], [(1, 1)], [(1, 2)], [(0, 0)]]
    assert consensus.align_rows([("A", 6, [])]) == []
    assert consensus.align_rows([("A", 6, [_row(1, "x y z")]), ("B", 6, [_row(2, "nada que ver", 3)])]) == [[(0, 0)]]


def test_match_training_equals_full_comparison(spark):
    random.seed(5)
    words = ["ana", "luis", "perez", "mora", "rios", "vega", "leon", "paz"]
    name = lambda: " ".join(random.sample(words, random.randint(2, 4)))
    records_ = [(i, name(), name(), random.choice(["2025-01", "2024-01", ""])) for i in range(60)]
    options = [(f"o{i}", i, name(), name(), random.choice(["2025-01", ""])) for i in range(40)]
    got = linkage.match_training(spark.createDataFrame(records_, "record_id int, teacher string, training string, period string"), spark.createDataFrame(options, "option_id string, ordinal int, teacher string, training string, period string"))
    overlap = lambda a, b: len({*a.split()} & {*b.split()}) / max(len({*a.split()}), len({*b.split()}))
    want = {}
    for i, t, c, p in records_:
        best = max(((round(0.55 * overlap(t, ot) + 0.4 * overlap(c, oc) + 0.05 * (p == op != ""), 6), -k, overlap(t, ot), overlap(c, oc)) for _, k, ot, oc, op in options))
        if best[2] >= 0.65 and best[3] >= 0.5 and best[0] >= 0.62:
            want[i] = f"o{-best[1]}"
    assert {r["record_id"]: r["option_id"] for r in got.collect()} == want


def test_canonical_match(spark):
    rows = spark.createDataFrame([("drecho",), ("INGENIERIA EN SISTEMA",), ("",)], "name string")
    out = {r["name"]: r["canonical"] for r in linkage.canonical_match(rows, ["Derecho", "Ingeniería en Sistemas"]).collect()}
    assert out == {"drecho": "drecho", "INGENIERIA EN SISTEMA": "Ingeniería en Sistemas", "": ""}


def test_first_issue_of_a_path_wins(spark):
    rules = [validation.Rule("a", F.lit(True), "missing"), validation.Rule("a", F.lit(True), "invalid"), validation.warning("a", F.lit(True), "x", "y"), validation.Rule("b", F.lit(False))]
    out = spark.range(1).select(validation.issues(rules).alias("i")).first()["i"]
    assert [(x["path"], x["kind"]) for x in out] == [("a", "missing"), ("a", "warning")]


def test_agreements(spark):
    schema = "id int, code string, signed_on string, id_number string, name string, career string, training string, plan_id string, position string, linked boolean, support array<string>, percent double"
    good = ("c", "2024-01-01", "01", "n", "c", "t", "p", "x", True)
    rows = [(1, *good, ["permiso"], None), (2, *good, ["parcial", "total"], 150.0), (3, *good[:-1], False, None, None)]
    out = {r["id"]: r for r in validation.evaluated_agreements(spark.createDataFrame(rows, schema)).collect()}
    assert out[1]["status"] == "COMPLETO" and out[1]["confidence"] == 100
    assert [x["path"] for x in out[2]["issues"]] == ["patrocinio", "patrocinio.porcentaje_financiado"]
    assert out[3]["status"] == "REVISAR" and len(out[3]["issues"]) == 2


PAGE = """PLAN INDIVIDUAL DE CAPACITACIÓN DOCENTE
Código del documento: UGPA-RGI1-44-PRO-251-2025-12
Nombre del docente: ANA DE LA MORA
Carrera:
Derecho
Nivel académico actual: Magíster
4. Resumen de capacitación
1 Redes de datos 40 Desde marzo 2025 hasta mayo 2025 TALLER 2 Bases 20 horas Desde junio 2025 hasta julio 2025 CURSO
5. Indicadores
Actividades teóricas
• leer
• ver
Actividades prácticas
- hacer
7. Impacto esperado
mejora
8. Visión a largo plazo
lejos"""


def test_plan_fields(spark):
    r = extraction.plans(spark.createDataFrame([("d", PAGE, "x.pdf")], "doc_id string, text string, file_name string")).first()
    assert (r["code"], r["period"], r["template"], r["name"], r["career"], r["level"]) == ("UGPA-RGI1-44-PRO-251-2025-12", "2025-12", "MODERNA", "Ana de la Mora", "Derecho", "Magíster")
    assert [(t["ordinal"], t["name"], t["hours"], t["start"], t["end"], t["kind"]) for t in r["trainings"]] == [(1, "Redes de datos", 40, "marzo 2025", "mayo 2025", "TALLER"), (2, "Bases", 20, "junio 2025", "julio 2025", "CURSO")]
    assert (r["theory"], r["practice"], r["impact"], r["vision"]) == (["leer", "ver"], ["hacer"], "mejora", "lejos")


def test_agreement_fields(spark):
    page = "Acuerdo CGC-RGI2-159-PRO-134-2024-11 versión: 2.1\nNombre del docente: LUIS PAZ\nCédula: 0102030405\nCarrera: Derecho\nNombre de la capacitación: Redes.\nEn Quito, a los 3 días del mes de mayo de 2024\nfinanciamiento parcial 50,5 %\nFirmado electrónicamente"
    r = extraction.agreements(spark.createDataFrame([("d", page, "OCR", "x")], "doc_id string, text string, method string, file_name string")).first()
    assert (r["code"], r["signed_on"], r["version"], r["id_number"], r["name"], r["training"], r["state"], str(r["percent"]), r["position"]) == ("CGC-RGI2-159-PRO-134-2024-11", "2024-05-03", "2.1", "0102030405", "Luis Paz", "Redes", "FIRMADO", "50.50", "Docente")


def test_empty_page(spark):
    r = extraction.plans(spark.createDataFrame([("d", None, None)], "doc_id string, text string, file_name string")).first()
    assert r["code"] == "" and r["trainings"] == [] and r["template"] == "DESCONOCIDA"


def test_cluster_lines_and_anchors():
    assert geometry.cluster_lines([10, 12, 30, 31, 11], [5] * 5) == [0, 0, 1, 1, 0]
    assert geometry.cluster_lines([], []) == []
    assert geometry.pick_anchors([(100, 80), (110, 90), (125, 50), (300, 10)]) == [1, 3]


def test_row_bands(spark):
    a = spark.createDataFrame([("d", 1, 1, 100.0), ("d", 1, 2, 200.0), ("e", 1, 1, 50.0)], "doc_id string, page int, number int, center_y double")
    out = {(r["doc_id"], r["number"]): (r["band_top"], r["band_bottom"]) for r in geometry.row_bands(a).collect()}
    assert out == {("d", 1): (50.0, 150.0), ("d", 2): (150.0, 250.0), ("e", 1): (5.0, 110.0)}


def test_split_runs(spark):
    runs = spark.createDataFrame([("d", 1, 0, "ab cde", 10.0, 5.0, 60.0, 2.0)], "doc_id string, page int, run int, text string, left double, top double, width double, height double")
    out = [(r["text"], r["left"], r["width"], r["height"]) for r in geometry.split_runs(runs).orderBy("pos").collect()]
    assert out == [("ab", 10.0, 20.0, 5.0), ("cde", 40.0, 30.0, 5.0)]


def test_fold_is_ordered_and_exact_first():
    base = {"hash": "", "code": "", "valid": False, "period": "2025-12", "name": "ana perez mora", "career": "derecho", "trainings": ["curso de redes"], "alias": False}
    a, b = dict(base), dict(base, name="ana perez moro")
    c = dict(base, name="otra persona", hash="h")
    d = dict(base, name="nadie", hash="h")
    assert records.fold([a, b, c, d]) == [0, 0, 1, 1]
    x, y = dict(base, code="UGPA-RGI1-44-PRO-251-2025-12", valid=True), dict(base, code="UGPA-RGI1-45-PRO-251-2025-12", valid=True)
    assert records.fold([x, y]) == [0, 1]  # different valid codes never match
    assert records.fold([]) == []


def test_blocked_pairs_lose_nothing(spark):
    random.seed(3)
    names = []
    for i in range(80):
        name = "".join(random.choice("abcd ") for _ in range(random.randint(8, 24))).strip() or "x"
        names.append(name)
        copy = list(name)
        copy[random.randrange(len(copy))] = "z"
        names.append("".join(copy))
    rows = [(i, i, "", "", n) for i, n in enumerate(names)]
    got = {(r["a"], r["b"]) for r in records.blocked(spark.createDataFrame(rows, "id int, seq int, hash string, code string, name string")).collect()}
    key = [" ".join(n.split()) for n in names]
    want = {(i, j) for i in range(len(key)) for j in range(i + 1, len(key)) if records.edit_ratio(key[i], key[j]) >= 0.86}
    assert got == want


def test_upsert_is_idempotent(spark):
    schema = "id string, seq int, hash string, code string, manual boolean, name string"
    store = spark.createDataFrame([("s1", 1, "h1", "c1", False, "a"), ("s2", 2, "h2", "c2", True, "b")], schema)
    batch = spark.createDataFrame([("b1", 1, "h1", "", False, "x"), ("b2", 2, "", "c2", False, "y"), ("b3", 3, "h9", "", False, "z")], schema)
    once = records.two_key_upsert(store, batch, ["name"])
    rows = {(r["id"], r["hash"], r["name"], r["manual"]) for r in once.collect()}
    assert rows == {("b1", "h1", "x", False), ("s2", "", "b", True), ("b3", "h9", "z", False)}


def test_views(spark):
    rows = spark.createDataFrame([(1, "Ana", "COMPLETO", [1, 2]), (2, "Luz", "NO_ES_PLAN", []), (3, None, "REVISAR", None)], "id int, name string, status string, items array<int>")
    s = views.review_tile(views.summary(rows, "items")).first()
    assert (s["total"], s["complete"], s["review"], s["failed"], s["items"], s["review_tile"]) == (3, 1, 1, 1, 2, 2)
    assert [r["id"] for r in views.search(rows, "LUZ", ["name"], "ERROR").collect()] == [2]
    assert [r["id"] for r in views.search(rows, "", ["name"]).orderBy("id").collect()] == [1, 2, 3]
