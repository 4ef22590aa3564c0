"""Second readings, audit, corrections by path, incremental consolidation, substring index, migration, look-ahead, roll-ups."""

import json
import random

import pytest
from test_processing import FORM, PLAN, plan

from docloom.operators import changes, corrections, extraction, incremental, merging, migration, processing, records, search_index, suggestions, validation, views
from docloom.streaming import readings

CODE = "UGPA-RGI1-44-PRO-251-2025-12"
READING = "doc_id long, engine string, seq int, text string, file_name string, region_text string"


def people(n, seed, first=0):
    """Records of a few people under many spellings, files and codes."""
    rng, out = random.Random(seed), []
    names = ["Luz Mora Rios", "Ana Paz Vera Solis", "Juan Andrade Mena", "Maria del Carmen Ortiz", "Li", "Jose"]
    for i in range(first, first + n):
        name = list(rng.choice(names))
        if rng.random() < 0.4:
            name[rng.randrange(len(name))] = rng.choice("aeioubcd")
        out.append(plan(f"r{i:04d}", i, name="".join(name), career=rng.choice(["Derecho", "Derecho", "Medicina", ""]), hash=rng.choice(["", "", f"h{rng.randrange(12)}"]), code=rng.choice(["", "", f"UGPA-RGI1-{rng.randrange(1, 9):02d}-PRO-251-2025-12", "x"]),
                        period=rng.choice(["", "2025-12"]), trainings=rng.choice([[], [("Redes", 40.0, "enero de 2025", "", "Taller")], [("Salud", 0.0, "", "", "")]]), file_name=rng.choice([f"f{i}.pdf", "UGABCD.PDF"])))
    return out


def shown(frame):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in frame.collect()))


def test_banded_edit_ratio():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice([x, x, x, "", "b"]) for x in a) if rng.random() < 0.7 else "".join(rng.choice("ab c") for _ in range(rng.randint(0, 12)))
        plain = records.edit_ratio(a, b)
        table = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert plain == pytest.approx(0.0 if not a or not b else 1 - table[-1][-1] / max(len(a), len(b)))
        for least in (0.5, 0.86, 0.96):
            assert records.edit_ratio(a, b, least) == pytest.approx(plain if plain >= least - 1e-9 else 0.0)


def test_incremental_consolidation_equals_one_fold(spark):
    rows = people(60, 3)
    state, cut = None, [0, 25, 26, 45, 60]
    for a, b in zip(cut, cut[1:]):
        batch = spark.createDataFrame(rows[a:b], PLAN)
        if state is None:
            state = incremental.started(batch)
        else:
            state, actions = incremental.upserted(state, batch)
            assert actions.count() >= 1
        assert shown(state.merged.drop("comp")) == shown(merging.merged_plans(spark.createDataFrame(rows[:b], PLAN)))
    again, actions = incremental.upserted(state, spark.createDataFrame([], PLAN))
    assert shown(again.merged) == shown(state.merged) and actions.collect() == []
    empty = incremental.started(spark.createDataFrame([], PLAN))
    assert shown(incremental.upserted(empty, spark.createDataFrame(rows[:10], PLAN))[0].merged.drop("comp")) == shown(merging.merged_plans(spark.createDataFrame(rows[:10], PLAN)))


def test_untouched_components_are_not_folded_again(spark):
    """What a batch does not reach is carried over: rows that no fold would give stay."""
    state = incremental.started(spark.createDataFrame([plan("a", 0, name="Luz Mora Rios"), plan("b", 1, name="Otro Docente Lejano", trainings=[])], PLAN))
    state.merged = state.merged.withColumn("vision", extraction.F.lit("as it was"))
    after, actions = incremental.upserted(state, spark.createDataFrame([plan("c", 2, name="Luz Mora Rioz"), plan("d", 3, name="Zoe", career="x", trainings=[])], PLAN))
    out = {r["id"]: (r["n_records"], r["vision"]) for r in after.merged.collect()}
    assert out == {"a": (2, ""), "b": (1, "as it was"), "d": (1, "")}
    assert {r["comp"]: r["action"] for r in actions.collect()} == {"a": "updated", "d": "inserted"}
    plan_text = incremental.untouched(state, spark.createDataFrame([("a", "a")], "comp string, _new string"))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan_text and "Python" not in plan_text


def test_many_copies_of_one_file(spark):
    rows = [plan(f"c{i:05d}", i, hash="h", code=CODE, file_name=f"f{i}.pdf", name="Luz Mora Rios") for i in range(10_000)]
    out = merging.merged_plans(spark.createDataFrame(rows, PLAN).repartition(4)).collect()
    assert len(out) == 1 and out[0]["n_records"] == 10_000 and len(out[0]["files"]) == 1 and out[0]["merged_ids"][:2] == ["c00000", "c00001"]


def test_replaying_the_log_gives_the_output(spark):
    given = people(40, 5)
    given += [plan("x", 90, name="LUZ UGPA-RGI1-44", career="enfermeria", code="", file_name="UGPA RGI1 07 PRO 251 2024 11.pdf", diagnosis=("a", None, "c", "", "e", "f", "g")), plan("y", 91, manual=True, code=CODE, file_name="UGPA-RGI1-07-PRO-251-2024-11.pdf", name="Otra Persona Mas")]
    frame = spark.createDataFrame(given, PLAN)
    out, log = changes.audited_plans(frame)
    columns = [c for c in frame.columns if c in out.columns]
    assert shown(changes.replayed(frame, log).select(columns)) == shown(out.select(columns))
    rows = {(r["id"], r["step"], r["path"]): (r["before"], r["after"], r["reason"]) for r in log.collect()}
    assert rows["x", 1, "name"] == ("LUZ UGPA-RGI1-44", "LUZ", "name cleaned") and rows["x", 1, "career"][1] == "Enfermería"
    assert rows["x", 2, "code"] == ("", "UGPA-RGI1-07-PRO-251-2024-11", "code repaired by vote") and rows["x", 2, "period"][1] == "2024-11"
    assert ("y", 2, "code") not in rows  # corrected by hand, and valid
    gone = {i for i, _, p in rows if p == changes.MERGED}
    assert gone == {r["id"] for r in frame.collect()} - {r["id"] for r in out.collect()} and all(rows[i, 3, changes.MERGED][0] == i for i in gone)
    assert changes.audited_plans(frame.limit(0))[1].collect() == []


def test_corrections_by_path(spark):
    rows = [plan("a", 0, trainings=[("Redes", 40.0, "e", "f", "Taller"), ("Salud", 8.0, "", "", "")], theory=["leer"]), plan("b", 1, name="Otra Persona", trainings=[]), plan("c", 2, name="Tercera", trainings=None)]
    store = spark.createDataFrame([(*r, ["Requiere confirmación manual.", "otra"]) for r in rows], PLAN + ", remarks array<string>")
    edits = [
        ("a", 1, "capacitaciones.0.horas", "12,5"), ("a", 2, "capacitaciones.0.nombre", "viejo"), ("a", 3, "capacitaciones.0.nombre", " Redes nuevas "), ("a", 4, "capacitaciones.1", None), ("a", 5, "capacitaciones.7.nombre", "Añadida"), ("a", 6, "capacitaciones.7.horas", "-3"),
        ("a", 7, "diagnostico.tipo_formacion", "específica"), ("a", 8, "detalles_plan.actividades_teoricas", "ver | oír\nleer"), ("a", 9, "docente.codigo_documento", CODE), ("a", 10, "docente.nadie", "x"), ("a", 11, None, "x"),
        ("b", 1, "nada", "x"), ("c", 1, "capacitaciones.0.nombre", "Primera"), ("zz", 1, "docente.nombre", "x"), (None, 1, "docente.nombre", "x"),
    ]
    out = {r["id"]: r for r in corrections.corrected_by_path(store, spark.createDataFrame(edits, "id string, seq int, path string, value string"), 2026).collect()}
    a, b, c = out["a"], out["b"], out["c"]
    assert len(out) == 3 and [(t["name"], t["hours"], t["start"]) for t in a["trainings"]] == [("Redes nuevas", 12.5, "e"), ("Añadida", 0.0, "")]
    assert (a["diagnosis"]["tipo_formacion"], a["theory"], a["code"], a["period"], a["manual"], a["n_edits"], a["rejected"], a["remarks"]) == ("específica", ["ver", "oír", "leer"], CODE, "2025-12", True, 8, ["", "docente.nadie"], ["otra"])
    assert (b["n_edits"], b["rejected"], b["manual"], b["remarks"], b["trainings"]) == (0, ["nada"], False, ["Requiere confirmación manual.", "otra"], [])
    assert [t["name"] for t in c["trainings"]] == ["Primera"] and a["issues"] and a["status"] == "REVISAR"
    merged = merging.merged_plans(spark.createDataFrame([plan("a", 0, manual=True, code=CODE, name=a["name"]), plan("z", 5, code=CODE, name="un nombre mucho más largo que el corregido")], PLAN)).first()
    assert merged["name"] == a["name"]  # locked from then on
    assert corrections.corrected_by_path(store.limit(0), spark.createDataFrame([], "id string, seq int, path string, value string"), 2026).collect() == []


def test_second_readings(spark):
    bare = "PLAN INDIVIDUAL DE FORMACIÓN Y CAPACITACIÓN DOCENTE\nNombre del docente: Ana Paz\nCódigo del documento: ilegible\n" + "una línea más\n" * 5
    first = [(1, "DIGITAL_LINEAL", 0, FORM, "a.pdf", ""), (2, "DIGITAL_LINEAL", 0, bare, "b.pdf", ""), (3, "DIGITAL_LINEAL", 0, "corto", "c.pdf", ""), (4, "DIGITAL_LINEAL", 0, bare, "d.pdf", "")]
    second = [(i, "OCR_TEXTO", 10, FORM.replace("Luz", "Eva") if i > 1 else "x" * 100, "z.pdf", "") for i in (1, 2, 3)] + [(4, "OCR_TEXTO", 10, "corto", "d.pdf", "")]
    readings, again = spark.createDataFrame(first, READING), spark.createDataFrame(second, READING)
    plain = {r["doc_id"]: r for r in processing.processed_plans(readings, 2026).collect()}
    out = {r["doc_id"]: r for r in processing.twice_processed_plans(readings, again, 2026).collect()}
    assert set(plain) == {1, 2, 4} and set(out) == {1, 2, 3, 4}
    doubtful = {i for i, r in plain.items() if r["fallback"]} | {3}
    assert 2 in doubtful and {i for i, r in out.items() if r["reread"]} == doubtful - {4}
    assert out[2]["code"] == out[3]["code"] == "UGPA-RGI1-44-PRO-251-2025-12" and out[2]["engines"] == 2 and out[3]["engines"] == 1
    both = processing.processed_plans(readings.where("doc_id = 2").union(again.where("doc_id = 2")), 2026).first()
    assert {k: both[k] for k in both.asDict()} == {k: out[2][k] for k in both.asDict()}
    assert out[4].asDict() == {**plain[4].asDict(), "reread": False}
    regions = spark.createDataFrame([(2, CODE, "tabla", None, "", "fin"), (3, None, None, None, None, None)], "doc_id long, code_text string, table_text string, activities_text string, impact_text string, vision_text string")
    assert {(r["doc_id"], r["engine"], r["seq"], r["text"][:60]) for r in processing.structured_readings(again.where("doc_id in (2, 3)"), regions).collect()} == {(2, "OCR_ESTRUCTURADO", 11, f"{CODE}\n\ntabla\n\nfin"), (3, "OCR_ESTRUCTURADO", 11, second[2][3][:60])}


def test_stream_equals_a_batch_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice(["A", "B", None]), rng.randrange(50), rng.choice(["x", "y", None, "é"])) for _ in range(120)]
    schema = "doc_id long, engine string, at long, value string"
    latest, seen = {}, {}
    for i, e, at, v in rows:
        k, x = (i, e or ""), (at, v or "")
        latest[k] = max(latest.get(k, x), x)
        seen.setdefault(i, set()).add((e or "", *x))
    want = sorted(((i, e, *x, len(seen[i])) for (i, e), x in latest.items()), key=repr)
    for order in range(2):
        rng.shuffle(rows)
        folder = tmp_path / f"in{order}"
        for n in range(4):  # files come one after another, some of their readings twice
            spark.createDataFrame([*rows[n * 30 : n * 30 + 30], *rows[:5]], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        got = readings.kept(readings.documents(stream), "test-stream").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    empty = tmp_path / "none"
    empty.mkdir()
    assert readings.kept(readings.documents(spark.readStream.schema(schema).parquet(str(empty))), "test-empty").collect() == []


def test_substring_index_equals_a_scan(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abñ Á1") for _ in range(rng.randint(0, 30))), rng.choice([None, "Derecho", "Redes"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, name string, career string")
    texts = search_index.search_texts(frame, "id", ["name", "career"])
    lists, df = search_index.postings(texts, "id")
    needles = ["a", "ab", "Ñ", "ab1", "DERE", "recho", "nowhere", "zzzz", " redes ", "aba b", "", None, "ab", "e"] + [t[1][k : k + n] for t in rows[:40] for k, n in ((0, 5), (3, 8), (1, 2)) if len(t[1]) > k]
    found = search_index.search_all(texts, lists, df, spark.createDataFrame([(x,) for x in needles], "needle string"), "id")
    got = {(r["needle"], r["id"]) for r in found.collect()}
    hay = {i: f"{n} {c or ''}".lower() for i, n, c in rows}
    want = {(x, i) for x in {(x or "").strip().lower() for x in needles} - {""} for i, h in hay.items() if x in h}
    assert got == want and len(found.collect()) == len(want)


def test_migration_reaches_a_fixpoint(spark):
    rows = people(30, 9) + [plan("p", 100, name="Eva Luna UGPA-RGI1-44", career="enfermeria", code=CODE, diagnosis=tuple("abcdefg")), plan("q", 101, name="Nadie", career="", trainings=[])]
    store = spark.createDataFrame([(*r, ["No corresponde a un plan individual.", "otra"], "NO_ES_PLAN" if r[0] in "pq" else "REVISAR") for r in rows], PLAN + ", remarks array<string>, status string")
    now, log = migration.migrated_plans(store, 2026)
    found = {r["id"]: r for r in log.collect()}
    assert len(found) == len(rows) and {r["kept_id"] for r in found.values()} == {r["id"] for r in now.collect()}
    p, q = found["p"], found["q"]
    assert (p["action"], p["old"]["status"], p["new"]["status"] != "NO_ES_PLAN", p["new"]["name"], p["new"]["career"], p["new"]["period"], p["new"]["rescued"], p["new"]["remarks"]) == ("changed", "NO_ES_PLAN", True, "Eva Luna", "Enfermería", "2025-12", True, ["otra"])
    assert q["new"]["status"] == "NO_ES_PLAN" and not q["new"]["rescued"] and "merged" in {r["action"] for r in found.values()}
    again, log = migration.migrated_plans(now, 2026)
    assert {r["action"] for r in log.collect()} == {"same"} and shown(again) == shown(now)


LABELS = {"name": "nombre del docente", "career": "carrera", "goal": "objetivo"}


def read_labels(text, reach=4):
    """The look-ahead as a reader of lines would do it."""
    fold = lambda s: " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in s.lower().replace("í", "i").replace("ó", "o")).split())
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    stop = lambda x: any(fold(x).startswith(p) for p in [*LABELS.values(), "nivel"]) or (x[:1].isdigit() and x.lstrip("0123456789")[:2] in (". ", ") "))
    out = {}
    for name, label in LABELS.items():
        for i, line in enumerate(lines):
            if not fold(line).startswith(label) or name in out:
                continue
            cuts = [k for k, c in enumerate(line) if c in ":-–—"]
            own = (line[cuts[0] + 1 :].strip() if cuts else "") or " ".join(line.split()[len(label.split()) :])
            if fold(own) in LABELS.values():
                own = ""
            if not own:
                taken = []
                for x in lines[i + 1 : i + 1 + reach]:
                    if stop(x):
                        break
                    taken.append(x)
                    if name != "goal":
                        break
                own = " ".join(taken)
            if own:
                out[name] = own
    return out


def test_look_ahead_equals_a_reader_of_lines(spark):
    rng = random.Random(2)
    parts = ["Nombre del docente", "Nombre del docente:", "NOMBRE DEL DOCENTE: Luz", "Carrera", "carrera Derecho", "Carrera - x", "Objetivo", "objetivo:", "Nivel: x", "uno", "dos tres", "1. uno", "2) dos", "", "Objetivo: carrera"]
    docs = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(999, None)]
    got = {}
    for r in extraction.label_values(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", LABELS, ("nivel",), 4, ("goal",)).collect():
        got.setdefault(r["doc_id"], {})[r["label"]] = r["value"]
    assert got == {i: x for i, t in docs if (x := read_labels(t))}


def test_multi_level_figures(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "x", 1), (None, "x", 5)], "state string, career string, id int")
    F = extraction.F
    got = {(r["state"], r["career"], r["grouping_id"]): (r["n"], r["ids"]) for r in views.multi_level_figures(rows, ["state", "career"], {"n": F.count("*"), "ids": F.count_distinct("id")}).collect()}
    assert got == {("a", "x", 0): (1, 1), ("a", None, 0): (1, 1), ("b", "x", 0): (1, 1), (None, "x", 0): (1, 1), ("a", None, 1): (2, 2), ("b", None, 1): (1, 1), (None, None, 1): (1, 1), (None, None, 3): (4, 3)}
    by = views.multi_level_figures(rows, ["state", "career"], {"n": F.count("*")}, [("state",), ("career",)])
    assert sorted((r["grouping_id"], r["n"]) for r in by.collect()) == [(1, 1), (1, 1), (1, 2), (2, 1), (2, 3)]


def test_suggestions_fill_what_is_empty_or_wrong(spark):
    diagnosis = ["r"] * 7
    diagnosis[-1] = "Específica 3. Evaluaciones de capacitación"
    rows = [
        plan("a", 0, name="Persona confirmada", career="Derecho", code="UGPA-RGI1-04-PRO-251-2025-10", period="2025-10", diagnosis=tuple(diagnosis), trainings=[("Curso confirmado", 0.0, "", "", ""), ("Otro", 5.0, "x", "y", "z")]),
        plan("b", 1, trainings=[]), plan("c", 2, trainings=None), plan("d", 3),
    ]
    problems = [("docente.codigo_documento", "error"), ("diagnostico.tipo_formacion", "error"), ("capacitaciones.0.horas", "error"), ("capacitaciones.0.actividades_teoricas", "error"), ("docente.carrera", "warning")]
    issue = "issues array<struct<path:string,severity:string>>"
    records_ = spark.createDataFrame([(*r, problems if r[0] == "a" else []) for r in rows], f"{PLAN}, {issue}")
    offered = ("Nombre propuesto", 40.0, "octubre de 2025", "noviembre de 2025", "Aprobación")
    schema = f"id string, name string, career string, code string, diagnosis struct<{','.join(f'{k}:string' for k in validation.DIAGNOSIS)}>, trainings {processing.TRAINING}, theory array<string>, practice array<string>, vision string"
    given = [
        ("a", "Nombre propuesto", "Otra", "UGPA-RGI1-44-PRO-251-2025-10", tuple([None] * 6 + ["Específica"]), [offered, ("n", 9.0, "", "", "")], [" Fundamentos ", ""], [], " "),
        ("b", None, None, None, None, [offered], None, ["hacer"], "crecer"), ("c", "", None, None, None, None, None, None, None), ("zz", "x", None, None, None, None, None, None, None),
    ]
    out = {r["id"]: r for r in suggestions.with_suggestions(records_, spark.createDataFrame(given, schema)).collect()}
    a, b = out["a"], out["b"]
    assert (a["name"], a["career"], a["code"], a["diagnosis"]["tipo_formacion"], a["theory"], a["practice"], a["vision"]) == ("Persona confirmada", "Derecho", "UGPA-RGI1-44-PRO-251-2025-10", "Específica", ["Fundamentos"], [], "")
    assert [tuple(t) for t in a["trainings"]] == [("Curso confirmado", 40.0, "octubre de 2025", "noviembre de 2025", "Aprobación"), ("Otro", 5.0, "x", "y", "z")]
    assert a["taken"] == ["docente.codigo_documento", "diagnostico.tipo_formacion", "detalles_plan.actividades_teoricas", "capacitaciones.0.horas", "capacitaciones.0.fecha_inicio_propuesta", "capacitaciones.0.fecha_fin_propuesta", "capacitaciones.0.tipo"]
    assert [tuple(t) for t in b["trainings"]] == [offered] and b["practice"] == ["hacer"] and b["taken"] == ["detalles_plan.vision_largo_plazo", "detalles_plan.actividades_practicas", "capacitaciones"]
    assert out["c"]["taken"] == out["d"]["taken"] == [] and set(out) == set("abcd")
