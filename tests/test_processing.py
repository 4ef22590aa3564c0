from docloom.functions import cleaners, codes
from docloom.operators import extraction, geometry, merging, processing, records, validation

FORM = """PLAN INDIVIDUAL DE FORMACIÓN Y CAPACITACIÓN DOCENTE
Código del documento: UGPA-RGI1-44-PRO-251-2025-12
Nombre del docente: LUZ MORA
Carrera: Enfermeria
¿En qué curso o programa de actualización has participado en los últimos 12 meses?
Primeros auxilios
¿Cuál es tu nivel académico actual (título registrado)?
Magister
4. Resumen de Capacitación Propuestas
1 Redes 40 Desde 10 de marzo de 2025 hasta 20 de marzo de 2025 TALLER
2 Salud
comunitaria 30 Desde 1 de abril de 2025 hasta 5 de abril de 2025 CURSO
5. Indicadores
6. Actividades
Actividades teóricas
- leer
Actividades prácticas
- hacer
7. Impacto esperado en el docente
Mejora
8. Visión a largo plazo
Ser mejor"""


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_misread_codes(spark):
    texts = ["UGPA-RGI1-44-PRO-251-2025-12", "U6P4 R6I 2 - 3O - PRQ 25I 20ZS", "U6P4 R6I 2 - 3O - PRQ 25I 2O25 7", "U6PA R6I 1 4S PR0 25I 20Z5 7", "UG PA-RG I1-44-PR O-25 1-2025-12", "UGPA y RGI1 y 44 y PRO y 251 y 2025 y 03 y", "UGPA-RGI1-00-PRO-251-2025-12", "", None, "UGPA-RGI1-44-PRO-251-2025-12 UGPA-RGI1-45-PRO-251-2025-12 UGPA RGI1 44 PRO 251 2025 12"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", codes.code_candidates("t").alias("c")).orderBy("k").collect()
    got = [[(x["code"], x["confidence"]) for x in r["c"]] for r in rows]
    assert got[0] == [("UGPA-RGI1-44-PRO-251-2025-12", 98)] and got[1] == got[2] == got[3] == [] and got[6] == got[7] == got[8] == []
    assert got[4] == [("UGPA-RGI1-44-PRO-251-2025-12", 94)] and got[5] == [("UGPA-RGI1-44-PRO-251-2025-03", 88)]
    assert got[9] == [("UGPA-RGI1-44-PRO-251-2025-12", 98), ("UGPA-RGI1-45-PRO-251-2025-12", 98)]


def test_header_codes_weigh_sources(spark):
    rows = [(1, 0, "LINEAL", "UGPA-RGI1-44-PRO-251-2025-12"), (1, 1, "REGION_CODIGO", "UGPA-RGI1-04-PRO-251-2025-12"), (2, 0, "LINEAL", "nada"), (3, 0, "LINEAL", "UGPA-RGI1-44-PRO-251-2025-12"), (3, 1, "LINEAL", "UGPA-RGI1-45-PRO-251-2025-12")]
    out = {r["doc_id"]: r for r in processing.header_codes(spark.createDataFrame(rows, "doc_id int, seq int, source string, text string")).collect()}
    assert set(out) == {1, 3} and out[1]["code"] == "UGPA-RGI1-04-PRO-251-2025-12" and out[1]["period"] == "2025-12"
    assert out[1]["confidence"] == 86 and out[3]["code"] == "UGPA-RGI1-44-PRO-251-2025-12"  # 55 + 8 * 4 * 0.98, rounded


def test_cleaners(spark):
    assert one(spark, cleaners.teacher_name("t"), t="Luz Mora  UGPA-RGI1-44\nresto") == "Luz Mora"
    assert one(spark, cleaners.training_name("t"), t="3. Redes 40 horas Desde enero") == "Redes"
    assert one(spark, cleaners.training_name("t"), t="Redes 2024") == "Redes 2024"
    assert one(spark, cleaners.cell("t"), t="| Nombre de Capacitación Propuesta Redes -") == "Nombre de Capacitación Propuesta Redes"
    assert one(spark, cleaners.cell("t"), t="Nombre de Capacitación Propuesta Redes -") == "Redes"
    assert one(spark, cleaners.answer("t"), t="• Sí, mucho. 5. Indicadores y más") == "Sí, mucho."
    assert one(spark, cleaners.diagnosis("t"), t="bien 4. Resumen de Capacitaciones Propuestas x") == "bien"
    assert one(spark, cleaners.without_headings("t"), t="# Nombre de Capacitación Propuesta Horas de Capacitación Propuesta 1 Redes") == "1 Redes"
    assert one(spark, cleaners.section_text("t", r"8\\.?\\s*Visi[oó]n\\s+a\\s+largo\\s+plazo".replace("\\\\", "\\")), t="8. Visión a largo plazo (3 a 5 años): crecer") == "crecer"
    names = {"UGABC~1.PDF": True, "ugabcd.pdf": True, "plan.pdf": False, "": False}
    assert {k: one(spark, cleaners.is_alias_file("t"), t=k) for k in names} == names
    assert one(spark, cleaners.is_table_heading("t"), t="Horas de") and not one(spark, cleaners.is_table_heading("t"), t="Redes")
    assert one(spark, cleaners.is_section_heading("t"), t="Indicadores de logro") and not one(spark, cleaners.is_section_heading("t"), t="otra")
    assert one(spark, cleaners.is_question("t", ("que estrategias",)), t="• ¿Cómo?") and one(spark, cleaners.is_question("t", ("que estrategias",)), t="Qué estrategias usas")
    assert one(spark, cleaners.looks_like_table("t"), t="desde desde aprobación Aprobación") and not one(spark, cleaners.looks_like_table("t"), t="desde aprobación")
    assert [one(spark, cleaners.is_true("t"), t=v) for v in ("Sí", "true", "1", "no", None)] == [True, True, True, False, False]


def test_processed_plans(spark):
    noisy = FORM.replace("LUZ MORA", "LUZ MOPA").replace("Redes 40", "Redes 4O").replace("- hacer", "- Hacer.\n- medir")
    rows = [(1, "DIGITAL_LINEAL", 0, FORM, "a.pdf", ""), (1, "OCR_TEXTO", 1, noisy, "a.pdf", None), (2, "DIGITAL_LINEAL", 0, "una carta " * 20, "b.pdf", ""), (3, "DIGITAL_LINEAL", 0, "corto", "c.pdf", ""), (3, "OCR_TEXTO", 0, None, "c.pdf", "")]
    readings = spark.createDataFrame(rows, "doc_id long, engine string, seq int, text string, file_name string, region_text string")
    out = {r["doc_id"]: r for r in processing.processed_plans(readings, 2026).collect()}
    assert set(out) == {1, 2}  # a document without text enough has no record
    r = out[1]
    assert (r["name"], r["career"], r["level"], r["code"], r["template"]) == ("Luz Mora", "Enfermería", "Magister", "UGPA-RGI1-44-PRO-251-2025-12", "MODERNA")
    assert [(t["name"], t["hours"], t["kind"]) for t in r["trainings"]] == [("Redes", 40.0, "TALLER"), ("Salud comunitaria", 30.0, "CURSO")]
    assert (r["theory"], r["practice"], r["vision"]) == (["leer"], ["hacer", "medir"], "Ser mejor") and r["diagnosis"]["capacitacion_12_meses"] == "Primeros auxilios"
    assert r["evidence"]["name"]["engines"] == "DIGITAL_LINEAL" and r["engines"] == 2 and r["status"] == "REVISAR" and r["fallback"]
    assert {i["path"] for i in r["issues"] if i["severity"] == "error"} == {f"diagnostico.{k}" for k in validation.DIAGNOSIS} - {"diagnostico.capacitacion_12_meses"}
    assert out[2]["status"] == "NO_ES_PLAN"
    told = validation.with_messages(spark.createDataFrame([([("capacitaciones.0.horas", "error", "invalid", "contenido", "semantica"), ("docente.nombre", "error", "missing", "lectura", "estructura")],)], f"issues array<{validation.ISSUE}>")).first()
    assert told["missing_fields"] == ["Capacitación 1: horas supera el límite razonable de 1000 horas.", "No se pudo confirmar: Nombre del docente."]


def test_processed_plans_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, engine string, seq int, text string, file_name string, region_text string")
    assert processing.processed_plans(none, 2026).collect() == []


PLAN = f"id string, seq int, hash string, file_name string, manual boolean, name string, career string, level string, code string, period string, diagnosis struct<{','.join(f'{k}:string' for k in validation.DIAGNOSIS)}>, trainings {processing.TRAINING}, theory array<string>, practice array<string>, impact string, vision string"


def plan(id, seq, **more):
    base = {"id": id, "seq": seq, "hash": "", "file_name": f"{id}.pdf", "manual": False, "name": "Luz Mora", "career": "Derecho", "level": "", "code": "", "period": "", "diagnosis": tuple([""] * 7), "trainings": [("Redes", 40.0, "enero de 2025", "", "Taller")], "theory": [], "practice": [], "impact": "", "vision": ""}
    return tuple({**base, **more}.values())


def test_merged_plans_keep_corrections_by_hand(spark):
    code = "UGPA-RGI1-44-PRO-251-2025-12"
    rows = [plan("a", 0, manual=True, name="Luz Mora Ríos", code=code, level="Magister"), plan("b", 1, name="LUZ M.", code=code, level="un título mucho más largo que el otro", trainings=[("Otra capacitación nueva", 8.0, "", "", "Curso")]), plan("c", 2, name="Otro Docente", career="Medicina", trainings=[])]
    out = {r["id"]: r for r in merging.merged_plans(spark.createDataFrame(rows, PLAN)).collect()}
    assert set(out) == {"a", "c"} and out["a"]["n_records"] == 2 and out["c"]["n_records"] == 1
    assert (out["a"]["name"], out["a"]["level"], out["a"]["manual"], out["a"]["period"]) == ("Luz Mora Ríos", "Magister", True, "2025-12")
    assert [t["name"] for t in out["a"]["trainings"]] == ["Redes", "Otra capacitación nueva"] and out["a"]["files"] == ["a.pdf", "b.pdf"]


def test_upserted_plans(spark):
    code = "UGPA-RGI1-44-PRO-251-2025-12"
    store = spark.createDataFrame([plan("a", 0, code=code), plan("b", 1, name="Otro Docente", trainings=[])], PLAN)
    batch = spark.createDataFrame([plan("x", 0, code=code, vision="crecer"), plan("y", 1, name="Tercera Persona", career="Medicina", trainings=[])], PLAN)
    out = {r["id"]: r for r in merging.upserted_plans(store, batch).collect()}
    assert {k: r["action"] for k, r in out.items()} == {"a": "updated", "b": "stored", "y": "inserted"} and out["a"]["vision"] == "crecer"
    assert merging.upserted_plans(store.limit(0), batch.limit(0)).collect() == []


def test_improved_plans(spark):
    out = merging.improved_plans(spark.createDataFrame([plan("a", 0, name="Luz UGPA-RGI1-44", career="enfermeria", code="UGPA-RGI1-44-PRO-251-2025-12")], PLAN)).first()
    assert (out["name"], out["career"], out["period"]) == ("Luz", "Enfermería", "2025-12")


def test_agreement_clauses(spark):
    text = "ACUERDO\nEl señor Luz Mora, con número de cédula 0102030405, se encuentra vinculado (a) como coordinadora académica en el Instituto. La participación de la colaboradora en la capacitación Redes avanzadas, con el objetivo de mejorar."
    out = extraction.agreements(spark.createDataFrame([(1, text, "DIGITAL", "x.pdf")], "doc_id int, text string, method string, file_name string")).first()
    assert (out["name"], out["position"], out["training"], out["id_number"]) == ("Luz Mora", "coordinadora académica", "Redes avanzadas", "0102030405")


def test_tsv_words_and_regions(spark):
    tsv = "level\tpage\n5\t1\t1\t1\t2\t3\t10\t20\t30\t8\t91.5\thola\n5\t1\t1\t1\t2\t4\t10\t20\t30\t8\t-2\tno\n5\t1\t1\t1\t2\t4\t10\t20\t30\t8\t50\t \ncorta"
    words = geometry.tsv_words(spark.createDataFrame([(1, tsv, 1.0, 2.0), (2, None, 0.0, 0.0)], "doc_id int, tsv string, left double, top double")).collect()
    assert [(w["text"], w["line"], w["word"], w["left"], w["top"], w["right"], w["center_y"]) for w in words] == [("hola", 2, 3, 11.0, 22.0, 41.0, 26.0)]
    lines = [(1, 3, 1000.0, 800.0, t, y, y + 10) for t, y in (("6. Actividades", 100.0), ("leer", 120.0), ("7. Impacto esperado en el docente", 200.0), ("Capacitación propuesta y horas", 20.0))]
    regions = {r["region"]: r for r in geometry.page_regions(spark.createDataFrame(lines, "doc_id int, page int, page_width double, page_height double, text string, top double, bottom double")).collect()}
    assert set(regions) == {"table", "activities", "impact"} and (regions["table"]["top"], regions["table"]["height"]) == (32.0, 512.0)
    assert regions["activities"]["top"] == 97.0 and regions["activities"]["top"] + regions["activities"]["height"] == 202.0


def test_fold_by_records(spark):
    rows = [("a", 0, "", "", "", "Luz Mora", "Derecho", ["redes"], False), ("b", 1, "", "", "", "Luz Mora", "Derecho", ["redes"], False), ("c", 2, "h", "", "", "Otra", "x", [], False), ("d", 3, "h", "", "", "Nadie", "y", [], False)]
    out = records.consolidated_all(spark.createDataFrame(rows, "id string, seq int, hash string, code string, period string, name string, career string, trainings array<string>, alias boolean"))
    assert {r["id"]: r["kept_id"] for r in out.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_regions_add_to_candidates(spark):
    readings = spark.createDataFrame([(1, "DIGITAL_POSICIONAL", 0, FORM, "a.pdf", "")], "doc_id long, engine string, seq int, text string, file_name string, region_text string")
    rows = [("Redes", 40.0, "a", "b", "Taller"), ("Salud", 30.0, "a", "b", "Curso"), ("Otra", 20.0, "a", "b", "Curso")]
    regions = spark.createDataFrame([(1, "UGPA-RGI2-07-PRO-251-2024-11", rows, "6. Actividades\nTeóricas\n- ver\n- oír\nPrácticas\n- armar", "7. Impacto esperado en el docente: crecer", None)], f"doc_id long, code_text string, rows {processing.TRAINING}, activities_text string, impact_text string, vision_text string")
    out = processing.with_regions(processing.candidates(readings), regions).first()
    assert (out["code"], out["period"], out["theory"], out["practice"], out["impact"], out["vision"]) == ("UGPA-RGI2-07-PRO-251-2024-11", "2024-11", ["ver", "oír"], ["armar"], "crecer", "Ser mejor")
    assert [t["name"] for t in out["trainings"]] == ["Redes", "Salud", "Otra"] and out["diagnosis"]["capacitacion_12_meses"] == "Primeros auxilios"
    plain = processing.with_regions(processing.candidates(readings), regions.limit(0)).first()
    assert plain["code"] == "UGPA-RGI1-44-PRO-251-2025-12" and len(plain["trainings"]) == 2


def test_processed_agreements(spark):
    text = "ACUERDO DE PATROCINIO INSTITUCIONAL\nCódigo: CGC-RGI2-3-PRO-134-2024-11\nNombre del docente: Luz Mora Vega\nCarrera: Derecho\nNombre de la capacitación: Redes avanzadas\nFinanciamiento total X\nEn Quito, a los 2 días del mes de noviembre de 2024. Firmado electrónicamente."
    readings = spark.createDataFrame([(1, text, "DIGITAL", "a.pdf"), (2, "corto", "OCR", "b.pdf")], "doc_id long, text string, method string, file_name string")
    options = spark.createDataFrame([("p:cap-0", 7, 0, "Luz Mora Vega", "Redes avanzadas", "2024-11"), ("q:cap-0", 8, 1, "Otra Persona", "Redes", "2024-11")], "option_id string, plan_id long, ordinal int, teacher string, training string, period string")
    out = processing.processed_agreements(readings, options).collect()
    assert [(r["doc_id"], r["option_id"], r["plan_id"], r["linked"], r["link_confidence"], r["support"], r["state"], r["signal"]) for r in out] == [(1, "p:cap-0", "7", True, 100, ["total"], "FIRMADO", 5)]
    assert {i["path"] for i in out[0]["issues"]} == {"docente.cedula"}


def test_missing_fields(spark):
    rows = spark.createDataFrame([plan("a", 0, level="x", code="c", period="p", theory=["a"], practice=["b"], impact="i", vision="v", diagnosis=tuple("abcdefg")), plan("b", 1, trainings=[])], PLAN).selectExpr("*", "'Tiempo Completo' AS dedication")
    out = {r["id"]: r for r in processing.missing_fields(rows).collect()}
    assert out["a"]["missing"] == ["Capacitación 1: fecha de finalización"] and (out["a"]["filled"], out["a"]["state"]) == (95, "REVISAR")
    assert len(out["b"]["missing"]) == 11 and out["b"]["missing"][-1] == "Capacitaciones propuestas"


def test_stored_plans(spark):
    rows = [plan("a", 0, level="x", code="UGPA-RGI1-44-PRO-251-2025-12", period="2025-12", theory=["a"], practice=["b"], impact="i", vision="v", diagnosis=tuple("abcdefg"), trainings=[("Redes", 40.0, "enero de 2025", "mayo de 2025", "Taller")]), plan("b", 1, name="Otro Docente", career="", trainings=[]), plan("c", 2, name="Tercera Persona", career="", manual=True, trainings=[])]
    out = {r["id"]: r for r in merging.stored_plans(spark.createDataFrame(rows, PLAN), 2026).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"a": "COMPLETO", "b": "NO_ES_PLAN", "c": "REVISAR"} and out["a"]["confidence"] == 100
