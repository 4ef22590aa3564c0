"""Text items, page signals, rows of regions and shared activities on small and odd inputs."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.quality import is_usable_layer, positional_signal
from docloom.functions.similarity import alias_score
from docloom.operators import extraction, geometry, layout, processing
from docloom.sources.files import READING, split_failures

ITEM = "doc_id string, page int, run int, text string, x double, baseline double, width double, height double, page_height double"


def test_text_items_are_wide_enough_and_count_from_the_top(spark):
    items = [("d", 1, 0, "ab  c", 10.0, 700.0, 0.0, -20.0, 842.0), ("d", 1, 1, " \t ", 0.0, 0.0, 9.0, 9.0, 842.0), ("d", 1, 2, None, None, None, None, None, 842.0), ("e", 1, 0, "x", None, None, None, None, 5.0)]
    out = geometry.split_runs(geometry.item_runs(spark.createDataFrame(items, ITEM))).orderBy("doc_id", "run", "pos").collect()
    # four characters, 20 high, need 7.6 units each; a missing height is 10, tops never lie above the page
    assert [(r["doc_id"], r["text"], round(r["left"], 4), r["top"], round(r["width"], 4), r["height"]) for r in out] == [("d", "ab", 10.0, 122.0, 15.2, 20.0), ("d", "c", 32.8, 122.0, 7.6, 20.0), ("e", "x", 0.0, 0.0, 3.8, 10.0)]


def test_narrow_words_push_the_next_ones(spark):
    runs = spark.createDataFrame([("d", 1, 0, "a b", 0.0, 0.0, 9.0, 5.0)], "doc_id string, page int, run int, text string, left double, top double, width double, height double")
    assert [(r["left"], r["width"]) for r in geometry.split_runs(runs).orderBy("pos").collect()] == [(0.0, 3.0), (6.0, 3.0)]
    assert geometry.split_runs(runs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "points"),
    [(None, 0), ("", 0), ("Plan Individual de Formación y Capacitación", 4), ("plan individual: formación", 2), ("PRO-251", 3), ("docente", 0), ("docente; carrera", 1), ("nombre docente, docente y carrera", 1), ("capacitación propuesta y resumen de capacitación", 2), ("Visión a largo plazo", 1),
     ("Plan Individual de Formación y Capacitación PRO-251 nombre docente resumen de capacitación impacto esperado", 11)],
)
def test_positional_signal(spark, text, points):
    row = spark.createDataFrame([(text,)], "t string").select(positional_signal("t").alias("n"), is_usable_layer("t").alias("short"), is_usable_layer(F.concat_ws(" ", "t", F.lit("palabra " * 80))).alias("long")).first()
    assert (row["n"], row["short"], row["long"]) == (points, False, points >= 5)


def test_rows_of_a_region_count_if_more_or_fuller(spark):
    row = "array<struct<ordinal:int,name:string,hours:double,start:string,end:string,kind:string>>"
    full, bare = (7, "a", 1.0, "b", "c", "d"), (7, "a", 0.0, "", None, "")
    cases = [([full], [bare, bare], 2), ([full, bare], [full], 2), ([bare], [full], 1), ([full], [], 1), ([], [], 0)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], f"k int, a {row}, b {row}")
    out = {r["k"]: r["x"] for r in frame.select("k", extraction.fuller_rows(F.col("a"), F.col("b")).alias("x")).collect()}
    assert [len(out[k]) for k in range(5)] == [n for *_, n in cases] and out[2][0]["hours"] == 1.0 and [r["ordinal"] for r in out[0]] == [1, 2]


def test_activities_of_both_lists(spark):
    frame = spark.createDataFrame([([("Curso de seguridad",), (None,)], (["leer", "ethical hacking"], [])), ([], ([], []))], "t array<struct<name:string>>, a struct<theory:array<string>,practice:array<string>>")
    out = [r["x"] for r in frame.select(layout.training_activities(F.col("t"), F.col("a")).alias("x")).collect()]
    assert [(x["theory"], x["practice"], x["shared"]) for x in out[0]] == [(["ethical hacking"], [], True), (["leer", "ethical hacking"], [], True)] and out[1] == []


def test_alias_groups_apply_one_after_the_other(spark):
    groups = [("a1", "b1"), ("b1", "c1"), ("c1", "dd1")]
    row = spark.createDataFrame([("a1", "dd1"), ("dd1", "a1"), (None, "a1")], "x string, y string").select(alias_score("x", "y", groups).alias("s")).collect()
    # a1 reaches all; dd1 joins its own group only, whose other member all hold
    assert [r["s"] for r in row] == [3, 3, 0]


def test_the_table_of_a_page_by_its_words_in_any_order(spark):
    lines = [(1, 3, 1000.0, 800.0, t, y, y + 10) for t, y in (("Propuesta de capacitación: resumen", 100.0), ("5. Indicadores", 300.0))]
    schema = "doc_id int, page int, page_width double, page_height double, text string, top double, bottom double"
    out = geometry.page_regions(spark.createDataFrame(lines, schema)).collect()
    assert [(r["region"], r["top"], r["height"]) for r in out] == [("table", 97.0, 205.0)]
    assert geometry.page_regions(spark.createDataFrame([], schema)).count() == 0


def test_documents_that_no_engine_reads_become_error_records(spark):
    long = "palabra " * 20
    rows = [("a", "OCR", "", 0, "ERROR", "b: x"), ("a", "DIGITAL", None, 0, "D", None), ("b", "OCR", long, 1, "OCR", None), ("b", "DIGITAL", "", 0, "ERROR", "e"), ("c", "OCR", long, 0, "ERROR", " "), ("d", "OCR", "corto", 1, "OCR", None)]
    good, dead = split_failures(spark.createDataFrame(rows, READING))
    assert good.count() + dead.count() == len(rows)
    out = {r["doc_id"]: r for r in processing.error_plans(dead, good).collect()}
    assert {k: r["missing"] for k, r in out.items()} == {"a": ["too little text"], "c": ["unreadable"], "d": ["too little text"]}
    assert all((r["status"], r["confidence"], r["trainings"], r["name"], r["diagnosis"]["tipo_formacion"], r["issues"]) == ("ERROR", 0, [], "", "", []) for r in out.values())
    assert processing.error_plans(dead.limit(0), good).count() == 0


def test_numbers_and_positions_of_agreements(spark):
    texts = ["Capacitación en la institución 0999999999\nCargo: Rector", "CÉDULA： 0102030405678\ncargo: coordinador de redes | x", "cedula 123456789 y cédula: 1234567890\nVersion 1.2.3.", None, ""]
    frame = spark.createDataFrame([(k, t, "DIGITAL", "a.pdf") for k, t in enumerate(texts)], "doc_id int, text string, method string, file_name string")
    out = extraction.agreements(frame).orderBy("doc_id").collect()
    assert [(r["id_number"] or "", r["position"], r["version"] or "") for r in out] == [("", "Docente", ""), ("0102030405678", "coordinador de redes", ""), ("1234567890", "Docente", "1.2.3"), ("", "Docente", ""), ("", "Docente", "")]
