"""What a plan's parsing and linking read is worked out once, however many places read it; what they find does not change."""

import random

from pyspark.sql import functions as F

from docloom.functions import codes, similarity, text
from docloom.functions.quality import signal_score
from docloom.operators import extraction, linkage
from docloom.plans import text_queries


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, *rows):
    return spark.createDataFrame([(k, t, "plan.pdf") for k, t in enumerate(rows)], "doc_id int, text string, file_name string")


def test_a_line_is_cased_without_being_read_again(spark):
    rows = texts(spark, "x\nNombre del docente: ANA DE LA CRUZ\ny", "Nombre del docente:\nJuan pérez", "NOMBRE DEL DOCENTE ÁNGEL", "nada", "Nombre del docente\nCarrera: x\nÓSCAR", None)
    named = rows.select(text.smart_case(extraction.label_value("text", "nombre del docente", ("carrera",))).alias("x"))
    assert optimized(named).count("nombre del docente") == 1  # before, one for each place that reads the line or the value
    assert [r["x"] for r in named.collect()] == ["Ana de la Cruz", "Juan pérez", "Ángel", "", "Óscar", ""]


def test_texts_of_plans_are_folded_once(spark):
    plan = optimized(extraction.plans(texts(spark, "a")))
    assert plan.count("translate(") <= 14  # before, one for each section and label besides those of values
    assert plan.count("UGPA[") == 10  # a code's match, and its parts, of a text and of a file name


def test_codes_are_looked_for_once_in_a_text(spark):
    assert optimized(texts(spark, "a").select(codes.code_candidates("text").alias("c"))).count("regexp_extract_all") == 5


def test_codes_of_long_texts(spark):
    code = "UGPA-RGI1-44-PRO-251-2025-12"
    far = "U.\n-" * 3 + "G P A" + " " * 500 + "RGI1 44 PRO 251 2025 12"
    rows = {
        "": [], None: [], "UGPA" * 3000: [], "U G P A sin codigo": [], code + "7": [("UGPA-RGI1-44-PRO-251-2025-12", 94)],
        "x " * 900 + code + " y" * 900 + "UGPA " * 40 + code.replace("44", "45"): [(code, 98), (code.replace("44", "45"), 98)],
        "U\nG..P A" + " " * 500 + "RGI1 44 PRO 251 2025 12": [(code, 94)], far: [(code, 94)],
        "UGPA " + "z" * 70 + " RGI1-44-PRO-251-2025-12": [], "U G P A UGPA-RGI1-44-PRO-251-2025-12.": [(code, 98)],
    }
    out = texts(spark, *rows).select("doc_id", codes.code_candidates("text").alias("c")).orderBy("doc_id").collect()
    assert [[tuple(c) for c in r["c"]] for r in out] == list(rows.values())


def test_sections_prefer_their_end_labels(spark):
    rows = texts(spark, "4. Resumen\nuno\n6. Actividades\ndos\n5. Indicadores", "4 resumen uno 6. actividad dos", "4 resumen uno", "nada", "4. résumeń úno 5 INDICADOR")
    got = rows.select(extraction.table_section("text", r"4\.?\s*resumen", r"5\.?\s*indicador", r"6\.?\s*actividad").alias("p"), extraction.section("text", r"4\.?\s*resumen", (r"5\.?\s*indicador", r"6\.?\s*actividad")).alias("n")).collect()
    assert [r["p"] for r in got] == ["\nuno\n6. Actividades\ndos\n", "uno", "uno", "", "úno"]
    assert [r["n"] for r in got] == ["\nuno\n", "uno", "uno", "", "úno"]


def test_signals_are_whole_words(spark):
    rows = texts(spark, "PRO-251", "pro 2510", "xpro 251", "a Pro  251 b", "nombre docente\npro 251", None)
    assert [r["s"] for r in rows.select(signal_score("text", {"pro 251": 3, "nombre docente": 1}).alias("s")).collect()] == [3, 0, 0, 3, 4, 0]


def brute_links(records, options):
    """The best option of each id by comparing all, thresholds afterwards."""
    words = lambda t: {x for x in t.split() if len(x) > 1}
    overlap = lambda a, b: len(a & b) / max(len(a), len(b)) if a and b else 0.0
    best = {}
    for rid, teacher, training, period in records:
        for oid, ordinal, o_teacher, o_training, o_period in options:
            a, b = overlap(words(teacher), words(o_teacher)), overlap(words(training), words(o_training))
            score = round(a * 0.55 + b * 0.40 + (0.05 if period and period == o_period else 0.0), 6)
            best[rid] = max(best.get(rid, (-1.0,)), (score, -ordinal, oid, a, b))
    return {rid: (x[2], x[0]) for rid, x in best.items() if x[0] >= 0.62 and x[3] >= 0.65 and x[4] >= 0.5}


def random_links(rng, n, ids):
    some = lambda of, least, most: " ".join(rng.sample(of, rng.randint(least, most)))
    names, courses, periods = [f"n{k}" for k in range(9)], [f"c{k}" for k in range(5)], ["2024-01", "2024-02", "", None]
    records = [(rng.choice(ids), some(names, 0, 7), some(courses, 0, 4), rng.choice(periods)) for _ in range(n)]
    options = [(f"o{k}", rng.randint(0, 9), some(names, 0, 8), some(courses, 0, 4), rng.choice(periods)) for k in range(n)]
    return records, options


def test_links_are_those_of_a_full_comparison(spark):
    rng = random.Random(4)
    for n, ids in ((60, [None, *range(80)]), (150, range(400)), (1, [1])):
        records, options = random_links(rng, n, ids)
        r, o = spark.createDataFrame(records, "record_id int, teacher string, training string, period string"), spark.createDataFrame(options, "option_id string, ordinal int, teacher string, training string, period string")
        got = linkage.match_training(r, o).collect()
        assert {x["record_id"]: (x["option_id"], x["score"]) for x in got} == brute_links(records, options) and len(got) == len({x["record_id"] for x in got})


def test_records_of_the_same_tokens_are_compared_once(spark):
    n = 3000  # nine million pairs of rows
    r = spark.range(n).select(F.col("id").alias("record_id"), F.lit("Ana Maria Paz").alias("teacher"), F.lit("Redes").alias("training"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("period"))
    o = spark.range(n).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("option_id"), (n - F.col("id")).alias("ordinal"), F.lit("paz ANA maria").alias("teacher"), F.lit("redes").alias("training"), F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("period"))
    got = linkage.match_training(r, o).groupBy((F.col("record_id") % 7).alias("k")).agg(F.count("*").alias("n"), F.min("option_id").alias("a"), F.max("option_id").alias("b"), F.min("score").alias("s"), F.max("score").alias("t")).collect()
    want = {k: (f"o{n - 5 + k}", 1.0) if k < 5 else ("o2999", 0.95) for k in range(7)}
    assert {x["k"]: (x["a"], x["s"]) for x in got} == want and all(x["a"] == x["b"] and x["s"] == x["t"] for x in got) and sum(x["n"] for x in got) == n


def test_pairs_are_not_sorted_to_find_the_best(spark):
    rows = spark.createDataFrame([(1, ["a"], ["b"], ["a"], ["b"], 0)], "set_id long, a array<string>, ta array<string>, b array<string>, tb array<string>, rank long")
    plan = rows.select("set_id", linkage._pair_value(0.0).alias("best")).groupBy("set_id").agg(F.max("best"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_fields_of_agreements_are_read_once(spark):
    text = "Código: CGC-RGI2-7-PRO-134-2024-11\nNombre del docente: ANA PAZ\nCapacitación: Redes..\nEn Quito, a los 32 días del mes de mayo de 2024, a los 2 días del mes de mayo de 2024 y 3/4/2025, 3 de junio de 2024"
    rows = spark.createDataFrame([(1, text, "OCR", "a.pdf"), (2, "El señor Ana Paz, con número de cédula 1, x 31/12/2024", "OCR", "CGC-RGI2-7-PRO-134-2024-11.pdf"), (3, None, "DIGITAL", None)], "doc_id int, text string, method string, file_name string")
    found = extraction.agreements(rows)
    assert optimized(found).count("UGPA|CGC") <= 12 and optimized(found).count("a\\s+los\\s+") <= 7  # before, 36 and 28 times
    got = [(r["code"], r["signed_on"], r["signed_text"], r["name"], r["training"]) for r in found.orderBy("doc_id").collect()]
    code = "CGC-RGI2-7-PRO-134-2024-11"
    assert got == [(code, "2025-04-03", "3/4/2025", "Ana Paz", "Redes"), (code, "2024-12-31", "31/12/2024", "Ana Paz", ""), ("", "", "", "", "")]


def test_distances_of_all_pairs():
    rng = random.Random(5)
    some = lambda n, most: ["", "a", *("".join(rng.choice("abcñ 😀") for _ in range(rng.randint(0, most))) for _ in range(n))]
    for patterns, texts in ((some(20, 64), some(30, 90)), (some(9, 80), some(9, 64)), (some(9, 80), some(9, 80)), ([], ["a"]), (["a"], [])):
        got = similarity.edit_distances(patterns, texts)
        assert got.tolist() == [[similarity._distances(p, [t])[0] for t in texts] for p in patterns]


def test_names_of_a_group_are_compared_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_queries, "BLOCK", 10)
    monkeypatch.setattr(text_queries, "PAIRS", 100)
    monkeypatch.setattr(text_queries, "LISTED", 7)
    monkeypatch.setattr(similarity, "BATCH_IDS", 100)
    customers = [(k, f"Customer {k % 90}" if k % 9 else "", k % 3, "AUTO" if k % 9 else "") for k in range(300)]
    suppliers = [(k, ["", "x", f"Supplier {k}", "customer 1 auto", "Customer " + "y" * 70][k % 5], k % 4) for k in range(40)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    out = text_queries.edit_similarity(spark, str(tmp_path))
    key = lambda t: " ".join("".join(x if x.isalnum() else " " for x in t.lower()).split())

    def ratio(a, b):
        longest = max(len(a), len(b))
        return round(1 - similarity._distances(a, [b])[0] / longest, 6) if a and b else 0.0

    want = sorted((s, c, ratio(key(x), key(f"{y} {m}"))) for s, x, n in suppliers for c, y, k, m in customers if n == k)
    assert sorted((r["s_suppkey"], r["c_custkey"], r["ratio"]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and plan.count("REPARTITION_BY_NUM") >= 2  # before, as few tasks as the bytes of names make
    parts = [r[0] for r in out.select(F.spark_partition_id()).distinct().collect()]
    assert len(parts) > 4  # there are nine parts of groups
