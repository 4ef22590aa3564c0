from pyspark.sql import functions as F

from docloom.operators import layout


def test_scores_and_best_pass(spark):
    rows = spark.createDataFrame([("d", 1, "nada"), ("d", 2, "1 Redes 40 Desde marzo hasta mayo TALLER"), ("d", 3, "1 Redes 40 Desde marzo hasta mayo TALLER"), ("e", 1, None)], "doc_id string, pass int, text string")
    out = {r["doc_id"]: r["pass"] for r in layout.best_pass(rows, ["doc_id"], layout.table_score("text")).collect()}
    assert out == {"d": 2, "e": 1}
    row = rows.select(layout.table_score("text").alias("t"), layout.activity_score(F.lit("Actividades teóricas y prácticas")).alias("a")).collect()[1]
    # two row numbers, a kind, two range words and two months, two numbers, eight words; 32 characters and both headings
    assert (row["t"], round(row["a"], 4)) == (8 + 5 + 8 + 2 + 1, round(32 / 30 + 16, 4))


def test_assigned_activities(spark):
    rows = spark.createDataFrame([([("Curso de seguridad",), ("Otra cosa",)], ["leer", "practicar hacking"])], "t array<struct<name:string>>, a array<string>")
    out = rows.select(layout.assigned_activities(F.col("t"), F.col("a")).alias("x")).first()["x"]
    assert [(r["items"], r["shared"]) for r in out] == [(["practicar hacking"], False), (["leer", "practicar hacking"], True)]


def test_rectangles_and_keys(spark):
    n = lambda v: F.lit(float(v))
    row = spark.range(1).select(layout.clamped(n(-5), n(10), n(200), n(5), n(100), n(50)).alias("c"), layout.by_ratio(n(100), n(50), 0.1, 0.2, 0.5, 0.5).alias("r"), layout.record_key(F.lit("Ána"), F.lit(""), F.lit("x.pdf")).alias("k")).first()
    assert tuple(row["c"]) == (0.0, 10.0, 100.0, 5.0) and tuple(row["r"]) == (10.0, 10.0, 50.0, 25.0) and row["k"] == "ana|x pdf"
    t = spark.range(1).select(layout.manual_training(F.lit(" a "), F.lit("-3"), F.lit(None), F.lit("x"), F.lit("y"), F.lit("p\nq"), F.lit("")).alias("t")).first()["t"]
    assert (t["name"], t["hours"], t["start"], t["theory"], t["practice"]) == ("a", 0.0, "", ["p", "q"], [])
