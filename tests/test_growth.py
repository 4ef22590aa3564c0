"""What lets a step grow with its input: parts by rows, no failing casts, no second shuffle of words."""

from pyspark.sql import functions as F

from docloom import catalogue, shared
from docloom.functions.text import TIDY, number
from docloom.operators import consensus, validation
from docloom.operators.extraction import find_kind, table_row

FOLDER = "/root/testdata/sf0.001"


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(shared, "DEALT_ROWS", 10)
    rows = spark.range(1000).select((F.col("id") % 300).alias("k"))
    parts = shared.dealt(rows, "k").withColumn("part", F.spark_partition_id())
    assert parts.rdd.getNumPartitions() == max(100, spark.sparkContext.defaultParallelism)
    assert parts.groupBy("k").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    assert parts.count() == 1000


def test_words_of_a_page_are_not_shuffled_again(spark):
    plan = catalogue.queries()["visual_lines"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("ArrowEvalPython")[1].count("Exchange hashpartitioning") == 1  # that of the order's lines


def test_numbers_of_texts_are_those_of_a_cast(spark):
    texts = ["", " ", "12", " 7 ", "-3", "x", "1x", "1.5", "NaN", "Infinity", "-inf", "1e3", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in ("int", "double", "decimal(5,2)"):
        got = rows.select(number(F.col("t"), kind).cast("string").alias("a"), F.col("t").try_cast(kind).cast("string").alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), kind


def test_edges_of_the_words_of_a_row(spark):
    rows = spark.createDataFrame([("1 Redes 40 Desde mayo hasta junio TALLERES CURSO",), ("2 Redesdesde x 30 desde mayo al junio Taller",)], "t string")
    got = [tuple(r["x"]) for r in rows.select(table_row("t").alias("x")).collect()]
    assert got == [(1, "Redes", 40, "mayo", "junio TALLERES", "CURSO"), (2, "Redesdesde x", 30, "mayo", "junio", "TALLER")]
    assert rows.select(find_kind("t").alias("k")).collect()[0]["k"] == "CURSO"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_issues_are_not_worked_out_to_ask_whether_there_are_any(spark):
    assert "Filter" not in optimized(catalogue.queries()["issue_map"](spark, FOLDER))


def test_values_of_a_plan_are_read_once(spark):
    plan = optimized(catalogue.queries()["confidence_status"](spark, FOLDER))
    assert len(plan.split("\\A(?:[!-~")) < 40  # 20 texts and the lists' items; before, each rule read them anew


def test_first_issue_of_a_path_and_severity(spark):
    holds = lambda path, category, severity=validation.ERROR: validation.Rule(path, F.lit(True), category=category, severity=severity)
    rules = [holds("a", "1"), holds("a", "2"), holds("b", "3"), holds("b", "4", validation.WARNING), holds("a", "5"), validation.Rule("c", F.lit(None).cast("boolean")), holds("c", "6")]
    got = spark.range(1).select(validation.issues(rules).alias("i"), validation.issues(rules[4:], tuple(rules[:4])).alias("rest")).first()
    assert [x["category"] for x in got["i"]] == ["1", "3", "4", "6"] and [x["category"] for x in got["rest"]] == ["6"]


def test_tidy_texts(spark):
    texts = {"": True, "a": True, "a b": True, "á b-c": True, " a": False, "a ": False, "a  b": False, "a\nb": False, "a b": False, "a­b": False, "–": False, " ": False, "😀": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(TIDY).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == texts


def test_keys_of_aligned_rows_are_split_once(monkeypatch):
    calls = []
    split = consensus._tokens
    monkeypatch.setattr(consensus, "_tokens", lambda key: calls.append(key) or split(key))
    rows = [{"order": k, "key": f"curso tema{k}", "name": "a", "hours": 1.0, "start": "b", "end": "c", "kind": "d"} for k in range(9)]
    assert consensus.align_rows([("A", 6, rows), ("B", 6, rows)]) == [[(0, k), (1, k)] for k in range(9)]
    assert len(calls) == 18
