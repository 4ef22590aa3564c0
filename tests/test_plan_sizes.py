"""Joins of exploded rows stay off the driver, whatever Spark expects of their sizes; what these steps find does not change."""

import random

from pyspark.sql import functions as F

from docloom import catalogue
from docloom.operators import changes, incremental, merging, migration, records
from docloom.plans.process_queries import _supplier_plans

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_not_broadcast(spark):
    assert "Broadcast" not in plan(catalogue.queries()["substring_index"](spark, FOLDER))


def some_records(spark):
    return _supplier_plans(spark, FOLDER)


def test_names_are_compared_through_long_pieces_by_a_shuffle(spark):
    rows = some_records(spark)
    assert "BroadcastHashJoin" not in plan(records.possible_links(rows))
    named = records.match_keys(rows).select("id", "name")
    assert {len(r["piece"]) for r in records.name_pieces(named).collect()} == {4}  # 40 characters, 6 edits, 3 pieces to spare
    assert {len(r["piece"]) for r in records.name_grams(named).collect()} == {3, 4}


def test_similar_names_of_any_length_share_a_piece(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc ") for _ in range(n)).strip() or "a" for n in range(1, 60) for _ in range(2)]
    for name in list(names):
        edited = list(name)
        for _ in range(int(len(name) * 0.16)):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice(["", "ab", "c"])
        names.append(" ".join("".join(edited).split()) or "b")
    rows = [(k, k, "", "", " ".join(name.split())) for k, name in enumerate(names)]
    got = {(r["a"], r["b"]) for r in records.blocked(spark.createDataFrame(rows, "id int, seq int, hash string, code string, name string")).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and records.edit_ratio(a[4], b[4]) >= records.SIMILAR_NAME}
    assert got == want and len(want) > 50


def test_records_are_not_broadcast_for_merging(spark):
    rows = some_records(spark)
    assert "Broadcast" not in plan(merging.merged_by(rows, rows.select("id", F.col("id").alias("kept_id"))))


def test_upserted_records_are_not_broadcast(spark):
    rows = some_records(spark)
    assert "Broadcast" not in plan(merging.upserted_plans(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")))


def test_versions_of_records_are_not_broadcast_for_the_log(spark):
    rows = some_records(spark)
    assert "Broadcast" not in plan(changes.change_log(rows, changes.repaired_plans(rows), 1, "x"))


def test_keys_of_a_batch_are_not_broadcast(spark):
    rows = some_records(spark)
    keys = incremental.record_keys(rows).withColumnRenamed("id", "comp")
    assert "Broadcast" not in plan(incremental.probed(rows, keys))


def test_rows_of_a_migrated_store_are_not_broadcast(spark):
    store = some_records(spark).limit(9).withColumns({"remarks": F.array(F.lit("otra")), "status": F.lit("REVISAR")})
    assert "Broadcast" not in plan(migration.migrated_plans(store, 2026)[1])


def test_pairs_of_groups_are_dealt_over_tasks(spark):
    for name in ("token_overlap", "edit_similarity"):
        assert "Broadcast" not in plan(catalogue.queries()[name](spark, FOLDER))


def test_many_equal_texts_give_every_pair(spark, tmp_path):
    n = 2100  # three lists of ids
    spark.range(n).selectExpr("id AS p_partkey", "'a ring' AS p_name", "'SMALL' AS p_type", "'Brand#1' AS p_brand", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    out = catalogue.queries()["token_overlap"](spark, str(tmp_path))
    assert out.agg(F.count("*"), F.count_distinct("a", "b"), F.max(F.col("a") >= F.col("b")), F.min("rows_overlap")).first()[:] == (n * (n - 1) // 2, n * (n - 1) // 2, False, 1.0)


def test_options_are_not_broadcast_for_linking(spark):
    assert "Broadcast" not in plan(catalogue.queries()["link_argmax"](spark, FOLDER))
