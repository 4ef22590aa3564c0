"""A store of an earlier version brought up to date: one plan from old rows to new ones, with what happened to each.

A pass merges duplicates, improves what is left (names, careers, codes, periods), rescues records
that were taken for something else but hold a plan's data, and evaluates all. Passes follow until one
changes nothing, so migrating a migrated store is without effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaners import is_useful_plan
from ..functions.text import normalize
from ..shared import by_shuffle, materialize
from .changes import repaired_plans
from .merging import SETTLED, improved_plans, merged_plans, stored_evaluation
from .validation import DIAGNOSIS

#: Columns that a migration settles; the others of a store come along from the record that stays.
SETTLED_BY = ("name", "career", "level", "code", "period", "manual", "diagnosis", "trainings", "theory", "practice", "impact", "vision", "remarks", "status", "rescued")


def _pass(store: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """The store after one pass, and (id, kept_id) of its merging."""
    merged = materialize(merged_plans(store), "migrated-merged")
    kept = merged.select(F.col("id").alias("kept_id"), F.explode("merged_ids").alias("id"))
    lead = merged.drop("files", "merged_ids", "n_records").join(by_shuffle(store.select("id", "seq", "hash", "file_name", "remarks", "status", "rescued")), "id")
    better = repaired_plans(improved_plans(lead)).drop("repaired")
    useful = is_useful_plan(F.col("name"), F.col("career"), F.array(*(F.col(f"diagnosis.{k}") for k in DIAGNOSIS)), F.col("trainings"))
    back = (F.col("status") == "NO_ES_PLAN") & useful
    rescued = better.withColumns({
        "rescued": F.coalesce("rescued", F.lit(False)) | back,
        "remarks": F.when(back, F.filter("remarks", lambda r: ~normalize(r).rlike(SETTLED[1]))).otherwise(F.col("remarks")),
    })
    failed = F.col("was") == "ERROR"
    judged = stored_evaluation(rescued.withColumn("was", F.col("status")), as_of_year)
    judged = judged.withColumn("status", F.when(failed, "ERROR").when((F.col("was") == "NO_ES_PLAN") & ~F.col("useful"), "NO_ES_PLAN").otherwise(F.col("status")))
    return materialize(judged.select(store.columns), "migrated"), kept


def migrated_plans(store: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """The store brought up to date, and what happened: id, kept_id (the record it is in now), action, and old and new row (structs of the columns of SETTLED_BY).

    store: records as merging has them, with remarks (array<string>), status and rescued (boolean; null
    in stores of earlier versions). Records with status ERROR keep it. action: merged, changed or same.
    """
    start = store.withColumn("rescued", F.coalesce("rescued", F.lit(False)) if "rescued" in store.columns else F.lit(False)).withColumn("remarks", F.coalesce("remarks", F.array().cast("array<string>")))
    row = lambda: F.struct(*SETTLED_BY)
    now, of = materialize(start, "store"), start.select("id", F.col("id").alias("kept_id"))
    while True:
        then, (now, kept) = now, _pass(now, as_of_year)
        of = materialize(of.join(by_shuffle(kept.toDF("next", "kept_id")), "kept_id").select("id", F.col("next").alias("kept_id")), "kept")
        both = then.select("id", F.to_json(row()).alias("then")).join(by_shuffle(now.select("id", F.to_json(row()).alias("now"))), "id", "left")
        if both.where("now is null or then <> now").isEmpty():
            break
    old = start.select("id", row().alias("old"))
    new = now.select(F.col("id").alias("kept_id"), row().alias("new"))
    out = old.join(by_shuffle(of), "id").join(by_shuffle(new), "kept_id")
    action = F.when(F.col("id") != F.col("kept_id"), "merged").when(F.to_json("old") != F.to_json("new"), "changed").otherwise("same")
    return now, out.select("id", "kept_id", action.alias("action"), "old", "new")
