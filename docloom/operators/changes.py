"""A log of what changes records: cleaning, code repair and merging; replaying it over the input gives the output.

A log has a row for each changed value: id, step (its place in the order), path (a column, or a field
of a struct column as ``diagnosis.level``), before, after (texts; JSON for lists and structs, null for
null) and reason. A record that is merged into another has one row with path MERGED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import is_plan_code, period_of
from ..functions.text import text
from ..shared import by_shuffle, materialize
from .merging import improved_plans, merged_plans
from .processing import repaired_codes

#: Path of the row that says that a record went into another one.
MERGED = "_record"
REASONS = {
    "name": "name cleaned", "career": "career as the list spells it", "code": "code repaired by vote", "period": "period of the code",
}


def _spelled(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")


def _read(value: Column, kind: T.DataType) -> Column:
    return F.from_json(value, kind) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.cast(kind)


def paths_of(schema: T.StructType, skipped: tuple[str, ...] = ()) -> dict[str, T.DataType]:
    """Path and type of every value of a record: columns, and the fields of struct columns."""
    out: dict[str, T.DataType] = {}
    for f in schema.fields:
        if f.name not in skipped:
            out |= {f"{f.name}.{g.name}": g.dataType for g in f.dataType.fields} if isinstance(f.dataType, T.StructType) else {f.name: f.dataType}
    return out


def change_log(before: DataFrame, after: DataFrame, step: int, reasons: dict[str, str] | str, key: str = "id") -> DataFrame:
    """The log of one step: the paths whose values differ between two versions of the same records (unique keys). Columns that only one side has don't count; reasons: by path, or one for all."""
    old, new = paths_of(before.schema, (key,)), paths_of(after.schema, (key,))
    both = before.select(key, F.struct(*(c for c in before.columns if c != key)).alias("b")).join(by_shuffle(after.select(key, F.struct(*(c for c in after.columns if c != key)).alias("a"))), key)
    reason = (lambda p: reasons) if isinstance(reasons, str) else (lambda p: reasons.get(p, ""))
    row = lambda p: F.struct(F.lit(step).alias("step"), F.lit(p).alias("path"), _spelled(F.col(f"b.{p}"), old[p]).alias("before"), _spelled(F.col(f"a.{p}"), new[p]).alias("after"), F.lit(reason(p)).alias("reason"))
    rows = F.array(*(row(p) for p in old if p in new))
    return both.select(key, F.inline(F.filter(rows, lambda x: ~x["before"].eqNullSafe(x["after"]))))


def replayed(records: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """The records after all changes of a log; the last step counts where several change a path. Columns as given."""
    last = log.groupBy(key, "path").agg(F.max_by("after", "step").alias("after"))
    by_path = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "after"))).alias("_changes"))
    joined = records.join(by_shuffle(by_path), key, "left").where(~F.coalesce(F.map_contains_key("_changes", F.lit(MERGED)), F.lit(False)))

    def value(path: str, kind: T.DataType) -> Column:
        return F.when(F.map_contains_key("_changes", F.lit(path)), _read(F.col("_changes")[path], kind)).otherwise(F.col(path))

    def column(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StructType):
            return F.struct(*(value(f"{f.name}.{g.name}", g.dataType).alias(g.name) for g in f.dataType.fields)).alias(f.name)
        return value(f.name, f.dataType).alias(f.name)

    return joined.select(*(F.col(key) if f.name == key else column(f) for f in records.schema.fields))


def repaired_plans(records: DataFrame) -> DataFrame:
    """Records with the code that their own code, text, file name and regions vote for, and its period, in columns code and period; column repaired is that vote.

    A valid code of a record corrected by hand stays. text and region_text may be missing.
    """
    source = records.withColumns({c: text(c) if c in records.columns else F.lit("") for c in ("text", "region_text")})
    votes = repaired_codes(source.select("id", "code", "text", "file_name", "region_text"), ["id"])
    take = (text("repaired") != "") & ~(F.coalesce("manual", F.lit(False)) & is_plan_code("code"))
    period = F.when(take, period_of("repaired")).when(is_plan_code("code"), F.coalesce(F.nullif(text("period"), F.lit("")), period_of("code"))).otherwise(F.col("period"))
    out = records.join(by_shuffle(votes), "id", "left")
    return out.withColumns({"period": period, "code": F.when(take, F.col("repaired")).otherwise(F.col("code"))})


def audited_plans(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (unique ids) cleaned, their codes repaired and duplicates merged, and the log of it: step 1 cleaning, 2 codes, 3 merging."""
    cleaned = materialize(improved_plans(records), "cleaned")
    coded = materialize(repaired_plans(cleaned).select(*records.columns), "coded")
    out = materialize(merged_plans(coded), "merged")
    gone = out.select(F.col("id").alias("kept"), F.explode("merged_ids").alias("id")).where("id <> kept")
    gone = gone.select("id", F.lit(3).alias("step"), F.lit(MERGED).alias("path"), F.col("id").cast("string").alias("before"), F.col("kept").cast("string").alias("after"), F.lit("duplicate").alias("reason"))
    steps = change_log(records, cleaned, 1, REASONS).unionByName(change_log(cleaned, coded, 2, REASONS)).unionByName(change_log(coded, out, 3, "taken from a duplicate"))
    return out, steps.unionByName(gone)
