"""Stored plan records: duplicates merged into one record, batches taken in, corrections by hand.

records: id, seq (order), hash, file_name, manual, name, career, level, code, period (strings),
diagnosis (struct), trainings (array of struct name, hours, start, end, kind), theory, practice
(array<string>), impact, vision.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaners import is_alias_file, is_true, is_useful_plan, teacher_name, training_name
from ..functions.codes import is_plan_code, period_of
from ..functions.quality import text_quality, value_score
from ..functions.text import clean, normalize, text
from ..shared import by_shuffle
from .groups import per_group_stream
from .linkage import canonical_match
from .processing import CAREERS, TRAINING, evaluated_plans
from .records import consolidated_all, edit_ratio
from .validation import DIAGNOSIS

# When rows of two records are one, what the same place adds, and when a left-over row repeats one.
SAME_ROW, SAME_PLACE, REPEATED_ROW = 0.55, 0.18, 0.82
#: How much better a value must be to replace the one of the better record.
BETTER = 2
NAMED = ("name", "career", "level", "impact", "vision")
ROW = ("name", "start", "end", "kind")
#: Remarks that a correction by hand settles (normalized).
SETTLED = ("requiere confirmacion manual", "no corresponde a un plan individual")


def _value(c: Column) -> Column:
    """A value with what choosing between two needs."""
    return F.struct(text(c).alias("v"), text_quality(c).alias("q"), value_score(c).alias("s"), clean(c).alias("c"))


def _prepared(records: DataFrame) -> DataFrame:
    """Records with qualities and keys worked out by Spark, so that merging only compares numbers and keys."""
    row = lambda t: F.struct(*(_value(training_name(t["name"]) if k == "name" else t[k]).alias(k) for k in ROW), F.coalesce(t["hours"], F.lit(0.0)).alias("hours"), normalize(training_name(t["name"])).alias("key"))
    items = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(clean(x).alias("v"), normalize(x).alias("key")))
    return records.select(
        "id", "seq", text("file_name").alias("file"), F.coalesce(F.nullif(text("hash"), F.lit("")), normalize("file_name")).alias("file_key"), F.coalesce("manual", F.lit(False)).alias("manual"),
        F.struct(*(_value(F.col(k)).alias(k) for k in NAMED), *(_value(F.col(f"diagnosis.{k}")).alias(k) for k in DIAGNOSIS)).alias("values"),
        text("code").alias("code"), is_plan_code("code").alias("valid"), text("period").alias("period"), period_of("code").alias("of_code"),
        F.transform(F.coalesce("trainings", F.array().cast(TRAINING)), row).alias("rows"), *(items(F.col(k)).alias(k) for k in ("theory", "practice")),
    )


def quality(r: dict) -> int:
    """Quality of a prepared record: a correction by hand above all, then a valid code, filled fields and rows."""
    score = 1000 * bool(r["manual"]) + 120 * bool(r["valid"]) + 30 * bool(r["period"]) + r["values"]["name"]["s"] + r["values"]["career"]["s"]
    score += sum(max(0, r["values"][k]["q"]) for k in DIAGNOSIS)
    return score + sum(max(0, t["name"]["q"]) + 10 * (t["hours"] > 0) + sum(t[k]["s"] for k in ("start", "end", "kind")) for t in r["rows"])


def chosen(a: dict, b: dict, locked: bool) -> dict:
    """a, unless it is empty, or unlocked and clearly worse than b."""
    return b if not a["c"] or (b["c"] and not locked and b["q"] > a["q"] + BETTER) else a


def merged_rows(a: list[dict], b: list[dict], locked: bool) -> list[dict]:
    """Training rows of two records: each of a takes its best free match in b; complete rows of b that repeat none follow."""
    used, out = set(), []
    for i, row in enumerate(a):
        scores = [(edit_ratio(row["key"], other["key"]) + (SAME_PLACE if i == j else 0.0), -j) for j, other in enumerate(b) if j not in used]
        best, at = max(scores, default=(0.0, 0))
        if best >= SAME_ROW:
            used.add(-at)
            other = b[-at]
            row = {**{k: chosen(row[k], other[k], locked) for k in ROW}, "hours": row["hours"] or (0.0 if locked else other["hours"]), "key": row["key"]}
        out.append(row)
    for j, other in enumerate(b):
        complete = sum(bool(other[k]["c"]) for k in ROW) + (other["hours"] > 0)
        if j not in used and complete >= 2 and all(edit_ratio(r["key"], other["key"]) < REPEATED_ROW for r in out):
            out.append(other)
    return out


def united(*lists: list[dict]) -> list[dict]:
    """Items of all lists, those of equal keys once."""
    return list({x["key"]: x for items in reversed(lists) for x in reversed(items) if x["key"]}.values())[::-1]


def merged(a: dict, b: dict) -> dict:
    """One record out of two, a being the earlier one; the better one leads, and a record corrected by hand keeps its values."""
    lead, other = (a, b) if quality(a) >= quality(b) else (b, a)
    locked = bool(lead["manual"])
    out = dict(lead, id=a["id"], values={k: chosen(lead["values"][k], other["values"][k], locked) for k in lead["values"]})
    if not lead["valid"] and other["valid"]:
        out |= {k: other[k] for k in ("code", "valid", "of_code")}
    out["period"] = lead["period"] or out["of_code"] or other["period"]
    out["rows"] = merged_rows(lead["rows"], other["rows"], locked)
    for k in ("theory", "practice"):
        out[k] = united(lead[k], other[k])
    return out | {"manual": lead["manual"] or other["manual"], "n_records": a["n_records"] + b["n_records"]}


def matchable(records: DataFrame, *more: str) -> DataFrame:
    """What consolidation compares of records; more: columns to carry along."""
    keyed = records.withColumns({"career": F.coalesce("career", F.lit("")), "alias": is_alias_file("file_name")})
    return keyed.withColumn("trainings", F.transform("trainings", lambda t: training_name(t["name"]))).select("id", "seq", "hash", "code", "period", "name", "career", "trainings", "alias", *more)


def merged_plans(records: DataFrame) -> DataFrame:
    """One record for each group of duplicates, under the id of the first: the records' columns, files (names of all), merged_ids (those of all) and n_records.

    Duplicates are found by :func:`records.consolidated_all`; the records of one group are merged in
    order, one after another: a task holds one record of a group, however often a document was read.
    """
    return merged_by(records, consolidated_all(matchable(records)))


def merged_by(records: DataFrame, found: DataFrame) -> DataFrame:
    """As :func:`merged_plans`, for groups that are known: found (id, kept_id)."""
    rows = _prepared(records).join(by_shuffle(found), "id")
    id_type = records.schema["id"].dataType
    kind = T._parse_datatype_string(f"manual boolean, {', '.join(f'{k} string' for k in NAMED)}, code string, period string, diagnosis struct<{','.join(f'{k}:string' for k in DIAGNOSIS)}>, trainings {TRAINING}, theory array<string>, practice array<string>, files array<string>, n_records int")

    def folded(group: Iterator[dict]) -> Iterator[dict]:
        out, files, ids = None, {}, []
        for r in group:
            files.setdefault(r["file_key"], r["file"])
            ids.append(r["id"])
            r = dict(r, n_records=1)
            out = r if out is None else merged(out, r)
        named = {k: x["v"] for k, x in out["values"].items()}
        trainings = [{**{k: t[k]["v"] for k in ROW}, "hours": t["hours"]} for t in out["rows"]]
        lists = {k: [x["v"] for x in united(out[k])] for k in ("theory", "practice")} | {"files": [v for k, v in files.items() if k]}
        yield {"id": out["id"], "merged_ids": ids, **{k: out[k] for k in ("manual", "code", "period", "n_records")}, **{k: named[k] for k in NAMED}, "diagnosis": {k: named[k] for k in DIAGNOSIS}, "trainings": trainings, **lists}

    return per_group_stream(rows, ["kept_id"], ["seq"], folded, T.StructType([T.StructField("id", id_type), *kind.fields, T.StructField("merged_ids", T.ArrayType(id_type))]))


def upserted_plans(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after a batch, and action: stored (untouched), updated or inserted. Both: records; a batch's come after the store's.

    A new record joins the stored one that it repeats; what is stored twice is merged, too. Ids must be
    unique over both.
    """
    last = store.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    later = batch.withColumn("seq", F.col("seq") + last)
    both = store.withColumn("new", F.lit(False)).unionByName(later.withColumn("new", F.lit(True)))
    marks = both.select("id", F.col("new").alias("first_new"))
    out = merged_plans(both.drop("new")).join(by_shuffle(marks), "id")
    return out.withColumn("action", F.when(F.col("first_new"), "inserted").when(F.col("n_records") > 1, "updated").otherwise("stored")).drop("first_new")


def improved_plans(records: DataFrame) -> DataFrame:
    """Records as a later version would read them: names and careers cleaned, the period of a valid code filled in. For stores of an earlier version."""
    named = canonical_match(records.withColumn("own", F.col("name")).withColumn("name", F.col("career")), CAREERS).withColumn("career", F.col("canonical")).withColumn("name", teacher_name("own")).drop("own", "canonical")
    return named.withColumn("period", F.when(is_plan_code("code"), F.coalesce(F.nullif(text("period"), F.lit("")), period_of("code"))).otherwise(F.col("period"))).select(*records.columns)


def corrected_plans(store: DataFrame, edits: DataFrame) -> DataFrame:
    """The store with records corrected by hand. edits: id and the corrected name, career, level, code, period and remarks of the record (array<string>, those that the correction settles go).

    Values are trimmed; an empty period is that of the code. Records without an edit stay; edits of
    unknown ids have no effect.
    """
    fields = ("name", "career", "level", "code", "period")
    trimmed = {k: F.trim(F.regexp_replace(text(k), r"\r\n?", "\n")) for k in fields}
    new = edits.select("id", *(v.alias(f"n_{k}") for k, v in trimmed.items()), F.lit(True).alias("edited")).withColumn("n_period", F.coalesce(F.nullif("n_period", F.lit("")), period_of("n_code")))
    out = store.join(new, "id", "left").withColumn("edited", F.coalesce("edited", F.lit(False)))
    settled = lambda r: normalize(r).rlike("|".join(SETTLED))
    changed = {k: F.when(F.col("edited"), F.col(f"n_{k}")).otherwise(F.col(k)) for k in fields}
    changed["manual"] = F.col("edited") | F.col("manual")
    if "remarks" in store.columns:
        changed["remarks"] = F.when(F.col("edited"), F.filter("remarks", lambda r: ~settled(r))).otherwise(F.col("remarks"))
    return out.withColumns(changed).select(*store.columns)


def corrected_agreements(store: DataFrame, edits: DataFrame, options: DataFrame) -> DataFrame:
    """Agreements corrected by hand: id, code, period, option_id, plan_id, training, linked, total, partial, percent, manual.

    edits: id, code, period, option_id, plan_id, training, total, partial, percent as typed. A chosen
    option (option_id, plan_id, training of options) gives plan and training; without partial funding
    there is no percentage.
    """
    trim = lambda c: F.trim(text(c))
    new = edits.select("id", *(trim(c).alias(f"n_{c}") for c in ("code", "period", "option_id", "plan_id", "training", "percent")), is_true("total").alias("n_total"), is_true("partial").alias("n_partial"), F.lit(True).alias("edited"))
    chosen_ = options.select(F.col("option_id").alias("n_option_id"), F.col("plan_id").cast("string").alias("o_plan"), F.col("training").alias("o_training"))
    new = new.join(chosen_, "n_option_id", "left").withColumns({
        "n_period": F.coalesce(F.nullif("n_period", F.lit("")), period_of("n_code")), "n_plan_id": F.coalesce("o_plan", "n_plan_id"), "n_training": F.coalesce("o_training", "n_training"),
        "n_percent": F.when(F.col("n_partial"), F.replace("n_percent", F.lit(","), F.lit("."))).otherwise(""), "n_linked": F.col("n_option_id") != "", "n_manual": F.lit(True),
    })
    out = store.join(new, "id", "left")
    fields = ("code", "period", "option_id", "plan_id", "training", "linked", "total", "partial", "percent", "manual")
    return out.select("id", *(F.when(F.col("edited"), F.col(f"n_{k}")).otherwise(F.col(k)).alias(k) for k in fields))


def stored_evaluation(records: DataFrame, as_of_year: int) -> DataFrame:
    """Records of a store evaluated as they stand: issues, confidence, status and detail; what holds neither a plan's data nor a correction by hand is NO_ES_PLAN."""
    useful = is_useful_plan(F.col("name"), F.col("career"), F.array(*(F.col(f"diagnosis.{k}") for k in DIAGNOSIS)), F.col("trainings"))
    about = {"template": F.when(is_plan_code("code"), "MODERNA").otherwise("DESCONOCIDA"), "expected_rows": F.size("trainings"), "engines": F.lit(1), "signal": F.lit(0), "useful": useful | F.coalesce("manual", F.lit(False))}
    return evaluated_plans(records.drop("issues", "confidence", "status", "detail").withColumns(about), as_of_year)


def stored_plans(records: DataFrame, as_of_year: int) -> DataFrame:
    """The records of a store merged and evaluated (:func:`stored_evaluation`)."""
    return stored_evaluation(merged_plans(records), as_of_year)
