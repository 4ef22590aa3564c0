"""Corrections by hand addressed by path: rows (id, seq, path, value) folded into nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import period_of
from ..functions.text import normalize, split_list, text
from .merging import SETTLED, improved_plans, stored_evaluation
from .processing import TRAINING
from .validation import DIAGNOSIS

# What the paths of a record's fields are called.
SCALARS = {
    "docente.nombre": "name", "docente.carrera": "career", "docente.nivel_academico_actual": "level", "docente.codigo_documento": "code", "docente.periodo_plan": "period",
    "detalles_plan.impacto_esperado": "impact", "detalles_plan.vision_largo_plazo": "vision",
}
LISTS = {"detalles_plan.actividades_teoricas": "theory", "detalles_plan.actividades_practicas": "practice"}
ROWS, CELLS = "capacitaciones", {"nombre": "name", "horas": "hours", "fecha_inicio_propuesta": "start", "fecha_fin_propuesta": "end", "tipo": "kind"}
#: A training, or one of its cells; rows are counted from nought.
ROW_PATH = rf"\A{ROWS}\.([0-9]{{1,3}})(?:\.({'|'.join(CELLS)}))?\z"


def known_path(path: Column) -> Column:
    """Whether a path names something that can be corrected. A whole training can only be taken out, by a value that is empty."""
    return path.isin(*SCALARS, *LISTS, *(f"diagnostico.{k}" for k in DIAGNOSIS)) | path.rlike(ROW_PATH)


def _typed(value: Column) -> Column:
    return F.trim(F.regexp_replace(text(value), r"\r\n?", "\n"))


def _corrected_rows() -> Column:
    """Trainings with corrected cells, without those taken out, and with new ones where a path stands beyond the last; _edits maps path to value."""
    given = F.coalesce("trainings", F.array().cast(TRAINING))
    named = F.filter(F.map_keys("_edits"), lambda p: p.rlike(ROW_PATH))
    places = F.transform(named, lambda p: F.regexp_extract(p, ROW_PATH, 1).cast("int"))
    own = F.when(F.size(given) > 0, F.sequence(F.lit(0), F.size(given) - 1)).otherwise(F.array().cast("array<int>"))
    path = lambda i, *more: F.concat_ws(".", F.lit(ROWS), i.cast("string"), *map(F.lit, more))
    edited = lambda p: F.map_contains_key("_edits", p)
    out = lambda i: F.coalesce(edited(path(i)) & (F.try_element_at("_edits", path(i)) == ""), F.lit(False))

    def row(i: Column) -> Column:
        old = F.get(given, i)
        new = lambda cell: F.try_element_at("_edits", path(i, cell))
        cells = {c: F.when(edited(path(i, cell)), new(cell)).otherwise(text(old[c])) for cell, c in CELLS.items() if c != "hours"}
        hours = F.when(edited(path(i, "horas")), F.greatest(F.lit(0.0), F.coalesce(F.replace(new("horas"), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)))).otherwise(F.coalesce(old["hours"], F.lit(0.0)))
        return F.struct(cells["name"].alias("name"), hours.alias("hours"), *(cells[c].alias(c) for c in ("start", "end", "kind")))

    places = F.filter(F.array_sort(F.array_distinct(F.concat(own, places))), lambda i: ~out(i))
    return F.filter(F.transform(places, row), lambda r: (r["name"] != "") | (r["hours"] > 0) | (r["start"] != "") | (r["end"] != "") | (r["kind"] != "")).cast(TRAINING)


def corrected_by_path(store: DataFrame, edits: DataFrame, as_of_year: int) -> DataFrame:
    """The store after corrections by hand, evaluated again: the store's columns, n_edits, rejected (paths that name nothing), issues, confidence, status and detail.

    store: records as merging has them; edits: id, seq, path, value (texts). Of several edits of a path
    the last counts (seq, then value). Values are trimmed, lists cut at lines and bars, hours not below
    nought; a period left empty is that of the code. Edited records are cleaned as a reading is, and
    locked from then on; remarks that a correction settles go. Ids that are not stored have no effect;
    records without a known path stay as they are. Null paths are rejected as ''.
    """
    last = edits.where(F.col("id").isNotNull()).select("id", text("path").alias("path"), F.struct("seq", _typed(F.col("value")).alias("value")).alias("x")).groupBy("id", "path").agg(F.max("x").alias("x")).withColumn("known", known_path(F.col("path")))
    entries = F.collect_list(F.when(F.col("known"), F.struct("path", F.col("x.value").alias("value"))))
    by_id = last.groupBy("id").agg(F.map_from_entries(entries).alias("_edits"), F.array_sort(F.collect_list(F.when(~F.col("known"), F.col("path")))).alias("rejected"))
    joined = store.join(by_id, "id", "left").withColumn("n_edits", F.coalesce(F.size("_edits"), F.lit(0))).withColumn("rejected", F.coalesce("rejected", F.array().cast("array<string>")))
    given = joined.withColumn("n_edits", F.when(F.col("_edits").isNull(), 0).otherwise(F.col("n_edits")))
    value = lambda p, c: F.when(F.map_contains_key("_edits", F.lit(p)), F.col("_edits")[p]).otherwise(text(c))
    new = {c: value(p, c) for p, c in SCALARS.items()}
    new |= {c: F.when(F.map_contains_key("_edits", F.lit(p)), split_list(F.col("_edits")[p])).otherwise(F.col(c)) for p, c in LISTS.items()}
    new["period"] = F.coalesce(F.nullif(new["period"], F.lit("")), period_of(new["code"]))
    new |= {"diagnosis": F.struct(*(value(f"diagnostico.{k}", f"diagnosis.{k}").alias(k) for k in DIAGNOSIS)), "trainings": _corrected_rows(), "manual": F.lit(True)}
    if "remarks" in store.columns:
        new["remarks"] = F.filter("remarks", lambda r: ~normalize(r).rlike("|".join(SETTLED)))
    changed = improved_plans(given.where("n_edits > 0").withColumns(new).drop("_edits"))
    return stored_evaluation(given.where("n_edits = 0").drop("_edits").unionByName(changed), as_of_year)
