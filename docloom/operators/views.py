"""Search, key figures and flat export views over plans and agreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_list, text

REVIEW, COMPLETE, FAILED = "REVISAR", "COMPLETO", "ERROR"
NOT_A_PLAN = ("NO_ES_PLAN", "NO_ES_ACUERDO")


def status_filter(status: Column, wanted: str) -> Column:
    """Rows of a status; ERROR takes in documents of another kind, '' takes all."""
    if not wanted:
        return F.lit(True)
    return status.isin(FAILED, *NOT_A_PLAN) if wanted == FAILED else status == wanted


def search(rows: DataFrame, query: str, fields: list[str], status: str = "") -> DataFrame:
    """Rows whose fields, joined by blanks, hold the query; case does not matter, accents do."""
    hay = F.lower(F.concat_ws(" ", *(text(f) for f in fields)))
    return rows.where(F.contains(hay, F.lit(query.lower().strip())) & status_filter(F.col("status"), status))


def status_label(status: Column) -> Column:
    return F.when(status == COMPLETE, "Completo").when(status == REVIEW, "Revisar").otherwise("Error")


def state_class(state: Column) -> Column:
    """Class of an agreement by its state."""
    return F.when(state == "FIRMADO", "signed").when(state == "ANULADO", "cancelled").otherwise("pending")


def summary(rows: DataFrame, items: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row: how many rows, by status, and of items (an array column) in all; extra: further conditions to count."""
    n = lambda c: F.count(F.when(c, 1))
    status = F.col("status")
    figures = [F.count("*").alias("total"), n(status == COMPLETE).alias("complete"), n(status == REVIEW).alias("review"), n(status.isin(FAILED, *NOT_A_PLAN)).alias("failed")]
    if items:
        figures.append(F.coalesce(F.sum(F.greatest(F.size(items), F.lit(0))), F.lit(0)).alias("items"))
    return rows.agg(*figures, *(n(c).alias(name) for name, c in (extra or {}).items()))


def multi_level_figures(rows: DataFrame, levels: list[str], figures: dict[str, Column], grouping_sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Key figures of every level in one pass: levels, grouping_id (a bit for each level that is summed over, the first level's the highest) and figures (aggregates by name, distinct counts included).

    By default levels roll up from the last to the first and to all; grouping_sets names others. A null
    of a level is told from a sum over it by grouping_id alone. Without rows there is the total only.
    """
    grouped = rows.rollup(*levels) if grouping_sets is None else rows.groupingSets([[F.col(c) for c in s] for s in grouping_sets], *levels)
    return grouped.agg(F.grouping_id().alias("grouping_id"), *(v.alias(k) for k, v in figures.items())).select(*levels, F.col("grouping_id").cast("long").alias("grouping_id"), *figures)


def review_tile(figures: DataFrame) -> DataFrame:
    """The tiles of the start page; the one for review counts failures, too."""
    return figures.withColumn("review_tile", F.col("review") + F.col("failed"))


def teachers_view(plans: DataFrame) -> DataFrame:
    """One row for each plan."""
    return plans.select("id", "name", "career", "level", "code", "period", "status", "detail", "confidence", F.size("trainings").alias("n_trainings"), _messages("error").alias("problems"), _messages("warning").alias("warnings"))


def _messages(severity: str) -> Column:
    return join_list(F.transform(F.filter("issues", lambda x: x["severity"] == severity), lambda x: F.concat_ws(":", x["path"], x["kind"])))


def diagnoses_view(plans: DataFrame) -> DataFrame:
    """One row for each plan: the seven answers."""
    return plans.select("id", "name", "diagnosis.*")


def trainings_view(plans: DataFrame) -> DataFrame:
    """One row for each training."""
    rows = plans.select("id", "name", "career", F.posexplode("trainings").alias("pos", "t"))
    return rows.select("id", "name", "career", (F.col("pos") + 1).alias("ordinal"), F.col("t.name").alias("training"), "t.hours", "t.start", "t.end", "t.kind")


def issues_view(plans: DataFrame) -> DataFrame:
    """One row for each issue."""
    found = F.transform("issues", lambda x: x)  # of a plain column Spark asks first whether it is empty, which works it out anew
    return plans.select("id", "name", F.explode(found).alias("x")).select("id", "name", "x.*")


def engines_view(evidence: DataFrame) -> DataFrame:
    """One row for each voted field: value, confidence and the engines that agree."""
    return evidence.select("doc_id", "field", "value", "confidence", "votes", "engines")


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "Sí").otherwise("No")


SUPPORT = ("permiso", "horario", "total", "parcial", "viaticos", "materiales", "otro")


def agreements_view(rows: DataFrame) -> DataFrame:
    """The flat export of agreements: support flags as yes or no."""
    return rows.select("id", "code", "signed_on", "period", "state", "id_number", "name", "career", "position", "training", "plan_id", yes_no(F.col("linked")).alias("linked"), *(yes_no(F.array_contains("support", s)).alias(s) for s in SUPPORT), "percent", "status", "confidence")


def support_labels(support: Column, percent: Column) -> Column:
    """Labels of the flags that hold, in order; partial support shows its percentage."""
    label = lambda s: F.when(F.array_contains(support, s), F.concat(F.lit("parcial "), percent.cast("string"), F.lit("%")) if s == "parcial" else s)
    return F.array_compact(F.array(*map(label, SUPPORT)))
