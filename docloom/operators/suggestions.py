"""Suggested values merged into nested records: cell by cell, only where a value is empty or has a problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, text
from .corrections import CELLS, LISTS, ROWS, SCALARS
from .processing import TRAINING
from .validation import DIAGNOSIS, ERROR

_DETAILS = "detalles_plan."


def has_problem(path: Column) -> Column:
    """Whether column issues has an error at a path. One at a training's own detail counts for the plan's detail of that name, too."""
    field = F.element_at(F.split(path, r"\."), -1)
    return F.exists("issues", lambda x: (x["severity"] == ERROR) & ((x["path"] == path) | (path.startswith(_DETAILS) & x["path"].endswith(F.concat(F.lit("."), field)))))


def _takes(current: Column, proposed: Column, path: Column) -> Column:
    """Whether the proposed text replaces the current one."""
    return (clean(proposed) != "") & ((clean(current) == "") | has_problem(path))


def with_suggestions(records: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Records after suggestions; columns as given, and taken: the paths of all values that were taken over.

    records: as validation leaves them (issues); suggestions: id and any of the records' columns, null
    where nothing is proposed. A text is taken where the record's own is empty or has an error; hours
    where they are nought or have an error; the rows of a table by their place, all of them where the
    record has none; a list where the own one is empty or has an error. Suggested rows beyond the
    record's last are left out; ids must be unique in suggestions; unknown ids have no effect.
    """
    proposed = [c for c in suggestions.columns if c != "id"]
    joined = records.join(suggestions.select("id", F.struct(*proposed).alias("_s"), F.lit(True).alias("_any")), "id", "left")
    kind = dict(records.dtypes)
    s = lambda c: F.col(f"_s.{c}") if c.split(".")[0] in proposed else F.lit(None).cast("string")
    paths = {**SCALARS, **{f"diagnostico.{k}": f"diagnosis.{k}" for k in DIAGNOSIS}}
    takes = {c: _takes(F.col(c), s(c), F.lit(p)) for p, c in paths.items() if c.split(".")[0] in kind}
    value = lambda c: F.when(takes[c], s(c)).otherwise(F.col(c))
    new = {c: value(c) for c in takes if "." not in c}
    new["diagnosis"] = F.struct(*(value(f"diagnosis.{k}").alias(k) for k in DIAGNOSIS))
    taken = [F.when(t, F.lit(next(p for p, x in paths.items() if x == c))) for c, t in takes.items()]
    for p, c in LISTS.items():
        items = F.filter(F.transform(F.col(f"_s.{c}"), lambda x: clean(x)), lambda x: x != "") if c in proposed else F.array().cast("array<string>")
        take = (F.coalesce(F.size(F.col(f"_s.{c}")), F.lit(0)) > 0 if c in proposed else F.lit(False)) & ((F.coalesce(F.size(c), F.lit(0)) <= 0) | has_problem(F.lit(p)))
        new[c] = F.when(take, items).otherwise(F.col(c))
        taken.append(F.when(take, F.lit(p)))
    if "trainings" in proposed:
        given, offered = F.coalesce("trainings", F.array().cast(TRAINING)), F.coalesce(F.col("_s.trainings"), F.array().cast(TRAINING))
        path = lambda i, cell: F.concat(F.lit(f"{ROWS}."), i.cast("string"), F.lit(f".{cell}"))
        hours = lambda t: F.coalesce(t["hours"], F.lit(0.0))
        takes_hours = lambda t, o, i: (hours(o) > 0) & ((hours(t) == 0) | has_problem(path(i, "horas")))

        def row(t: Column, i: Column) -> Column:
            o = F.get(offered, i)
            cells = {c: F.when(_takes(t[c], o[c], path(i, cell)), o[c]).otherwise(text(t[c])) for cell, c in CELLS.items() if c != "hours"}
            return F.struct(cells["name"].alias("name"), F.when(takes_hours(t, o, i), hours(o)).otherwise(hours(t)).alias("hours"), *(cells[c].alias(c) for c in ("start", "end", "kind")))

        def of_row(t: Column, i: Column) -> Column:
            o = F.get(offered, i)
            return F.array_compact(F.array(*(F.when(takes_hours(t, o, i) if c == "hours" else _takes(t[c], o[c], path(i, cell)), path(i, cell)) for cell, c in CELLS.items())))

        whole = (F.size(given) == 0) & (F.size(offered) > 0)
        fresh = F.transform(offered, lambda o: F.struct(clean(o["name"]).alias("name"), hours(o).alias("hours"), *(clean(o[c]).alias(c) for c in ("start", "end", "kind"))))
        new["trainings"] = F.when(whole, fresh).otherwise(F.transform(given, row)).cast(TRAINING)
        rows_taken = F.when(whole, F.array(F.lit(ROWS))).otherwise(F.flatten(F.transform(given, of_row)))
    else:
        rows_taken = F.array().cast("array<string>")
    new["taken"] = F.concat(F.array_compact(F.array(*taken)), rows_taken)
    changed = joined.where(F.coalesce("_any", F.lit(False))).withColumns(new).select(*records.columns, "taken")
    same = joined.where(F.col("_any").isNull()).withColumn("taken", F.array().cast("array<string>")).select(*records.columns, "taken")
    return changed.unionByName(same)
