"""What page regions add to a record: scores of competing OCR passes, shared activities, rectangles, record keys."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import MONTHS
from ..functions.text import clean, let, normalize, number, split_list, text
from .extraction import KIND_WORDS

# Tokens that stand for each other when activities are matched to trainings.
ACTIVITY_ALIASES = [
    ("hacking", "ciberseguridad", "seguridad", "ethical"),
    ("inteligencia", "artificial", "generativa", "ia"),
    ("apa", "normas", "gamificacion"),
    ("valores", "habilidades", "blandas", "educativos"),
    ("fibra", "optica", "ftth", "otdr"),
    ("programacion", "software", "codigo", "desarrollo"),
]


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def table_score(c: Column | str, n_words: Column | int | None = None) -> Column:
    """How much a region looks like the training table: row numbers, kinds, dates and months, numbers, words (n_words: its word boxes, else the words of its text)."""
    words = word_count(clean(c)) if n_words is None else n_words if isinstance(n_words, Column) else F.lit(n_words)
    return let(normalize(c), lambda key: table_score_of_key(key, words))


def word_count(cleaned: Column) -> Column:
    """Words of a cleaned text."""
    return _count(cleaned, r"\S++")


def table_score_of_key(key: Column, words: Column) -> Column:
    """:func:`table_score` of a normalized text, whose words stand behind one blank each but for the first."""
    kinds = "|".join(k.replace("Ó", "O").lower() for k in KIND_WORDS if k != "CAPACITACIÓN")

    def scored(behind: Column) -> Column:
        numbers, hours = _count(behind, " [0-9]{1,2}(?= )"), _count(behind, r" [0-9]{1,4}(?= |\z)")
        dates = _count(behind, " (?:desde|hasta|" + "|".join(MONTHS) + r")(?= |\z)")
        score = numbers * 4 + _count(behind, rf" (?:{kinds})(?= |\z)") * 5 + dates * 2 + F.least(F.lit(12), hours)
        return F.when(key == "", 0.0).otherwise(score + F.least(F.lit(15.0), words / 8))

    return let(F.concat(F.lit(" "), key), scored)


def activity_score(c: Column | str) -> Column:
    """How much a region looks like an activity section: its length, and both of its headings."""
    return let(normalize(c), activity_score_of_key)


def activity_score_of_key(key: Column) -> Column:
    """:func:`activity_score` of a normalized text."""
    half = lambda word: F.when(key.contains(word), 8).otherwise(0)
    return F.when(key == "", 0.0).otherwise(F.least(F.lit(20.0), F.length(key) / 30) + half("teorica") + half("practica"))


def best_pass(passes: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The best reading of each region; the earliest pass (column pass) wins ties."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), "pass"))
    return passes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _best_fitting(groups: list[tuple[str, ...]]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """For each of some normalized names the place of the normalized activity that shares most with it (tokens, alias groups), the first on ties; -1 where none shares anything."""

    def expanded(key: str) -> frozenset[str]:
        found = {t for t in key.split() if len(t) > 1}
        for group in groups:
            if not found.isdisjoint(group):
                found.update(group)
        return frozenset(found)

    def best(names: pa.Array, activities: pa.Array) -> pa.Array:
        known: dict[str, frozenset[str]] = {}  # texts of this batch, most of which come again

        def tokens_of(key: str) -> frozenset[str]:
            if key not in known:
                known[key] = expanded(key)
            return known[key]

        def places(own: list[str], listed: list[str]) -> list[int]:
            holding: dict[str, list[int]] = {}
            for i, key in enumerate(listed):
                for t in tokens_of(key):
                    holding.setdefault(t, []).append(i)
            out = []
            for key in own:
                scores: dict[int, int] = {}
                for t in tokens_of(key):
                    for i in holding.get(t, ()):
                        scores[i] = scores.get(i, 0) + (1 if len(t) <= 2 else 2)
                out.append(min(scores, key=lambda i: (-scores[i], i)) if scores else -1)
            return out

        rows = zip(names.to_pylist(), activities.to_pylist())
        return pa.array((None if own is None else places(own, listed or []) for own, listed in rows), pa.list_(pa.int32()))

    return best


def assigned_activities(trainings: Column, activities: Column, groups: list[tuple[str, ...]] | None = None) -> Column:
    """For each training (struct with name) struct(items, shared): the activity that fits best, the first on ties; all of them, marked as shared, where none fits."""
    best = F.arrow_udf(_best_fitting(ACTIVITY_ALIASES if groups is None else groups), T.ArrayType(T.IntegerType()))
    found = best(F.transform(trainings, lambda t: normalize(t["name"])), F.transform(activities, normalize))
    return F.transform(found, lambda k: F.when(k >= 0, F.struct(F.array(F.get(activities, k)).alias("items"), F.lit(False).alias("shared"))).otherwise(F.struct(activities.alias("items"), F.lit(True).alias("shared"))))


def training_activities(trainings: Column, listed: Column, groups: list[tuple[str, ...]] | None = None) -> Column:
    """For each training struct(theory, practice, shared): what fits it of both lists (listed: struct of theory and practice), by :func:`assigned_activities`; shared where one of the two lists is."""
    row = lambda t, p: F.struct(t["items"].alias("theory"), p["items"].alias("practice"), (t["shared"] | p["shared"]).alias("shared"))
    return F.zip_with(assigned_activities(trainings, listed["theory"], groups), assigned_activities(trainings, listed["practice"], groups), row)


def clamped(left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """A rectangle inside its page; at least one unit wide and high."""
    x, y = F.greatest(F.lit(0.0), F.least(left, page_width - 1)), F.greatest(F.lit(0.0), F.least(top, page_height - 1))
    return F.struct(x.alias("left"), y.alias("top"), F.greatest(F.lit(1.0), F.least(width, page_width - x)).alias("width"), F.greatest(F.lit(1.0), F.least(height, page_height - y)).alias("height"))


def by_ratio(page_width: Column, page_height: Column, left: float, top: float, width: float, height: float) -> Column:
    """A rectangle given as shares of its page."""
    return F.struct((page_width * left).alias("left"), (page_height * top).alias("top"), (page_width * width).alias("width"), (page_height * height).alias("height"))


def record_key(name: Column, code: Column, file_name: Column) -> Column:
    """Key of a record in a list: its name and its code, else its file."""
    return F.concat_ws("|", normalize(name), F.coalesce(F.nullif(normalize(code), F.lit("")), normalize(file_name)))


def manual_training(name: Column, hours: Column, start: Column, end: Column, kind: Column, theory: Column, practice: Column) -> Column:
    """A training row typed by hand: texts trimmed, hours not below zero, lists split."""
    return F.struct(F.trim(text(name)).alias("name"), F.greatest(F.lit(0.0), F.coalesce(number(text(hours), "double"), F.lit(0.0))).alias("hours"), F.trim(text(start)).alias("start"), F.trim(text(end)).alias("end"), F.trim(text(kind)).alias("kind"), split_list(theory).alias("theory"), split_list(practice).alias("practice"))
