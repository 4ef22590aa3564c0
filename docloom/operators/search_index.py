"""Substring search by an index: postings of grams, the rarest lists of a needle intersected, hits verified.

The index has the distinct grams of one to GRAM characters of every row's search text. A needle of so
many characters or fewer is one gram, whose list is its answer; a longer one intersects the lists of
its LISTS rarest grams, and the rows left are checked against the whole text. Case does not matter,
accents do, as in views.search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..shared import by_shuffle

GRAM, LISTS = 3, 4


def search_texts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, hay: what is searched, the fields joined by blanks, in lower case."""
    return rows.select(key, F.lower(F.concat_ws(" ", *(text(f) for f in fields))).alias("hay"))


def _grams(column: str, shortest: int):
    """Distinct grams of a text, of shortest to GRAM characters."""
    of = lambda n: F.transform(F.when(F.length(column) >= n, F.sequence(F.lit(1), F.length(column) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col(column), i, F.lit(n)))
    return F.array_distinct(F.concat(*(of(n) for n in range(shortest, GRAM + 1))))


def postings(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(gram, key) of every text of :func:`search_texts`, and (gram, df): how many rows hold a gram."""
    lists = texts.select(F.explode(_grams("hay", 1)).alias("gram"), key)
    return lists, lists.groupBy("gram").agg(F.count("*").alias("df"))


def search_all(texts: DataFrame, lists: DataFrame, frequencies: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """(needle, key): the rows that hold each needle. needles: column needle; trimmed, in lower case, repeats once; empty ones match every row and are left to the caller, as are nulls."""
    wanted = needles.select(F.lower(F.trim("needle")).alias("needle")).where(F.coalesce(F.length("needle"), F.lit(0)) > 0).distinct()
    grams = wanted.select("needle", F.explode(F.when(F.length("needle") <= GRAM, F.array("needle")).otherwise(_grams("needle", GRAM))).alias("gram"))
    rated = grams.join(by_shuffle(frequencies), "gram", "left").groupBy("needle").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("x"))
    rated = rated.where(F.get("x", 0)["df"] > 0)  # a gram that no row has ends the search
    chosen = rated.select("needle", F.least(F.size("x"), F.lit(LISTS)).alias("n"), F.explode(F.slice("x", 1, LISTS)).alias("g")).select("needle", "n", "g.gram")
    met = chosen.join(by_shuffle(lists), "gram").groupBy("needle", key).agg(F.count("*").alias("met"), F.first("n").alias("n")).where("met = n")
    whole = met.where(F.length("needle") <= GRAM).select("needle", key)
    checked = met.where(F.length("needle") > GRAM).join(by_shuffle(texts), key).where(F.contains("hay", "needle")).select("needle", key)
    return whole.union(checked)
