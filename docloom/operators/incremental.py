"""Consolidation kept up to date: a batch touches the components that it could match, and only these are folded again.

The state is three plain tables: every record ever taken in with its component, the keys under which
records could match (equal hashes, codes and names, and pieces of names that any similar name holds),
and the merged records. Folding the records of a component anew gives what folding all records would
(matches never cross components), so the state equals that of one fold over everything, however the
records were cut into batches, as long as their order is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import by_shuffle, materialize
from .graph import components
from .merging import matchable, merged_by
from .records import consolidated, match_keys, name_grams, name_pieces, possible_links, similar_names

PIECE = "piece"


@dataclass
class State:
    """records: as merging has them, and comp; keys: kind, key, name (of pieces) and comp; merged: as merged_plans gives it, and comp."""

    records: DataFrame
    keys: DataFrame
    merged: DataFrame


def record_keys(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, kind, key, name: a record's hash, code and name, and for each distinct name the pieces by which similar ones find it. known: (piece, times) of names taken in before."""
    keyed = match_keys(records)
    equal = keyed.select("id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("hash", "code", "name"))))).where("key <> ''").withColumn("name", F.lit(""))
    names = keyed.where("name <> ''").groupBy("name").agg(F.min("id").alias("id"))
    pieces = name_pieces(names, known).select("id", F.lit(PIECE).alias("kind"), F.col("piece").alias("key"), "name")
    return equal.unionByName(pieces)


def probed(batch: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b): a batch's records and the stored components that hold a record they could match."""
    keyed = match_keys(batch)
    own = keyed.select("id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("hash", "code", "name"))))).where("key <> ''")
    equal = own.join(by_shuffle(keys.where(F.col("kind") != PIECE)), ["kind", "key"]).select(F.col("id").alias("a"), F.col("comp").alias("b"))
    names = keyed.where("name <> ''").groupBy("name").agg(F.min("id").alias("id"))
    pieces = keys.where(F.col("kind") == PIECE).select(F.col("key").alias("piece"), F.col("name").alias("stored"), "comp")
    near = name_grams(names).join(by_shuffle(pieces), "piece").where(similar_names("name", "stored"))
    return equal.union(near.select(F.col("id").alias("a"), F.col("comp").alias("b"))).distinct()


def _merged(records: DataFrame) -> DataFrame:
    """The merged records of whole components (column comp), and their component."""
    found = materialize(consolidated(matchable(records, "comp"), "comp"), "kept-ids")
    out = merged_by(records.drop("comp"), found)
    return out.join(by_shuffle(records.select("id", "comp")), "id")


def started(records: DataFrame) -> State:
    """The state after a first load (unique ids)."""
    of = components(possible_links(records)).select(F.col("node").alias("id"), "comp")
    placed = materialize(records.join(by_shuffle(of), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "records")
    keys = materialize(record_keys(records).join(by_shuffle(placed.select("id", "comp")), "id").select("kind", "key", "name", "comp"), "keys")
    return State(placed, keys, materialize(_merged(placed), "merged"))


def upserted(state: State, batch: DataFrame) -> tuple[State, DataFrame]:
    """The state after a batch, and its (comp, action) changes. batch: records with new ids, whose seq comes after those of the state.

    Stored records outside of the touched components are neither folded nor read in Python; their
    merged rows, records and keys are carried over as they are.
    """
    links = possible_links(batch).union(probed(batch, state.keys))
    of = materialize(components(links), "touched")  # nodes: records of the batch, and components that they reach
    moved = of.select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
    placed = batch.join(by_shuffle(moved.withColumnRenamed("comp", "id")), "id", "left").withColumn("comp", F.coalesce("_new", "id")).drop("_new")
    relabelled = lambda table: table.join(by_shuffle(moved), "comp", "left").withColumn("comp", F.coalesce("_new", "comp")).drop("_new")
    records = materialize(relabelled(state.records).unionByName(placed.select(state.records.columns)), "records")
    known = state.keys.where(F.col("kind") == PIECE).groupBy(F.col("key").alias("piece")).agg(F.count("*").alias("times"))
    new_keys = record_keys(batch, known).join(by_shuffle(placed.select("id", "comp")), "id").select("kind", "key", "name", "comp")
    keys = materialize(relabelled(state.keys).unionByName(new_keys).distinct(), "keys")
    touched = materialize(placed.select("comp").distinct(), "components")
    again = materialize(_merged(records.join(by_shuffle(touched), "comp", "left_semi").select(state.records.columns)), "merged-again")
    stored = state.merged.select("comp").distinct().join(by_shuffle(moved), "comp").select(F.col("_new").alias("comp")).distinct().withColumn("was", F.lit(True))
    actions = touched.join(by_shuffle(stored), "comp", "left").select("comp", F.when(F.col("was"), "updated").otherwise("inserted").alias("action"))
    merged = materialize(untouched(state, moved).unionByName(again.select(state.merged.columns)), "merged")
    return State(records, keys, merged), actions


def untouched(state: State, moved: DataFrame) -> DataFrame:
    """Merged rows of components that a batch did not reach."""
    return state.merged.join(by_shuffle(moved.select("comp")), "comp", "left_anti").select(state.merged.columns)
