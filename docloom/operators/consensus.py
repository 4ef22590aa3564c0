"""Consensus of several readings of one document: weighted votes per field, lists, and aligned table rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import clean, js_round, normalize

# Votes of the engines.
ENGINE_WEIGHTS = {"MANUAL": 12, "ENCABEZADO": 8, "TABLA_TEXTUAL": 7, "DIGITAL_LINEAL": 6, "DIGITAL_POSICIONAL": 6, "OCR_ESTRUCTURADO": 5, "OCR": 4, "IA_LOCAL": 3}
OTHER_ENGINE = 2


def engine_weight(c: Column | str) -> Column:
    """Weight of an engine by its name, else by the first known name that it contains, else 2."""
    name = F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    out = None
    for known, weight in ENGINE_WEIGHTS.items():
        out = F.when(name == known, weight) if out is None else out.when(name == known, weight)
    for known, weight in ENGINE_WEIGHTS.items():
        out = out.when(name.contains(known), weight)
    return out.otherwise(OTHER_ENGINE)


def ranked_engines(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds engine_idx: the candidates of a document by falling weight, then in the order given (column seq)."""
    return candidates.withColumn("engine_idx", F.row_number().over(W.partitionBy(key).orderBy(F.desc(engine_weight("engine")), "seq")) - 1)


def vote(values: DataFrame, keys: list[str]) -> DataFrame:
    """The winning value of each key.

    values: the keys, engine, engine_idx, value and quality. Values agree if they are equal when
    normalized; a value adds its engine's weight and a bonus for quality. Most points win, then the
    earliest engine; the group's best spelling stands for it. One shuffle on the keys serves all.
    Empty values don't vote; keys without a vote have no row.
    """
    points = F.greatest(F.lit(0.1), engine_weight("engine") + F.greatest(F.lit(-4.0), F.least(F.lit(8.0), F.col("quality") / 10)))
    votes = values.withColumn("value", clean("value")).withColumn("vote_key", normalize("value")).where("vote_key <> ''").withColumn("points", F.round(points, 6))
    best = F.max(F.struct("quality", (-F.col("engine_idx")).alias("o"), "value"))["value"]
    groups = votes.groupBy(*keys, "vote_key").agg(F.sum("points").alias("points"), F.min("engine_idx").alias("first"), F.count("*").alias("votes"), best.alias("value"), F.array_sort(F.collect_set("engine")).alias("engines"))
    w = W.partitionBy(*keys)
    ranked = groups.withColumn("total", F.sum("points").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("points", 6)), "first")))
    confidence = F.least(F.lit(100), js_round(55 + F.col("points") / F.greatest(F.lit(1.0), F.col("total")) * 35 + F.least(F.lit(10), F.col("votes") * 3)))
    return ranked.where("rank = 1").select(*keys, "value", F.round("points", 4).alias("points"), confidence.cast("int").alias("confidence"), "votes", F.array_join("engines", ",").alias("engines"))


def cell_vote(values: DataFrame, keys: list[str]) -> DataFrame:
    """The winning value of each key by engine weight alone; the earliest engine wins ties and gives the spelling."""
    votes = values.withColumn("value", clean("value")).withColumn("vote_key", normalize("value")).where("vote_key <> ''").withColumn("weight", engine_weight("engine"))
    groups = votes.groupBy(*keys, "vote_key").agg(F.sum("weight").alias("points"), F.min(F.struct("engine_idx", "value")).alias("first"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("points"), "first.engine_idx"))
    return groups.withColumn("rank", rank).where("rank = 1").select(*keys, F.col("first.value").alias("value"), "points")


def best_text(values: DataFrame, keys: list[str]) -> DataFrame:
    """The best free text of each key: engine weight and clamped quality, then length, then order."""
    points = engine_weight("engine") + F.greatest(F.lit(-5.0), F.least(F.lit(12.0), F.col("quality") / 5))
    rows = values.withColumn("value", clean("value")).where("value <> ''").withColumn("points", F.round(points, 6))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("points"), F.desc(F.length("value")), "engine_idx"))
    return rows.withColumn("rank", rank).where("rank = 1").select(*keys, "value", "points")


def list_union(values: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct items of all lists of a key: column value, in order of ord; items equal when normalized keep their first spelling."""
    rows = values.withColumn("value", clean("value")).withColumn("item_key", normalize("value")).where("item_key <> ''")
    first = rows.groupBy(*keys, "item_key").agg(F.min(F.struct("ord", "value")).alias("x"))
    return first.select(*keys, F.col("x.value").alias("value"), (F.row_number().over(W.partitionBy(*keys).orderBy("x.ord", "item_key")) - 1).alias("pos"))


def code_vote(sources: DataFrame, keys: list[str]) -> DataFrame:
    """The winning code of each key. sources: keys, code (canonical), weight, cap (hits of a source that count) and source_idx."""
    hits = sources.where("code <> ''").groupBy(*keys, "source_idx", "code").agg(F.count("*").alias("n"), F.first("weight").alias("weight"), F.first("cap").alias("cap"))
    total = hits.groupBy(*keys, "code").agg(F.sum(F.least("n", "cap") * F.col("weight")).alias("points"), F.min("source_idx").alias("first"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("points"), "first", "code"))
    return total.withColumn("rank", rank).where("rank = 1").select(*keys, "code", "points")


# --- aligned table rows: a greedy choice whose order matters, one small group for each document ---

FIELDS = ("name", "hours", "start", "end", "kind")


def _tokens(key: str) -> frozenset[str]:
    return frozenset(t for t in key.split() if len(t) > 2)


def _overlap(x: frozenset[str], y: frozenset[str]) -> float:
    if x is y:
        return 1.0 if x else 0.0
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


def align_rows(engines: list[tuple[str, int, list[dict]]], accept: float = 0.35, same_order: float = 0.35, leftover: int = 4, duplicate: float = 0.65) -> list[list[tuple[int, int]]]:
    """Which rows of the engines belong together: a list of groups of (engine, row).

    engines: (name, weight, rows), each row with order, key (normalized name) and FIELDS. The set with
    the most rows and cells leads; each of its rows takes the best free row of every other engine
    (token overlap, and a bonus for the same order) if good enough. Complete rows left over follow
    unless they repeat a name.
    """
    return _aligned([(weight, [(r["order"], _tokens(r["key"]), sum(bool(r[f]) for f in FIELDS)) for r in rows]) for _, weight, rows in engines], accept, same_order, leftover, duplicate)


def _aligned(engines: list[tuple[int, list[tuple]]], accept: float = 0.35, same_order: float = 0.35, leftover: int = 4, duplicate: float = 0.65) -> list[list[tuple[int, int]]]:
    """As :func:`align_rows`; engines: (weight, rows), each row (order, tokens of its key, how many of FIELDS it has)."""
    full = [(20 * len(rows) + 5 * sum(r[2] for r in rows) + 2 * weight, -k) for k, (weight, rows) in enumerate(engines) if rows]
    if not full:
        return []
    lead = -max(full)[1]
    free = [dict(enumerate(rows)) for _, rows in engines]
    out = []
    for i, (order, own, _) in enumerate(engines[lead][1]):
        group = [(lead, i)]
        for k, others in enumerate(free):
            if k == lead:
                continue
            best, at = 0.0, -1
            for j, (place, tokens, _) in others.items():
                score = _overlap(own, tokens) + (same_order if order == place else 0.0)
                if score > best:
                    best, at = score, j
            if at >= 0 and best >= accept:
                del others[at]
                group.append((k, at))
        out.append(group)
    names = [tokens for _, tokens, _ in engines[lead][1]]
    for k, others in enumerate(free):
        if k == lead:
            continue
        for j, (_, tokens, filled) in others.items():
            if filled >= leftover and all(_overlap(n, tokens) < duplicate for n in names):
                out.append([(k, j)])
                names.append(tokens)
    return out


def aligned_rows(rows: DataFrame) -> DataFrame:
    """Adds slot (0-based place in the merged table) to rows (doc_id, engine, engine_idx, weight, ord, key, FIELDS); rows that find no place go.

    The group of a document is bounded by its table; documents spread over the shuffle partitions.
    """

    full = [F.coalesce((F.col(f) != ("" if kind == "string" else 0)).cast("int"), F.lit(0)) for f, kind in rows.select(*FIELDS).dtypes]
    counted = rows.withColumn("_filled", sum(full, F.lit(0)))
    schema = T.StructType([*rows.schema.fields, T.StructField("slot", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def values(column: pa.ChunkedArray, of: Callable = lambda x: x) -> list:
        """of each value, worked out once for equal ones."""
        coded = column.combine_chunks().dictionary_encode("encode")
        pool = [of(x) for x in coded.dictionary.to_pylist()]
        return [pool[k] for k in coded.indices.to_numpy().tolist()]

    def placed(found: pa.Table) -> pa.Table:
        """Rows of whole documents with their slots: only what places them becomes Python values."""
        at, slots = [], []
        columns = zip(*(values(found[c]) for c in ("doc_id", "engine_idx", "engine", "weight", "ord")), values(found["key"], _tokens), values(found["_filled"]))
        for _, group in groupby(enumerate(columns), lambda r: r[1][0]):
            by_engine: dict[tuple, tuple[int, list, list]] = {}
            for k, (_, idx, engine, weight, order, tokens, filled) in group:
                part = by_engine.get((idx, engine))
                if part is None:
                    part = by_engine[idx, engine] = (int(weight), [], [])
                part[1].append((order, tokens, filled))
                part[2].append(k)
            engines = [part for _, part in sorted(by_engine.items())]
            for slot, together in enumerate(_aligned([part[:2] for part in engines])):
                at += [engines[k][2][j] for k, j in together]
                slots += [slot] * len(together)
        out = found.drop_columns("_filled").take(pa.array(at, pa.int64()))
        return out.append_column("slot", pa.array(slots, pa.int32())).cast(arrow)

    def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last document of a batch may go on in the next one, so it waits."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            ids = table["doc_id"].to_pylist()
            cut = next((k for k in range(len(ids) - 1, 0, -1) if ids[k - 1] != ids[-1]), 0)
            if cut:
                yield from placed(table.slice(0, cut).combine_chunks()).to_batches()
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield from placed(rest.combine_chunks()).to_batches()

    return counted.repartition("doc_id").sortWithinPartitions("doc_id", "engine_idx", "ord").mapInArrow(whole_documents, schema)
