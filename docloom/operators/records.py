"""Records of one document kept over time: merging, ordered consolidation, upserts that respect manual corrections."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import tee

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import is_plan_code
from ..functions.quality import text_quality, value_score
from ..functions.similarity import edit_ratio_of_keys
from ..functions.text import clean, normalize
from ..shared import by_shuffle
from .graph import components
from .groups import per_group_stream

# Weights of the duplicate score and its threshold.
NAME, CAREER, TRAINING = 0.5, 0.2, 0.3
DUPLICATE = 0.93
#: The name ratio that a score of 0.93 needs, the other terms being 1.
SIMILAR_NAME = 0.86
ALIAS_SCORE, ALIAS_NAME, ALIAS_CAREER, ALIAS_TRAINING = 0.95, 0.96, 0.9, 0.72


def choose(primary: Column, secondary: Column, locked: Column | None = None) -> Column:
    """The primary value, unless it is empty, or unlocked and clearly worse."""
    a, b = clean(primary), clean(secondary)
    keep = F.lit(False) if locked is None else locked
    return F.when(a == "", secondary).when((b == "") | keep, primary).when(text_quality(b) > text_quality(a) + 2, secondary).otherwise(primary)


def record_quality(name: Column, career: Column, code: Column, period: Column, manual: Column, answers: Column, problems: Column) -> Column:
    """Quality of a record: manual corrections above all, then a valid code, filled fields, fewer problems."""
    texts = F.aggregate(answers, F.lit(0), lambda s, x: s + F.greatest(F.lit(0), text_quality(x)))
    return F.when(manual, 1000).otherwise(0) + F.when(is_plan_code(code), 120).otherwise(0) + F.when(clean(period) != "", 30).otherwise(0) + value_score(name) + value_score(career) + texts - problems * 3


def merged_suggestions(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Takes suggested values (columns s_<field>) only where the current one is empty or flagged (array column flagged)."""
    take = lambda f: ((clean(f) == "") | F.array_contains("flagged", f)) & (clean(f"s_{f}") != "")
    return rows.withColumns({f: F.when(take(f), clean(f"s_{f}")).otherwise(F.col(f)) for f in fields} | {"taken": F.array_join(F.array_compact(F.array(*(F.when(take(f), f) for f in fields))), ",")}).drop(*(f"s_{f}" for f in fields))


def two_key_upsert(store: DataFrame, batch: DataFrame, locked_fields: list[str]) -> DataFrame:
    """The store after a batch. Both: id, seq, hash, code, manual (boolean) and other columns alike.

    A batch row replaces the first stored row with its hash or code, wholly and with the new id,
    unless that one was corrected by hand: then the id and the locked fields stay. Other batch rows
    are appended, the first of those with the same hash or code only counting as new and later ones
    replacing it. seq gives the order of both.
    """
    columns = store.columns
    keyed = lambda df, c: df.where(F.coalesce(F.col(c), F.lit("")) != "")
    old = store.select(F.col("seq").alias("s_seq"), "hash", "code")
    by = [keyed(batch, c).select("id", "seq", c).join(keyed(old, c), c).select("id", "seq", "s_seq") for c in ("hash", "code")]
    hit = by[0].union(by[1]).groupBy("id", "seq").agg(F.min("s_seq").alias("s_seq"))
    matched = batch.join(hit, ["id", "seq"], "left")
    # the last batch row that hits a stored row replaces it
    last = matched.where("s_seq is not null").withColumn("r", F.row_number().over(W.partitionBy("s_seq").orderBy(F.desc("seq")))).where("r = 1").drop("r")
    fresh = {c: F.col(c).alias(f"n_{c}") for c in columns if c != "seq"}
    both = store.join(last.select("s_seq", *fresh.values()), store["seq"] == F.col("s_seq"), "left")
    kept = {"id", "manual", *locked_fields}
    updated = both.select(*(F.col(c) if c == "seq" else F.when(F.col("s_seq").isNull() | (F.col("manual") & F.lit(c in kept)), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in columns))
    new = matched.where("s_seq is null").drop("s_seq")
    same = F.coalesce(F.nullif("hash", F.lit("")), F.nullif("code", F.lit("")), F.col("id"))
    appended = new.withColumn("r", F.row_number().over(W.partitionBy(same).orderBy(F.desc("seq")))).where("r = 1").select(*columns)
    return updated.unionByName(appended)


def update_by_id(store: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """The store with the fields of changed rows (same id) taken over and marked as corrected by hand."""
    new = changes.select("id", *(F.col(f).alias(f"n_{f}") for f in fields), F.lit(True).alias("changed"))
    out = store.join(new, "id", "left")
    columns = [F.when(F.col("changed"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in fields else (F.col("changed").isNotNull() | F.col(c)).alias(c) if c == "manual" else F.col(c) for c in store.columns]
    return out.select(*columns)


# --- ordered consolidation: a fold whose order matters, inside blocks that cannot touch each other ---


def edit_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The edit ratio of two normalized texts, as functions.similarity has it; 0 if it is below the least that counts, which is found out early."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    most = int((1.0 - least) * longest + 1e-9)  # edits
    if abs(len(a) - len(b)) > most:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        # cells further from the diagonal than the edits allowed can't lie on a path that counts
        low, high = max(1, i - most), min(len(b), i + most)
        last, row[low - 1] = row[low - 1], i if low == 1 else most + 1
        for j in range(low, high + 1):
            up = row[j] if j < i + most else most + 1
            last, row[j] = up, min(up + 1, row[j - 1] + 1, last + (x != b[j - 1]))
        if min(row[low - 1 : high + 1]) > most:
            return 0.0
    ratio = max(0.0, 1.0 - row[-1] / longest)
    return ratio if ratio >= least - 1e-9 else 0.0


def duplicate_score(a: dict, b: dict) -> float:
    """How likely two records are of one document; a is the earlier one. Keys: name, career (normalized), code, valid, period, trainings (normalized names), alias."""
    if a["valid"] and b["valid"]:
        return float(a["code"] == b["code"])
    if a["period"] and b["period"] and a["period"] != b["period"]:
        return 0.0
    name = edit_ratio(a["name"], b["name"], SIMILAR_NAME)
    if not name:
        return 0.0  # no score that counts
    career = edit_ratio(a["career"], b["career"])
    left, right = a["trainings"], b["trainings"]
    training = sum(max(edit_ratio(x, y) for y in right) for x in left) / len(left) if len(left) and len(right) else 0.0
    if (a["alias"] or b["alias"]) and name >= ALIAS_NAME and career >= ALIAS_CAREER and training >= ALIAS_TRAINING:
        return ALIAS_SCORE
    return NAME * name + CAREER * career + TRAINING * training


def exact_match(a: dict, b: dict) -> bool:
    if a["hash"] and a["hash"] == b["hash"]:
        return True
    return bool(a["code"]) and a["code"] == b["code"] and (a["valid"] == b["valid"]) and "PRO-251" in a["code"]


def fold(records: Iterable[dict]) -> list[int]:
    """:func:`folding` of records that are all at hand."""
    return list(folding(records))


def folding(records: Iterable[dict]) -> Iterator[int]:
    """For each record, in order, the number of the output record it goes to: the first exact match, else the best score of 0.93 or more, else a new one. A record that joins lends its code, period and trainings where these are missing."""
    out: list[dict] = []
    by: dict[tuple, set[int]] = {}  # outputs by hash and by code: exact matches need no pass over all outputs
    names = lambda r: [("hash", r["hash"])] * bool(r["hash"]) + [("code", r["code"], bool(r["valid"]))] * ("PRO-251" in r["code"])
    for r in records:
        at = min((k for name in names(r) for k in by.get(name, ())), default=None)
        if at is None:
            scores = [duplicate_score(o, r) for o in out]
            best = max(range(len(out)), key=lambda k: (scores[k], -k), default=None)
            at = best if best is not None and scores[best] >= DUPLICATE else None
        if at is None:
            at = len(out)
            out.append(dict(r))
        else:
            o = out[at]
            for name in names(o):
                by[name].discard(at)
            if not o["valid"] and r["valid"]:
                o["code"], o["valid"] = r["code"], True
            for f in ("period", "name", "career", "hash"):
                o[f] = o[f] or r[f]
            o["alias"] = o["alias"] and r["alias"]
            if not len(o["trainings"]):
                o["trainings"] = r["trainings"]
        for name in names(out[at]):
            by.setdefault(name, set()).add(at)
        yield at


def _cuts(length: Column) -> tuple[Column, Column, Column]:
    """For names of that length: the edits that a similar name may be away, the pieces to leave out, and the characters of a piece."""
    edits = F.floor(length * ((1 - SIMILAR_NAME) / SIMILAR_NAME) + 1e-6).cast("int")
    spare = F.when(length >= 3 * (edits + 4), 3).otherwise(0)
    return edits, spare, F.greatest(F.lit(1), F.floor(length / (edits + 1 + spare))).cast("int")


def name_pieces(named: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """named (column name, normalized) with column piece: pieces of each name, one of which any similar name holds unchanged.

    Longer names are cut into three more, of which the edits leave three more unchanged: the three
    most common ones are left out. known: (piece, times) of pieces elsewhere, which count, too.
    """
    edits, spare, size = _cuts(F.length("name"))
    cut = named.select("*", size.alias("size"), spare.alias("spare"), F.explode(F.sequence(F.lit(0), edits + spare)).alias("i")).withColumn("piece", F.expr("substring(name, i * size + 1, size)")).where("piece <> ''")
    own = cut.select("piece", F.lit(1).cast("long").alias("times"))
    times = (own if known is None else own.unionByName(known.select("piece", F.col("times").cast("long").alias("times")))).groupBy("piece").agg(F.sum("times").alias("times"))
    ranked = cut.join(by_shuffle(times), "piece").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("times"), "i")))
    return ranked.where("r > spare").select(*named.columns, "piece").distinct()


def name_grams(named: DataFrame) -> DataFrame:
    """named with column piece: all parts of each name that are as long as the pieces of a name similar to it can be."""
    length = F.length("name")
    lengths = F.sequence(F.greatest(F.lit(1), F.floor(length * SIMILAR_NAME - 1e-6).cast("int")), F.ceil(length / SIMILAR_NAME + 1e-6).cast("int"))
    sizes = named.withColumn("sizes", F.array_distinct(F.transform(lengths, lambda n: _cuts(n)[2])))
    parts = "array_distinct(flatten(transform(filter(sizes, s -> s <= length(name)), s -> transform(sequence(1, length(name) - s + 1), i -> substring(name, i, s)))))"
    return sizes.select(*named.columns, F.explode(F.expr(parts)).alias("piece"))


def similar_names(a: str, b: str) -> Column:
    """Whether two name columns have a ratio of SIMILAR_NAME; most are told apart by their lengths and a few edits."""
    longest = f"greatest(length({a}), length({b}))"
    most = f"cast(floor({longest} * {1 - SIMILAR_NAME:.6f} + 1e-6) as int)"
    return F.expr(f"abs(length({a}) - length({b})) <= {most} AND levenshtein({a}, {b}, {most}) >= 0") & (edit_ratio_of_keys(F.col(a), F.col(b)) >= SIMILAR_NAME)


def blocked(records: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids that could be duplicates, a before b: equal hash or code, or a name ratio of at least 0.86.

    A score of 0.93 needs a name ratio of 0.86 (the other terms being 1). Names that similar and of n
    characters differ in at most n * 0.14 / 0.86 edits, so of that many pieces plus one at least one is found
    unchanged in the other, shifted by no more than the edits: an equi-join on pieces loses no pair.
    """
    keyed = records.select("id", "seq", "hash", "code", normalize("name").alias("name"))
    equal = [keyed.where(F.col(c) != "").select("id", "seq", c) for c in ("hash", "code")]
    pairs = [e.toDF("a", "sa", "k").join(e.toDF("b", "sb", "k"), "k").where("sa < sb").select("a", "b") for e in equal]
    named = keyed.where("name <> ''")
    cut, grams = name_pieces(named), name_grams(named)
    near = cut.select(F.col("id").alias("a"), F.col("seq").alias("sa"), F.col("name").alias("na"), "piece").join(by_shuffle(grams.select(F.col("id").alias("b"), F.col("seq").alias("sb"), F.col("name").alias("nb"), "piece")), "piece")
    near = near.where(F.col("a") != F.col("b")).where(similar_names("na", "nb"))  # before repeats are found: few pairs are left
    near = near.select(F.when(F.col("sa") < F.col("sb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("sa") < F.col("sb"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return pairs[0].union(pairs[1]).union(near).distinct()


def consolidated(records: DataFrame, block: str = "block") -> DataFrame:
    """id, kept_id: the ordered fold inside each block (column block).

    records: id, seq, block, hash, code, period, name, career, trainings (array<string>), alias (boolean).
    """
    rows = records.select("id", "seq", block, F.coalesce("hash", F.lit("")).alias("hash"), clean("code").alias("code"), clean("period").alias("period"), normalize("name").alias("name"), normalize("career").alias("career"), F.transform("trainings", normalize).alias("trainings"), is_plan_code("code").alias("valid"), F.coalesce("alias", F.lit(False)).alias("alias"))

    def folded(found: Iterator[dict]) -> Iterator[dict]:
        first: dict[int, object] = {}
        rows, copies = tee(found)  # one row apart at most
        return ({"id": r["id"], "kept_id": first.setdefault(at, r["id"])} for r, at in zip(rows, folding(copies)))

    kind = records.schema["id"].dataType
    return per_group_stream(rows, [block], ["seq"], folded, T.StructType([T.StructField("id", kind), T.StructField("kept_id", kind)]))


def match_keys(records: DataFrame) -> DataFrame:
    """id, and the keys whose equality makes records candidates of one another: hash, code, name ('' where there is none)."""
    return records.select("id", F.coalesce("hash", F.lit("")).alias("hash"), clean("code").alias("code"), normalize("name").alias("name"))


def possible_links(records: DataFrame) -> DataFrame:
    """(a, b) whose components are those of all pairs that could match: equal hashes, codes and names tied to their least id; only distinct names are compared."""
    keyed = match_keys(records)
    least = {c: keyed.where(F.col(c) != "").groupBy(c).agg(F.min("id").alias("b")) for c in ("hash", "code", "name")}
    edges = [keyed.where(F.col(c) != "").join(by_shuffle(least[c]), c).select(F.col("id").alias("a"), "b") for c in least]
    names = least["name"].select(F.col("b").alias("id"), F.col("b").alias("seq"), F.lit("").alias("hash"), F.lit("").alias("code"), "name")
    return edges[0].union(edges[1]).union(edges[2]).union(blocked(names))


def consolidated_all(records: DataFrame) -> DataFrame:
    """id, kept_id: the ordered fold over all records (unique ids; columns as for consolidated, without block).

    Records are folded inside the connected components of the pairs that could match. What an output
    borrows comes from records of its component, so no match crosses components.
    """
    of = components(possible_links(records))
    rows = records.join(by_shuffle(of.select(F.col("node").alias("id"), "comp")), "id", "left")
    return consolidated(rows.withColumn("block", F.coalesce("comp", "id")).drop("comp"))
