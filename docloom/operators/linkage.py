"""Record linkage: agreements to training options, noisy names to a dimension, exact and fuzzy duplicates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import edit_ratio_of_keys, overlap_of_tokens
from ..functions.text import normalize, tokens
from ..shared import by_shuffle, materialize

# Weights and thresholds of the link score.
TEACHER, TRAINING, PERIOD = 0.55, 0.40, 0.05
LEAST_TEACHER, LEAST_TRAINING, LEAST_SCORE = 0.65, 0.5, 0.62
CANONICAL = 0.88
#: Overlaps of teachers down to which options are looked for, one after the other; parts into which options are dealt to be ranked (1,024 at most), and bits of a rank.
TIERS = (0.9, 0.8, LEAST_TEACHER)
RANK_PARTS, RANK_BITS = 64, 43


def training_options(plans: DataFrame) -> DataFrame:
    """One row for each training of a plan: option_id, plan_id, teacher, career, period, training and the order in which options stand."""
    return plans.select("plan_id", "teacher", "career", "period", F.posexplode("trainings").alias("pos", "t")).select(
        F.concat_ws(":cap-", F.col("plan_id").cast("string"), F.col("pos").cast("string")).alias("option_id"), "plan_id", "teacher", "career", "period", F.col("t.name").alias("training"), F.col("pos").alias("ordinal")
    )


def _keys(names: Column, least: Column) -> Column:
    """Keys of tokens in their common order, rare ones first: two names of which at least that part of the larger is common share one.

    With so many common tokens they share two among the first n - c + 2, c being what the name needs
    in common; where one is enough they share a single token.
    """
    n = F.size(names)
    common = F.ceil(n * least - 1e-6)
    front = F.slice(names, F.lit(1), F.least(n, n - common + 2).cast("int"))
    pairs = F.flatten(F.transform(front, lambda x, i: F.transform(F.slice(names, i + 2, F.greatest(F.size(front) - i - 1, F.lit(0))), lambda y: F.concat_ws(" ", x, y))))
    return F.when(common <= 1, F.concat(pairs, names)).otherwise(pairs)


def _pair_value(bonus: float) -> Column:
    """What a pair of token sets is worth: its score in millionths and, below that, the option's rank, the first the highest. A hash aggregate keeps the greatest of such longs without sorting the pairs."""
    score = overlap_of_tokens(F.col("a"), F.col("b")) * TEACHER + overlap_of_tokens(F.col("ta"), F.col("tb")) * TRAINING + bonus
    return F.shiftleft((F.round(score, 6) * 1_000_000 + 0.5).cast("long"), RANK_BITS) + (F.lit((1 << RANK_BITS) - 1) - F.col("rank"))


def _score_of(value: Column) -> Column:
    return F.shiftright(value, RANK_BITS) / 1_000_000


def _lesser(n: Column, least: float) -> Column:
    """The largest overlap below least that a name of n tokens can have with an option; column sizes: how many tokens options have."""

    def below(size: Column) -> Column:
        longer = F.greatest(n, size)
        return F.least(n, size, F.ceil(longer * least - 1e-6) - 1) / longer

    return F.array_max(F.transform("sizes", below))


def match_training(records: DataFrame, options: DataFrame) -> DataFrame:
    """The best option of each record, if good enough: record_id, option_id, score.

    records: record_id, teacher, training, period; options: option_id, ordinal, teacher, training,
    period. The best option over all is chosen first (earliest ordinal on ties) and the thresholds
    applied then: a poor best hides a good second. Records of the same tokens are one set, and so are
    options, of which the first counts; what the period adds is looked at apart, among the options of
    that period. Only pairs that could decide are compared, by an equi-join on pairs of rare tokens:
    first those whose teachers have nearly all in common, then, for sets that a lesser overlap could
    still win, those with less; then, for records whose link an option of too small an overlap could
    hide, those that reach its score. No pair that could win or hide is lost. A null id stays null, and
    all records without an id are one.
    """
    read = lambda df, a, b: df.withColumns({a: F.array_sort(tokens("teacher", 1)), b: F.array_sort(tokens("training", 1))}).where(F.size(a) > 0)
    r = read(records, "a", "ta").select("record_id", "period", "a", "ta")
    o = read(options, "b", "tb").select("option_id", "ordinal", "period", "b", "tb")
    place = [F.asc_nulls_last("ordinal"), F.desc_nulls_last("option_id")]
    o = materialize(o.repartitionByRange(RANK_PARTS, *place).sortWithinPartitions(*place).withColumn("rank", F.monotonically_increasing_id()), "options")
    sets = materialize(r.select("a", "ta").distinct().withColumn("set_id", F.monotonically_increasing_id()), "token-sets")
    rows = materialize(r.join(by_shuffle(sets), ["a", "ta"]).select("record_id", "period", "set_id"), "records")
    first_of = lambda *keys: o.groupBy("b", "tb", *keys).agg(F.min("rank").alias("rank"))

    names = sets.select("a").union(o.select("b")).distinct().select(F.col("a").alias("names"), F.explode("a").alias("token"))
    seen = names.groupBy("token").agg(F.count("*").alias("df"))
    ordered = names.join(by_shuffle(seen), "token").groupBy("names").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("x"))
    ordered = materialize(ordered.select("names", F.transform("x", lambda x: x["token"]).alias("rare")), "rare-first")
    rare_first = lambda df, c: df.join(by_shuffle(ordered.withColumnRenamed("names", c)), c).drop(c).withColumnRenamed("rare", c)
    sets, whole, dated = (materialize(rare_first(df, c), "ordered-sets") for df, c in ((sets, "a"), (first_of(), "b"), (first_of("period").where("period <> ''"), "b")))
    sizes = whole.agg(F.collect_set(F.size("b")).alias("sizes"))

    def scored(left: DataFrame, right: DataFrame, ids: list[str], least: Column, least_of_options: float, bonus: float) -> DataFrame:
        """ids and best over the options that may have so much of the teacher in common."""
        keyed = left.select(*ids, "a", "ta", F.explode(_keys(F.col("a"), least)).alias("key"))
        pairs = keyed.join(by_shuffle(right.withColumn("key", F.explode(_keys(F.col("b"), F.lit(least_of_options))))), ["key", *ids[1:]])
        return pairs.select(*ids, _pair_value(bonus).alias("best")).groupBy(*ids).agg(F.max("best").alias("best"))

    def searched(left: DataFrame, right: DataFrame, ids: list[str], bonus: float) -> DataFrame:
        """ids and best over the options that have enough of the teacher in common. left: ids, a, ta, and the best known before."""
        found = []
        for least in TIERS:
            found.append(materialize(scored(left, right, ids, F.lit(least), least, bonus), "scored"))
            left = left.join(by_shuffle(found[-1].withColumnRenamed("best", "more")), ids, "left").withColumn("best", F.greatest("best", "more")).drop("more")
            bound = _lesser(F.size("a"), least) * TEACHER + TRAINING + bonus + 2e-6
            left = left.crossJoin(F.broadcast(sizes)).where(F.col("best").isNull() | (_score_of(F.col("best")) <= bound)).drop("sizes")
        return functools.reduce(DataFrame.union, found).groupBy(*ids).agg(F.max("best").alias("best"))

    def rated(rows: DataFrame, of_sets: DataFrame, of_periods: DataFrame) -> DataFrame:
        """record_id and best (value, option_id, overlaps) out of the best of its sets."""
        each = rows.join(by_shuffle(of_sets), "set_id", "left").join(by_shuffle(of_periods.withColumnRenamed("best", "more")), ["set_id", "period"], "left")
        each = each.select("record_id", "set_id", F.greatest("best", "more").alias("value")).where("value is not null").withColumn("rank", F.lit((1 << RANK_BITS) - 1) - F.col("value").bitwiseAND(F.lit((1 << RANK_BITS) - 1)))
        each = each.join(by_shuffle(o.select("rank", "option_id", "b", "tb")), "rank").join(by_shuffle(sets), "set_id")
        teacher, training = overlap_of_tokens(F.col("a"), F.col("b")), overlap_of_tokens(F.col("ta"), F.col("tb"))
        return each.groupBy("record_id").agg(F.max(F.struct("value", "option_id", teacher.alias("s_teacher"), training.alias("s_training"))).alias("best"))

    of_sets = materialize(searched(sets.withColumn("best", F.lit(None).cast("long")), whole, ["set_id"], 0.0), "best-of-sets")
    periods = rows.where("period <> ''").select("set_id", "period").distinct().join(by_shuffle(sets), "set_id").join(by_shuffle(of_sets), "set_id", "left")
    score = _score_of(F.col("best.value"))
    good = (F.col("best.s_teacher") >= LEAST_TEACHER) & (F.col("best.s_training") >= LEAST_TRAINING) & (score >= LEAST_SCORE)
    first = materialize(rated(rows, of_sets, searched(periods, dated, ["set_id", "period"], PERIOD)).where(good), "linked")
    # an option with less of the teacher in common scores less than this
    bound = TEACHER * LEAST_TEACHER + TRAINING + PERIOD + 1e-6
    doubtful = rows.join(by_shuffle(first.where(score <= bound).select(F.col("record_id").alias("_id"), score.alias("reached"))), F.col("record_id").eqNullSafe(F.col("_id"))).drop("_id")
    least = F.greatest(F.lit(0.0), (F.col("reached") - 1e-6 - TRAINING - PERIOD) / TEACHER)

    def hiding(right: DataFrame, ids: list[str], bonus: float) -> DataFrame:
        left = doubtful.groupBy(*ids).agg(F.min("reached").alias("reached")).join(by_shuffle(sets), "set_id")
        return scored(left, right, ids, least, (LEAST_SCORE - 1e-6 - TRAINING - PERIOD) / TEACHER, bonus)

    hidden = rated(doubtful, hiding(whole, ["set_id"], 0.0), hiding(dated, ["set_id", "period"], PERIOD))
    best = first.union(hidden).groupBy("record_id").agg(F.max("best").alias("best"))
    return best.where(good).select("record_id", "best.option_id", score.alias("score"))


def canonical_match(names: DataFrame, dimension: list[str], least: float = CANONICAL) -> DataFrame:
    """Adds canonical: the dimension's spelling of column name, if equal when normalized or similar enough (best, first on ties); else the name.

    The dimension is a list in the program, so its size is known; it goes into the plan as one array.
    """
    options = F.array(*(F.struct(F.lit(-k).alias("o"), F.lit(n).alias("canonical"), normalize(F.lit(n)).alias("key")) for k, n in enumerate(dimension)))
    key = normalize("name")
    scored = F.transform(options, lambda d: F.struct(edit_ratio_of_keys(key, d["key"]).alias("score"), d["o"].alias("o"), d["canonical"].alias("canonical")))
    best = F.array_max(scored)
    return names.withColumn("_best", best).withColumn("canonical", F.when(F.col("_best.score") >= least, F.col("_best.canonical")).otherwise(F.col("name"))).drop("_best")


def first_of_equals(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
