"""What the query modules share: tables and pieces of oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CONNECTORS, DASHES
from ..operators.consensus import ENGINE_WEIGHTS, OTHER_ENGINE
from ..shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order: l_orderkey, l_linenumber (counted within the order, as the column repeats numbers) and p, the part."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    return lines.select("l_orderkey", number.alias("l_linenumber"), F.col("l_partkey").alias("p"))


ORDER_LINES = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INTEGER AS l_linenumber, l_partkey AS p FROM lineitem"


def sql_normalize(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def sql_clean(x: str) -> str:
    out = f"translate(coalesce({x}, ''), chr(65533), '-')"
    out = f"regexp_replace(translate({out}, '{DASHES}', '{'-' * len(DASHES)}'), '[\\x{{00AD}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    for pattern, new in ((r"\r\n?", "chr(10)"), (r"[ \t]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return f"regexp_replace({out}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def sql_compact(x: str) -> str:
    return f"trim(regexp_replace({sql_clean(x)}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def sql_tokens(x: str, longer_than: int) -> str:
    return f"list_distinct(list_filter(string_split({sql_normalize(x)}, ' '), lambda t: length(t) > {longer_than}))"


def sql_overlap(a: str, b: str) -> str:
    """Overlap of two token lists."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), len({b})) END"


def sql_edit_ratio(a: str, b: str) -> str:
    """Edit ratio of two normalized texts."""
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) END"


def sql_weight(x: str) -> str:
    exact = " ".join(f"WHEN upper({x}) = '{k}' THEN {w}" for k, w in ENGINE_WEIGHTS.items())
    partial = " ".join(f"WHEN contains(upper({x}), '{k}') THEN {w}" for k, w in ENGINE_WEIGHTS.items())
    return f"CASE {exact} {partial} ELSE {OTHER_ENGINE} END"


def sql_smart_case(x: str) -> str:
    """For ASCII texts."""
    small = ", ".join(f"'{w}'" for w in CONNECTORS)
    line = f"regexp_replace({sql_compact(x)}, '^[:\\-]+\\s*', '')"
    letters = f"regexp_replace({line}, '[^A-Za-z]', '', 'g')"
    title = f"array_to_string(list_transform(string_split(lower({line}), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ({small}) THEN w ELSE upper(w[1]) || w[2:] END), ' ')"
    return f"CASE WHEN {letters} = '' OR {letters} <> upper({letters}) THEN {line} ELSE {title} END"
