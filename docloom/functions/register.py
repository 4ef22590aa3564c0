"""SQL names for the text functions: temporary SQL functions, so Catalyst sees plain expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import ACCENTED, BASE


def register(spark: SparkSession) -> None:
    """normalize_text(s), edit_ratio(a, b) and token_overlap(a, b, longer_than) for spark.sql."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(s STRING) RETURNS STRING RETURN "
        f"trim(regexp_replace(lower(regexp_replace(translate(coalesce(s, ''), '{ACCENTED}', '{BASE}'), '[\\\\u0300-\\\\u036f]', '')), '[^a-z0-9]+', ' '))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION edit_ratio(a STRING, b STRING) RETURNS DOUBLE RETURN "
        "CASE WHEN normalize_text(a) = '' OR normalize_text(b) = '' THEN 0D "
        "ELSE greatest(0D, 1D - levenshtein(normalize_text(a), normalize_text(b)) / greatest(length(normalize_text(a)), length(normalize_text(b)))) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_overlap(a STRING, b STRING, longer_than INT) RETURNS DOUBLE RETURN "
        "coalesce(size(array_intersect(filter(split(normalize_text(a), ' '), t -> length(t) > longer_than), filter(split(normalize_text(b), ' '), t -> length(t) > longer_than))) "
        "/ nullif(greatest(size(array_distinct(filter(split(normalize_text(a), ' '), t -> length(t) > longer_than))), size(array_distinct(filter(split(normalize_text(b), ' '), t -> length(t) > longer_than)))), 0), 0D)"
    )
