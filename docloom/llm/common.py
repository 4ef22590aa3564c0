"""What the operators of this subpackage share: reading, shared tables, bounded Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize, shared_folder, spread  # noqa: F401

#: Rows and bytes of one Arrow batch: long texts stay within a Python worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Rows (of a few numbers) of a table that may be broadcast.
FEW_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by the path Spark reads."""
    bound_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def few(table: DataFrame, weight=None) -> DataFrame:
    """A materialized table, marked for broadcast if it is small (checked); otherwise as it is, to be joined by a shuffle."""
    rows = table.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(table) if rows <= FEW_ROWS else table


def most_frequent(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows of the largest counts, at most ``limit``: those above a threshold found by a histogram, so that only these are collected."""
    n = F.col(column)
    step = F.when(n < 256, n).otherwise(256 + F.floor(F.log2(n / 256.0) * 64)).cast("long")
    total, least = 0, 1 << 62
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > limit:
            break
        least = r["step"]
    return counts.where(step >= least)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; null becomes the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def text_or_empty(name: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(name: str = "doc_id"):
    """crc32 of an id's decimal text, as the folds of the contracts use it; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))
