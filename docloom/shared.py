"""Written intermediates, and inputs of few splits."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a part that is dealt by its keys, on average.
DEALT_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one of our own on a local master; on a cluster, whose executors could not read that, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, whose next join goes by a shuffle of both sides, whatever Spark expects of their sizes.

    Spark takes exploded rows and compressed tables for as small as what they come from, and would
    gather them on the driver to broadcast them.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys into parts of some DEALT_ROWS rows, and at least one a core: what windows and groups on the keys make of a part stays in memory.

    Left to itself Spark sizes the parts by their bytes. Narrow rows then come in millions to a task,
    and what is exploded from them is spilled.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT_ROWS))
    return df.repartition(parts, *keys)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan for work that is heavy for its rows; dealt over the cores if it has fewer splits than there are cores.

    That is so for small tables in one row group; large ones have splits enough and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
