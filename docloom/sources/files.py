"""Files and stores: scanning, content hashes, versioned snapshots, exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

READING = T.StructType([*(T.StructField(n, T.StringType()) for n in ("doc_id", "engine", "text")), T.StructField("pages", T.IntegerType()), T.StructField("method", T.StringType()), T.StructField("error", T.StringType())])


def scan(spark: SparkSession, folder: str, limit: int | None = None, content: bool = True) -> DataFrame:
    """PDF files under a folder, whatever the case of their ending: path, size, modified, sha256. limit: only the first by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    digest = F.sha2("content", 256) if content else F.lit(None).cast("string")
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), digest.alias("sha256"), *(["content"] if content else []))
    return out.orderBy("path").limit(limit) if limit is not None else out


def unique_paths(paths: DataFrame, limit: int | None = None, fold_case: bool = False) -> DataFrame:
    """The first of equal PDF paths in the order given (columns seq, path)."""
    key = F.lower("path") if fold_case else F.col("path")
    rank = F.row_number().over(W.partitionBy(key).orderBy("seq"))
    rows = paths.where(F.lower("path").endswith(".pdf")).withColumn("r", rank).where("r = 1").drop("r")
    return rows.orderBy("seq").limit(limit) if limit is not None else rows


def unique_content(files: DataFrame, digest: str = "sha256", order: str = "path") -> DataFrame:
    """The first file of each content, and how many have it: one partial aggregation before the shuffle."""
    return files.groupBy(digest).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def readings(files: DataFrame, engine: str, read: Callable[[bytes], tuple[str, int, str]]) -> DataFrame:
    """Readings of an engine: read(content) gives text, pages and method. A failure gives a row with its error."""

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    text, pages, method = read(bytes(content))
                    out.append((path, engine, text, pages, method, None))
                except Exception as e:  # one broken file must not end the job; its row goes to the dead letters
                    out.append((path, engine, "", 0, "ERROR", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=READING.fieldNames())

    return files.select("path", "content").mapInPandas(rows, READING)


def split_failures(rows: DataFrame, least: int = 80) -> tuple[DataFrame, DataFrame]:
    """Readings with text enough, and dead letters by path; a null text is too little."""
    good = F.col("error").isNull() & F.coalesce(F.length(F.trim("text")) >= least, F.lit(False))
    return rows.where(good).drop("error"), rows.where(~good).select("doc_id", "engine", F.coalesce("error", F.lit("too little text")).alias("error"))


def png_size(content) -> tuple:
    """Width and height from a PNG's header."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return number(17), number(21)


class Store:
    """A table kept as snapshots; a small table of versions names the current one.

    Both are plain Parquet written by Spark. A snapshot is complete before its version is appended, so
    readers see the old or the new one. Two writers at once keep files of their own: one of them
    becomes the current one, neither overwrites the other. A store that cannot be read is an error,
    never an empty store.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _version(self, wanted: int | None = None) -> tuple[int, str] | None:
        """Number and folder of a version, the last one if none is wanted; None before the first."""
        try:
            known = self.spark.read.schema("version int, snapshot string").parquet(f"{self.folder}/versions")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        last = (known if wanted is None else known.where(F.col("version") == wanted)).agg(F.max(F.struct("version", "snapshot")).alias("x")).first()["x"]
        if last is None and wanted is not None:
            raise ValueError(f"the store has no version {wanted}")
        return last and (last["version"], last["snapshot"])

    @property
    def version(self) -> int:
        """The current version; 0 before the first."""
        return (self._version() or (0, ""))[0]

    def read(self, version: int | None = None) -> DataFrame:
        found = self._version(version)
        if found is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/snapshot/{found[1]}")

    def write(self, rows: DataFrame) -> int:
        """Writes a new snapshot, then its version; gives the number."""
        version = self.version + 1
        name = f"{version}-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.folder}/snapshot/{name}")
        self.spark.createDataFrame([(version, name)], "version int, snapshot string").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        return version

    def clear(self) -> int:
        return self.write(self.spark.createDataFrame([], self.schema))


def export_csv(view: DataFrame, path: str) -> None:
    """A flat view as CSV with a header; arrays and structs must be joined before."""
    view.write.mode("overwrite").option("header", True).csv(path)


def export_json(view: DataFrame, path: str) -> None:
    """A view as JSON lines, nested values kept."""
    view.write.mode("overwrite").json(path)
