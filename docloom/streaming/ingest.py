"""Files as a stream: each micro-batch goes through the same transformation and upsert as a batch does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Store


def new_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """PDF files as they come: path, content, sha256."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", per_batch).load(folder)
    return raw.select("path", "content", F.sha2("content", 256).alias("sha256"))


def upsert_stream(rows: DataFrame, store: Store, upsert: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into a store: upsert(store rows, batch) gives the new store. Batches may come twice; upserts by content are idempotent."""

    def each(batch: DataFrame, _: int) -> None:
        store.write(upsert(store.read(), batch))

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
