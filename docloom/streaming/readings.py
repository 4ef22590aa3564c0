"""Readings of documents as a stateful stream: a document's state is kept by key, and a late reading opens it again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import shared_folder

STATE = "entries string, n_readings long"
#: What a document's rows hold: an engine's latest reading, and how many distinct readings the document had.
READING = "engine string, at long, value string, n_readings long"


def documents(readings: DataFrame, key: str = "doc_id") -> DataFrame:
    """A stream (key, engine, at, value, n_readings): of every document that a micro-batch touches, each engine's latest reading.

    readings: a stream with key, engine, at (long, the time of the reading) and value (text; null is
    empty). The state of a document is each engine's latest reading and the hashes of all distinct ones:
    a reading that comes twice, by a repeated file or a restarted batch, changes nothing, and readings
    may come in any order, however late, since the latest one counts and not the last. Rows without a
    key are one document. Its state grows with the distinct readings of one document.
    """
    kind = readings.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(READING).fields])
    content = F.xxhash64("engine", "at", "value").alias("content")
    rows = readings.select(key, F.coalesce("engine", F.lit("")).alias("engine"), F.col("at").cast("long").alias("at"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value")).select("*", content)

    def opened(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {"latest": {}, "seen": []}
        seen, latest = set(known["seen"]), known["latest"]
        for batch in batches:
            for engine, at, value, content in zip(batch["engine"], batch["at"], batch["value"], batch["content"]):
                seen.add(int(content))
                if engine not in latest or [int(at), value] > latest[engine]:
                    latest[engine] = [int(at), value]
        state.update((json.dumps({"latest": latest, "seen": sorted(seen)}), len(seen)))
        names = sorted(latest)
        yield pd.DataFrame({key: pd.Series([group[0]] * len(names), dtype=object), "engine": names, "at": [latest[e][0] for e in names], "value": [latest[e][1] for e in names], "n_readings": len(seen)})

    return rows.where(F.col("at").isNotNull()).groupBy(key).applyInPandasWithState(opened, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def kept(stream: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """The last state of every document of a stream of :func:`documents`, run over what there is now: (key, engine, at, value, n_readings).

    Each micro-batch is written with its number as plain Parquet, over itself if it comes again; of a
    document the rows of its last one count.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"
    batches: list[int] = []

    def written(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batches.append(number)

    stream.writeStream.foreachBatch(written).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_last"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("batch") == F.col("_last"))).select(*stream.columns)
