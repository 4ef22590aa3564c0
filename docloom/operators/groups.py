"""Small ordered groups in one pass over a sorted partition: no Python call and Arrow batch for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Results given out together.
GIVEN = 1000


def per_group_stream(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[Iterator[dict]], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """f of the rows of each group (dicts, in order, one after another), all results as a DataFrame.

    A task holds what f keeps and an Arrow batch, so a group may be of any length. Groups are spread by
    hash. Null keys form a group as any other value does.
    """
    arrow = to_arrow_schema(schema)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in batch.to_pylist())
        found = (out for _, group in groupby(every, lambda row: tuple(row[k] for k in keys)) for out in f(group))
        while some := list(islice(found, GIVEN)):
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(grouped, schema)


def per_group(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[list[dict]], list[dict]], schema: T.StructType) -> DataFrame:
    """As :func:`per_group_stream` for groups that one document or page bounds: f gets all rows of a group at once."""
    return per_group_stream(rows, keys, order, lambda group: iter(f(list(group))), schema)
