"""Variable-capacity best-fit packing of documents into training sequences.

A document's length is its words and one end token. Lengths are cut into pieces of at most the
largest permitted capacity. Pieces are dealt by hash to shards, as many as the table needs, and
packed there in batches of bounded size, the longest first: a piece goes to the open bin that it fills
best; if none has room, a bin opens. Its size is decided there: of the permitted sizes that hold the
piece the one of least cost for each position that the pieces still to come can fill. In the end each
bin is downsized to the least permitted capacity that holds its contents.

The cost of a bin of capacity L is L * (1 + L / 16384): every position is computed, and attention
grows with the length.

Nulls and empty texts have length 1 (the end token). A null id stays null. Repeated rows are packed
each. Other input columns are ignored. No piece is dropped or cut short: pieces of a document cover
it exactly, and no bin exceeds its capacity. Bins do not depend on the session's settings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table, text_or_empty

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together: bounds a task's memory at any input size.
BATCH = 1 << 16
#: Documents of a shard, about.
SHARD = 1 << 13


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / 16384)


def downsized(used: int, capacities: tuple[int, ...] = CAPACITIES) -> int:
    """The least permitted capacity that holds ``used``."""
    return next(c for c in capacities if c >= used)


def filled(room: int, left: list[int], mask: int) -> int:
    """Positions of ``room`` that the pieces still to come fill, the longest that fits first; left: how many of each length; mask: which lengths there are."""
    start, length = room, room
    while room:
        some = mask & ((1 << min(room, length) + 1) - 1)
        if not some:
            break
        length = some.bit_length() - 1
        room -= length * min(left[length], room // length)
        length -= 1
    return start - room


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int]]:
    """Bin of each length and contents of each bin. Lengths come longest first."""
    of, used = [], []
    left = [0] * (capacities[-1] + 1)
    for n in lengths:
        left[n] += 1
    coming = sum(1 << n for n in set(lengths))
    bins: dict[int, list[int]] = {}  # by room left
    mask = 0  # bit r: some bin has room r
    for n in lengths:
        left[n] -= 1
        if not left[n]:
            coming ^= 1 << n
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = bins[r].pop()
            if not bins[r]:
                mask ^= 1 << r
        else:
            b, r = len(used), min((c for c in capacities if c >= n), key=lambda c: cost(c) / (n + filled(c - n, left, coming)))
            used.append(0)
        used[b] += n
        of.append(b)
        if r > n:
            bins.setdefault(r - n, []).append(b)
            mask |= 1 << (r - n)
    return of, used


def pieces(docs: DataFrame, largest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start and length of every document's pieces, in words; native."""
    words = F.regexp_count(F.col("t"), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    sized = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).select("doc_id", words.cast("long").alias("n"))
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece"))
    start = F.col("piece") * largest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest)).cast("int").alias("length"))


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, bin_offset, bin_used, bin_capacity."""
    bound_batches(docs.sparkSession)
    capacities = tuple(sorted(capacities))
    shards = shards or -(-docs.count() // SHARD) or 1
    cut = pieces(docs, capacities[-1], id_col, text_col)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", "piece"), "doc_id", "piece", "length")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, serial, last = [], 0, {}, None

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            n = np.asarray(rows["length"])
            order = np.argsort(-n, kind="stable")
            of, used = pack(n[order].tolist(), capacities)
            bins, offsets, at = np.empty(len(n), np.int64), np.empty(len(n), np.int32), [0] * len(used)
            for k, b in zip(order.tolist(), of):
                bins[k], offsets[k] = b, at[b]
                at[b] += int(n[k])
            first = serial.get(last, 0)
            serial.clear()
            serial[last] = first + len(used)
            used_of = np.array(used, np.int32)
            sizes = np.array([downsized(u, capacities) for u in used], np.int32)
            names = ["doc_id", "piece", "start", "length"]
            columns = [*(rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0) for c in names), pa.array((np.int64(last) << 40) + first + bins), pa.array(offsets), pa.array(used_of[bins]), pa.array(sizes[bins])]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "bin_id", "bin_offset", "bin_used", "bin_capacity"])

        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (last != shard[a] or count + b - a > BATCH):
                    yield flush()
                    held, count = [], 0
                last = int(shard[a])
                held.append(batch.slice(a, b - a))
                count += b - a
        if held:
            yield flush()

    added = T._parse_datatype_string("bin_id long, bin_offset int, bin_used int, bin_capacity int").fields
    return dealt.mapInArrow(packed, T.StructType([*(cut.schema[c] for c in ("doc_id", "piece", "start", "length")), *added]))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; one row per piece."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
