"""Vector codes by product quantization: integer Lloyd rounds with Elkan's bounds.

A component x becomes the integer floor(256 * x); a vector is cut into PARTS consecutive parts, each
coded by the nearest of its part's ENTRIES codebook entries. Every part of every vector keeps an upper
bound of the distance to its entry and one lower bound for each entry, in the written table of the
round. A round shifts them by how far the entries moved; an entry is passed over only where a bound,
or half its distance from the own entry, is strictly above the upper bound. What is left is decided on
integer squared distances, ties to the lower index, so codes equal those of a full search.

A lower bound is stored as its gap above the upper bound in four bits, rounded down (GAPS is the most
a gap can say), the upper bound rounded up: half of a byte for an entry, whatever the rows.

A task sums its vectors by entry; the sums of tasks are added by Spark, and only codebooks reach the
driver (ENTRIES vectors in all).

Dropped: vectors that are null, empty or hold null or non-finite components; those of another length
than the first kept one (least id, then least components); those with a component of 131,072 or more,
whose squared distances could leave 64 bits. A length that PARTS does not divide is filled up with
zeros. Null ids stand last, repeated rows are coded each, equal vectors equally. With fewer than
ENTRIES vectors the codebook has fewer entries. Other input columns are never read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, few, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components from here on (scaled) would let squared distances leave 64 bits.
LARGEST = 1 << 25
#: Steps of a stored gap, and the part of the mean distance between entries that a step is.
GAPS, STEP = 15, 1 / 16
#: Relative and absolute slack of bounds against rounding.
SLACK, LEAST = 1e-12, 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors (rows) to entries (rows)."""
    low = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 20 and x.shape[1] <= 1 << 10
    dot = (x.astype(float) @ c.T.astype(float)).astype(np.int64) if low else x @ c.T
    return (x * x).sum(axis=1)[:, None] - 2 * dot + (c * c).sum(axis=1)


class Codebook:
    """One round's entries of one part, and what prunes: their distances and how far they moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries
        apart = np.sqrt(squared(entries, entries).astype(float))
        self.half = apart * (0.5 * (1 - SLACK)) - LEAST
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1, initial=np.inf) * (0.5 * (1 - SLACK)) - LEAST
        finite = apart[np.isfinite(apart)]
        self.step = max(1.0, float(finite.mean()) * STEP) if len(finite) else 1.0
        self.moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=1).astype(float)) * (1 + SLACK) + LEAST

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, its squared distance and all lower bounds of vectors without bounds."""
        d = squared(x, self.entries)
        own = d.argmin(axis=1)
        return own, d[np.arange(len(x)), own], np.sqrt(d.astype(float))

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entry, its squared distance and lower bounds, from bounds that held before the entries moved; and the distances worked out."""
        rows = np.arange(len(x))
        upper = upper + self.moved[own]
        lower = np.maximum(lower - self.moved, 0.0)
        exact = ((x - self.entries[own]) ** 2).sum(axis=1)
        open_ = np.flatnonzero(upper >= self.nearest[own])  # for the others no entry can be as near
        best = own.copy()
        done = 0
        if len(open_):
            tight = np.sqrt(exact[open_].astype(float)) * (1 + SLACK) + LEAST
            o = own[open_]
            left = (tight[:, None] >= lower[open_]) & (tight[:, None] >= self.half[o])
            left[np.arange(len(open_)), o] = False
            r, k = np.nonzero(left)
            done = len(r)
            d = ((x[open_[r]] - self.entries[k]) ** 2).sum(axis=1)
            all_ = np.full(left.shape, np.iinfo(np.int64).max)
            all_[r, k] = d
            all_[np.arange(len(open_)), o] = exact[open_]
            best[open_] = all_.argmin(axis=1)
            exact[open_] = all_.min(axis=1)
            lower[open_[r], k] = np.sqrt(d.astype(float))
            lower[open_, o] = np.sqrt(all_[np.arange(len(open_)), o].astype(float))
        own_lower = lower[rows, own]
        lower[rows, own] = np.where(best == own, np.sqrt(exact.astype(float)), own_lower)
        return best, exact, lower, done

    def packed(self, exact: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds in steps, rounded up, and the gaps of the lower bounds, rounded down, two a byte."""
        upper = np.ceil((np.sqrt(exact.astype(float)) * (1 + SLACK) + LEAST) / self.step)
        gaps = np.clip(np.floor((lower * (1 - SLACK) - LEAST) / self.step - upper[:, None]), 0, GAPS).astype(np.uint8)
        gaps[(lower * (1 - SLACK) - LEAST) / self.step < upper[:, None]] = 0
        if gaps.shape[1] % 2:
            gaps = np.pad(gaps, ((0, 0), (0, 1)))
        return upper.astype(np.float32), gaps[:, ::2] << 4 | gaps[:, 1::2]


def unpacked(upper: np.ndarray, gaps: np.ndarray, entries: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds as stored by a codebook with that step. A gap of nought says nothing: the bound is nought then."""
    each = np.stack([gaps >> 4, gaps & 15], axis=2).reshape(len(gaps), -1)[:, :entries].astype(float)
    lower = np.where(each > 0, each + upper[:, None], 0.0) * step
    return upper * step, lower


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """Integer components, filled up to a multiple of PARTS; rows are of one length, without nulls."""
    x = np.asarray(batch.column("embedding").flatten()).reshape(batch.num_rows, -1)
    x = np.floor(x.astype(float) * SCALE).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, embedding and label of the usable rows."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST // SCALE))
    v = v.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("n")).first()
    return v.where(F.size("embedding") == (first["n"] if first else 0))


def starting_codebooks(rows: DataFrame) -> np.ndarray:
    """(PARTS, entries, components of a part): the parts of the vectors of least id."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    x = np.floor(np.array([r["embedding"] for r in least], float) * SCALE).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).swapaxes(0, 1))


def _state_schema(rows: DataFrame) -> T.StructType:
    """A coded vector with its bounds, or (part is set) a task's sum and count of an entry."""
    return T.StructType([*rows.schema.fields, *T._parse_datatype_string("codes binary, uppers binary, gaps binary, part int, entry int, sums array<long>, n long").fields])


def assigned(rows: DataFrame, books: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """One round: rows, or the state of the round before, with codes and bounds, followed by each task's sums.

    before: the codebooks of the round before, and those before them (whose steps the bounds are stored in).
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((books, before))
    plain = ["vec_id", "embedding", "label"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, before = shared.value
        parts, entries, size = books.shape
        new = [Codebook(b, None if before is None else before[i]) for i, b in enumerate(books)]
        steps = [Codebook(b, None).step for b in before] if before is not None else None
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            n, codes, uppers, gaps = len(x), np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.float32), []
            if before is not None:
                old, old_upper, old_gaps = _stored(batch, parts)
            for p, book in enumerate(new):
                part = x[:, p * size : (p + 1) * size]
                if before is None:
                    own, exact, lower = book.first(part)
                else:
                    own, exact, lower, _ = book.again(part, old[:, p].astype(np.int64), *unpacked(old_upper[:, p].astype(float), old_gaps[:, p], entries, steps[p]))
                codes[:, p] = own
                uppers[:, p], packed = book.packed(exact, lower)
                gaps.append(packed)
                np.add.at(sums[p], own, part)
                counts[p] += np.bincount(own, minlength=entries)
            bounds = np.concatenate(gaps, axis=1)
            arrays = [*(batch.column(c) for c in plain), *(pa.array([r.tobytes() for r in a], pa.binary()) for a in (codes, uppers, bounds))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=names)
        p, e = np.nonzero(counts)
        if len(p):
            arrays = [*(pa.nulls(len(p), k) for k in kinds), *(pa.nulls(len(p), pa.binary()) for _ in range(3)), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(list(sums[p, e]), pa.list_(pa.int64())), pa.array(counts[p, e])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = _state_schema(rows.select(*plain))
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields[:3]]
    return rows.mapInArrow(coded, schema)


def _stored(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper bounds and packed gaps of a batch, by row and part."""
    codes, uppers, gaps = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("codes", np.uint8), ("uppers", np.float32), ("gaps", np.uint8)))
    n = batch.num_rows
    return codes.reshape(n, parts), uppers.reshape(n, parts), gaps.reshape(n, parts, -1)


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floored mean of its vectors; those without any stay."""
    sums = state.where(F.col("part").isNotNull()).select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    out = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():  # one number a component of the codebooks
        out[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return out


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, codes (binary), error (long)) of the usable rows, and the final codebooks (part, entry, component)."""
    bound_batches(vectors.sparkSession)
    rows = kept(vectors, id_col, vector_col, label_col)
    if rows.isEmpty():
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")), None
    books = starting_codebooks(rows)
    state, before = rows, None
    for k in range(ROUNDS):
        state = materialize(assigned(state, books, before), f"codes-{k}")
        books, before = moved(state, books), books
        state = state.where(F.col("part").isNull())
    return final(state, books, before), books


def final(state: DataFrame, books: np.ndarray, before: np.ndarray) -> DataFrame:
    """The last assignment, from the last round's bounds: codes and errors alone."""
    shared = state.sparkSession.sparkContext.broadcast((books, before))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, before = shared.value
        parts, entries, size = books.shape
        new, steps = [Codebook(b, before[i]) for i, b in enumerate(books)], [Codebook(b, None).step for b in before]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            old, upper, gaps = _stored(batch, parts)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(new):
                own, exact, _, _ = book.again(x[:, p * size : (p + 1) * size], old[:, p].astype(np.int64), *unpacked(upper[:, p].astype(float), gaps[:, p], entries, steps[p]))
                codes[:, p] = own
                error += exact
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["vec_id", "label", "codes", "error"])

    schema = T.StructType([state.schema["vec_id"], state.schema["label"], *T._parse_datatype_string("codes binary, error long").fields])
    return state.mapInArrow(coded, schema)


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all components as decimal integers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows for all embeddings."""
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    codes = materialize(codes.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"), "coded")
    by_label = few(materialize(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors"))
    digest = F.lit(codebooks_sha256(books) if books is not None else None).cast("string")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _assigned_sql(k: int) -> str:
    return (
        f"d{k} AS (SELECT v, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM ints JOIN c{k} USING (part, pos) GROUP BY v, part, entry),\n"
        f"a{k} AS (SELECT v, part, entry, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY v, part ORDER BY d, entry) = 1)"
    )


def _moved_sql(k: int) -> str:
    return (
        f"m{k} AS (SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM ints JOIN a{k} USING (v, part) GROUP BY part, entry, pos),\n"
        f"c{k + 1} AS (SELECT part, entry, pos, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry, pos))"
    )


OP13_SQL = f"""WITH rows AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT v, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i, len(embedding) // {PARTS} AS n FROM rows),
ints AS (SELECT v, i // n AS part, i % n AS pos, floor({SCALE} * x)::BIGINT AS x FROM wide),
c0 AS (SELECT part, v AS entry, pos, x AS c FROM ints WHERE v < {ENTRIES}),
{_assigned_sql(0)}, {_moved_sql(0)},
{_assigned_sql(1)}, {_moved_sql(1)},
{_assigned_sql(2)},
coded AS (SELECT v, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY v),
book AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows JOIN coded USING (v), book"""
