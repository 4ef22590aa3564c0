"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams of words.

A text's features are the presence of its terms, of its pairs of neighbouring terms and of its pairs
with one or two terms between them. They are hashed to BUCKETS: one half for terms, one for pairs.

Learning is from a bounded sample: the rows of the training fold that are labelled, at most about
TRAIN_ROWS of them, drawn by a hash of id and text, so that it does not depend on how the input is
split. Rows with equal id and text count once. The rows are dealt to SHARDS by that hash and each
shard makes a pass of FTRL-proximal in its order: a rate for each coordinate, L1 so that most weights
are exactly nought, L2. After a pass the shards' states are averaged, and the next one starts from
there, EPOCHS times. A state is two numbers a bucket at most, whatever the input.

The weights that are not nought go to all tasks in one broadcast array (a number a bucket), which
scores all rows where they are read: no text is shuffled besides those of the sample.

Nulls and empty texts score what the intercept gives. An id with several labels is toxic if one says
so; null labels, null ids and ids without a document teach nothing. Without a labelled row of each
kind the score is the share of toxic rows among those learned from, 0 without any. Repeated rows are
scored each; other input columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, fold, materialize, table, text_or_empty
from .hashing import mix
from .terms import term_lists

#: Hash buckets of features; the intercept stands behind them.
BUCKETS = 1 << 19
#: Terms between the two of a pair, at most.
SKIPPED = 2
#: Labelled rows that are learned from, about.
TRAIN_ROWS = 20_000
SHARDS, EPOCHS = 4, 5
#: Rates and penalties of FTRL-proximal.
ALPHA, BETA, L1, L2 = 1.5, 1.0, 3.0, 0.0
#: A score from here on is reported as toxic.
THRESHOLD = 0.3
#: Buckets whose changes travel in one row.
RUN = 1 << 14
#: Terms of a text whose features are made at once.
SLICE = 1 << 18
_HALF = np.uint64(BUCKETS // 2 - 1)


def buckets(terms: np.ndarray) -> np.ndarray:
    """The bucket of each term and pair of a text, with repeats."""
    out = [mix(terms) & _HALF]
    for k in range(1, SKIPPED + 2):
        if len(terms) > k:
            out.append((mix(terms[:-k] * np.uint64(0x9E3779B97F4A7C15) + mix(terms[k:] + np.uint64(k))) & _HALF) + np.uint64(BUCKETS // 2))
    return np.concatenate(out).astype(np.int64)


def features(terms: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text, ascending; the intercept's is the last."""
    return np.append(np.unique(buckets(terms)), BUCKETS)


class Learner:
    """FTRL-proximal for logistic loss on features that are present or not."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """Weights of some coordinates; the intercept (the last one) is not penalized."""
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0.0
        rate = (BETA + np.sqrt(n[-1])) / ALPHA
        w[-1] = -z[-1] / rate
        return w

    def learn(self, at: np.ndarray, toxic: float) -> float:
        """One row, its buckets ascending with the intercept last; its score before."""
        w = self.weights(at)
        p = score(w.sum())
        g = p - toxic
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more
        return p


def score(margin: float) -> float:
    """The logistic function."""
    return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500.0, 500.0))))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(draw, toxic, text): the labelled rows of the training fold, one of equal rows, about TRAIN_ROWS of them."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() % 4 != 2)).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    ids = materialize(ids, "labelled")
    share = lambda rows: F.lit(min(1.0, TRAIN_ROWS / max(1, rows)) * (1 << 31))
    # so few ids that they can be broadcast (checked); should some stand in many documents, their rows are drawn, too
    ids = few(materialize(ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < share(ids.count())), "drawn"))
    known = docs.join(ids, F.col("doc_id") == F.col("id"))
    draw = F.xxhash64(F.lit(11), "doc_id", "text")
    rows = known.count()
    return known.select(draw.alias("draw"), "toxic", "text").where(F.pmod(F.col("draw"), F.lit(1 << 31)) < share(rows)).dropDuplicates(["draw"])


def learned(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weight of each bucket, and the intercept behind them."""
    rows = materialize(training_rows(docs, labels).withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(SHARDS))), "labelled-texts")
    total = rows.agg(F.count("*").alias("rows"), F.sum("toxic").alias("toxic")).first()
    count, toxic = total["rows"], total["toxic"] or 0
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    if not 0 < toxic < count:
        out = np.zeros(BUCKETS + 1, np.float32)
        out[-1] = 500.0 if toxic else -500.0
        return out
    z[-1] = -np.log(toxic / (count - toxic)) * BETA / ALPHA  # the intercept starts at the share of toxic rows
    for _ in range(EPOCHS):
        z, n = _averaged(rows, z, n)
    return Learner(z, n).weights(slice(None)).astype(np.float32)


def _averaged(rows: DataFrame, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the shards' states after a pass from the given one."""
    z, n = z.astype(np.float32), n.astype(np.float32)  # as they travel
    shared = rows.sparkSession.sparkContext.broadcast((z, n))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's changes, a row for each run of buckets."""
        last, learner = None, None

        def changes() -> pa.RecordBatch:
            z, n = shared.value
            at = np.flatnonzero(learner.n != n)
            cut = np.split(at, np.flatnonzero(np.diff(at // RUN)) + 1) if len(at) else []
            blobs = [pa.array([f(c).tobytes() for c in cut], pa.binary()) for f in (lambda c: (c % RUN).astype(np.uint16), lambda c: (learner.z[c] - z[c]).astype(np.float32), lambda c: (learner.n[c] - n[c]).astype(np.float32))]
            return pa.RecordBatch.from_arrays([pa.array([int(c[0]) // RUN for c in cut], pa.int32()), pa.array([last] * len(cut), pa.int64()), *blobs], names=["run", "shard", "at", "z", "n"])

        for batch in batches:
            for shard, toxic, terms in zip(batch.column("shard").to_pylist(), batch.column("toxic").to_pylist(), term_lists(batch.column("text").to_pylist())):
                if shard != last:
                    if learner is not None:
                        yield changes()
                    last, learner = shard, Learner(*(a.astype(float) for a in shared.value))
                learner.learn(features(terms), toxic)
        if learner is not None:
            yield changes()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of all shards' changes by bucket, added in the order of shards."""
        last, z, n = None, np.zeros(RUN), np.zeros(RUN)

        def sums() -> pa.RecordBatch:
            at = np.flatnonzero((z != 0) | (n != 0))
            return pa.RecordBatch.from_arrays([pa.array(at + last * RUN), pa.array(z[at]), pa.array(n[at])], names=["at", "z", "n"])

        for batch in batches:
            for run, *blobs in zip(*(batch.column(c).to_pylist() for c in ("run", "at", "z", "n"))):
                if run != last:
                    if last is not None:
                        yield sums()
                    last, z, n = run, np.zeros(RUN), np.zeros(RUN)
                at = np.frombuffer(blobs[0], np.uint16)
                z[at] += np.frombuffer(blobs[1], np.float32)
                n[at] += np.frombuffer(blobs[2], np.float32)
        if last is not None:
            yield sums()

    changed = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "draw").mapInArrow(passed, "run int, shard long, at binary, z binary, n binary")
    found = changed.repartition(SHARDS, "run").sortWithinPartitions("run", "shard").mapInArrow(added, "at long, z double, n double").toArrow()  # a row a bucket at most
    shared.destroy()
    z, n, at = z.astype(float), n.astype(float), np.asarray(found["at"])
    z[at] += np.asarray(found["z"]) / SHARDS
    n[at] += np.asarray(found["n"]) / SHARDS
    return z, n


def score_texts(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of docs and score; docs needs a column text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            found = [score(margin(w, t)) for t in term_lists(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def margin(weights: np.ndarray, terms: np.ndarray) -> float:
    """The sum of the weights of a text's distinct features."""
    used = []
    for start in range(0, len(terms), SLICE):  # a slice repeats the terms that its pairs reach
        at = buckets(terms[max(0, start - SKIPPED - 1) : start + SLICE])
        used.append(np.unique(at[weights[at] != 0]))
    at = np.unique(np.concatenate(used)) if used else np.zeros(0, np.int64)
    return float(weights[at].astype(float).sum() + weights[-1])


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows for all documents, learned from the labelled training fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    out = score_texts(docs, learned(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
