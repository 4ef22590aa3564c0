"""Language identification by prediction with partial matching.

Each language has a context tree over UTF-8 bytes: contexts of 0 to ORDER bytes with the counts of
the bytes that followed them (PPM, escape method C). The counts are learned from a sample of whole
labelled documents of every label and then frozen. A text's code length under a language is exact: each byte costs
its probability in the longest context seen, after the escapes of the longer ones. The language with
the shortest code wins; the score is its posterior under equal priors.

The code length of a byte depends on the window of its ORDER predecessors and itself alone, so a
worker looks windows up in a table of those frequent in training and works out the others, each
distinct one of a batch once, from the trees.

Nulls and empty texts, and texts without a letter: ``und``, score 0. Rows with a null label are never
learned from. With no labelled row at all every row is ``und``. Ties go to the label that sorts first.
Repeated rows are scored each; other input columns are never read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, fold, materialize, table, text_or_empty

ORDER = 3
#: Documents of a language that the trees are learned from (about).
TRAIN_DOCS = 1500
#: Bits of a slot's number in the table of frequent windows, for up to 16 labels; fewer beyond, so that the table keeps its size.
SLOT_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a character of a Unicode letter class."""
    m = _LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(c.isalpha() for c in text))


def windows(data: bytes) -> np.ndarray:
    """The window of each byte of ``data`` (its three predecessors and itself, the byte itself lowest); zeros stand before the start."""
    b = np.frombuffer(b"\0" * ORDER + data, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


class Trees:
    """Frozen statistics: windows and their costs in bits for each language."""

    def __init__(self, labels: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each label the distinct windows of its sample and how often each came."""
        self.labels = labels
        n = len(labels)
        self.keys, self.cost, self.contexts, self.escape = [], [], [], []
        for k in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            seen, context = [], []
            for w, c in counts:
                key, inverse = np.unique(w & mask, return_inverse=True)
                total = np.bincount(inverse, c, len(key)) if len(key) else np.zeros(0)
                ctx, of = np.unique(key >> np.uint32(8), return_inverse=True)
                size = np.bincount(of, total, len(ctx)) if len(ctx) else np.zeros(0)
                kinds = np.bincount(of, minlength=len(ctx))
                seen.append((key, -np.log2(total / (size + kinds)[of]) if len(key) else total))
                context.append((ctx, -np.log2(kinds / (size + kinds)) if len(ctx) else size))
            keys = np.unique(np.concatenate([s[0] for s in seen] or [np.zeros(0, np.uint32)]))
            ctxs = np.unique(np.concatenate([s[0] for s in context] or [np.zeros(0, np.uint32)]))
            escape = np.zeros((len(ctxs), n))
            for j, (ctx, value) in enumerate(context):
                escape[np.searchsorted(ctxs, ctx), j] = value
            self.contexts.append(ctxs)
            self.escape.append(escape)
            cost = self._escaped(keys, k) if len(keys) else np.zeros((0, n))
            for j, (key, value) in enumerate(seen):
                cost[np.searchsorted(keys, key), j] = value
            self.keys.append(keys)
            self.cost.append(cost)

    def _escaped(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Costs of windows of k+1 bytes whose last byte was not seen in their context of k bytes."""
        ctx = keys >> np.uint32(8)
        out = self.costs(keys & np.uint32((1 << 8 * k) - 1), k - 1) if k else np.full((len(keys), len(self.labels)), 8.0)
        if len(self.contexts[k]):
            at = np.minimum(np.searchsorted(self.contexts[k], ctx), len(self.contexts[k]) - 1)
            out = out + np.where((self.contexts[k][at] == ctx)[:, None], self.escape[k][at], 0.0)
        return out

    def costs(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits of each window's last byte, one column for each language."""
        if not len(self.keys[k]):
            return self._escaped(keys, k)
        at = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
        known = self.keys[k][at] == keys
        out = self.cost[k][at]
        if not known.all():
            out[~known] = self._escaped(keys[~known], k)
        return out


class Scorer:
    """Code lengths of texts, by a table of the windows most frequent in training."""

    def __init__(self, trees: Trees, frequent: np.ndarray):
        """frequent: training windows, the most frequent first."""
        self.trees = trees
        self.shift = np.uint64(64 - max(4, SLOT_BITS - max(0, (len(trees.labels) - 1).bit_length() - 4)))
        self.slot_key = np.zeros(1 << (64 - int(self.shift)), np.uint32)
        self.slot_cost = trees.costs(self.slot_key) if trees.labels else np.zeros((len(self.slot_key), 0))
        slots, first = np.unique(self.slots(frequent), return_index=True)
        self.slot_key[slots] = frequent[first]
        self.slot_cost[slots] = trees.costs(frequent[first])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def bits(self, data: bytes) -> np.ndarray:
        """Code length of a text in bits under each language."""
        total = np.zeros(len(self.trees.labels))
        for at in range(0, len(data), 1 << 20):  # bounded memory for very long texts
            lead = data[max(0, at - ORDER) : at]
            keys = windows(data[at - len(lead) : at + (1 << 20)])[len(lead) :]
            slots = self.slots(keys)
            known = self.slot_key[slots] == keys
            if len(keys) <= 1 << 15 and len(self.trees.labels) <= 16:
                total += np.take(self.slot_cost, slots[known], axis=0).sum(axis=0)
            else:
                hits = np.bincount(slots[known])
                used = np.flatnonzero(hits)
                total += hits[used] @ self.slot_cost[used]
            if not known.all():
                missed, times = np.unique(keys[~known], return_counts=True)
                total += times @ self.trees.costs(missed)
        return total

    def predict(self, text: str) -> tuple[str, float, float]:
        """Label, score and bits a byte of the winner."""
        if not self.trees.labels or not has_letter(text):
            return "und", 0.0, 0.0
        data = text.encode()
        bits = self.bits(data)
        best = int(np.argmin(bits))
        odds = np.exp2(-np.minimum(bits - bits[best], 1000.0))
        return self.trees.labels[best], float(1.0 / odds.sum()), float(bits[best] / len(data))


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            by.setdefault(label, []).append(text.encode())
        for label, parts in by.items():
            key, n = np.unique(np.concatenate([windows(p) for p in parts]), return_counts=True)
            if label in sums:
                both, inverse = np.unique(np.concatenate([sums[label][0], key]), return_inverse=True)
                sums[label] = both, np.bincount(inverse, np.concatenate([sums[label][1], n])).astype(np.int64)
            else:
                sums[label] = key, n
    for label, (key, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["label", "window", "n"])


def learn(labelled: DataFrame) -> tuple[Trees, np.ndarray]:
    """Trees from rows (label, text, draw) without nulls, and the sample's windows, the most frequent first.

    draw is uniform in [0, 1) and drawn for each row apart, so that copies are not drawn together. The
    sample has TRAIN_DOCS whole documents of every label (in expectation); their distinct windows, with counts, reach the driver.
    """
    sizes = materialize(labelled.groupBy("label").count(), "labels")
    sample = labelled.join(few(sizes), "label").where(F.col("draw") < F.lit(float(TRAIN_DOCS)) / F.col("count"))
    rows = sample.select("label", "text").mapInArrow(_count_windows, "label string, window long, n long").groupBy("label", "window").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return Trees([], []), np.zeros(0, np.uint32)
    labels = sorted(rows["label"].unique())
    counts = []
    for label in labels:
        part = rows[rows["label"] == label].sort_values("window")
        counts.append((part["window"].to_numpy().astype(np.uint32), part["n"].to_numpy().astype(float)))
    total = rows.groupby("window")["n"].sum().sort_index().sort_values(ascending=False, kind="stable")
    return Trees(labels, counts), total.index.to_numpy().astype(np.uint32)


_WORKER: dict = {}


def identify(docs: DataFrame, model: tuple[Trees, np.ndarray]) -> DataFrame:
    """All columns of docs and lang_pred, score, bits_per_byte; docs needs a column text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    frozen, token = docs.schema, uuid.uuid4().hex

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _WORKER.get(token)
        if scorer is None:
            _WORKER.clear()
            scorer = _WORKER[token] = Scorer(*shared.value)
        for batch in batches:
            found = [scorer.predict(t or "") for t in batch.column("text").to_pylist()]
            arrays = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"])

    return docs.mapInArrow(scored, T.StructType([*frozen.fields, *T._parse_datatype_string("lang_pred string, score double, bits_per_byte double").fields]))


def training_rows(docs: DataFrame) -> DataFrame:
    """(label, text, draw) of the training fold: crc32 of the id not divisible by five, label and text not null."""
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return docs.where((fold() % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("label"), F.col("text").cast("string").alias("text"), draw.alias("draw"))


def reject_unidentified(docs: DataFrame) -> DataFrame:
    """Documents in some learned language: those without a letter or with a score below one half go. Columns as given."""
    names = docs.columns
    inner = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col("text").alias("text"))
    kept = identify(inner, learn(training_rows(docs))).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: predictions for all documents, learned from the training fold."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", text_or_empty().alias("text")), learn(training_rows(docs)))
    return out.select("doc_id", (fold() % 5 == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")
