"""Exact token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths, in tokens, of the corpus's most frequent pre-tokens;
its entries come from Spark's mergeable top-k sketch over all documents, so only bounded sketches
move between executors. Tier two is a cache in each Python worker that encodes a missed pre-token
once. No pre-token is ever shuffled. The counts do not depend on what the tables hold.

Pre-tokens are split here only for texts of well-settled characters; any other text goes whole
through the library.

Nulls: a null text is the empty text (0 bytes, 0 tokens); a null id stays null. Repeated rows are
counted and returned each. Other input columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty, texts

#: Entries of the broadcast table (the sketch's top k) and items that the sketch tracks.
FREQUENT = 10_000
TRACKED = 100_000
#: Sketches that one task merges at most, beside those of a run.
RUNS = 32
#: Entries of a worker's cache; a full cache starts again from the broadcast table.
CACHED = 600_000
#: Longer pre-tokens are counted without being kept.
KEPT_CHARS = 64
SETTLED = range(0x0500)  # code points whose Unicode classes no longer change
MORE_SETTLED = [*range(0x2010, 0x2028), 0x20AC]  # dashes, quotes, ellipsis, euro sign


def _class(wanted) -> str:
    """The characters of a regex class for the settled code points for which wanted(char) holds."""
    points, out = [p for p in [*SETTLED, *MORE_SETTLED] if wanted(chr(p))], ""
    start = previous = None
    for p in [*points, None]:
        if start is not None and (p is None or p != previous + 1):
            out += f"\\u{start:04x}-\\u{previous:04x}"
            start = None
        if start is None:
            start = p
        previous = p
    return out


def _patterns() -> tuple[re.Pattern, re.Pattern]:
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    number = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = r"\t-\r \x85\xa0"
    split = rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    known = rf"[\x00-\u{SETTLED[-1]:04x}‐-‧€]*"
    return re.compile(split), re.compile(known)


class Lengths(dict):
    """Token counts by pre-token; what is missing is encoded once and kept."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.frequent, self.tokenizer = frequent, Tokenizer.from_file(path)
        self.special = sorted((str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split, self.known = _patterns()
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def __missing__(self, piece: str) -> int:
        n = self.encode(piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = n
        return n

    def encode(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not (text.isascii() or self.known.fullmatch(text)):
            return self.encode(text)
        if len(self) > CACHED + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        parts = self.cut.split(text) if self.cut else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split.findall(p))) for p in parts)


_WORKER: dict[str, Lengths] = {}


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Token counts of the corpus's most frequent word-like pre-tokens; at most FREQUENT entries."""
    words = docs.select(F.explode(F.expr(f"regexp_extract_all({text_col}, ' ?\\\\p{{L}}+', 0)")).alias("w"))
    # a sketch for each run of partitions, then one of these: no task merges the sketches of all partitions
    runs = words.groupBy((F.spark_partition_id() % RUNS).alias("run")).agg(F.expr(f"approx_top_k_accumulate(w, {TRACKED})").alias("sketch"))
    found = runs.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {FREQUENT})").alias("top")).first()
    top = (found["top"] if found else None) or []
    lengths = Lengths(path, {})
    return {r["item"]: lengths.encode(r["item"]) for r in top if r["item"]}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row; path: a tokenizers .json with a byte-level pre-tokenizer."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    frequent, token = docs.sparkSession.sparkContext.broadcast(frequent_lengths(src, path)), uuid.uuid4().hex

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _WORKER.get(token)
        if lengths is None:
            _WORKER.clear()
            lengths = _WORKER[token] = Lengths(path, frequent.value)
        for batch in batches:
            n = [lengths.count(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    schema = T.StructType([src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return src.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(counted, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Contract digest: token counts of all documents by byte_bpe_50k.json."""
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
