"""URL filters: fixed rules, else naive Bayes over segmented host names and path tokens.

Host names are split at dots, hyphens and digits; each piece is segmented into words by a unigram
Viterbi pass. The unigram model has the exact counts of all words (2 to LONGEST letters) of the texts
of all pages, without markup; each distinct host meets those of its substrings that are words by a
join. A multinomial naive Bayes model then scores the words of the host and the tokens of the path,
each distinct url once; its table of all tokens is joined, too. It learns from all pages that a rule
decides, with the rule's verdict as the label, and judges the others; tokens of none of them say nothing.

Nulls: a null url, like one without ``://``, has an empty host and path, fits no rule and gets the
verdict of the label priors; even odds allow. A null page_id stays null. Repeated rows are judged
each. Other input columns are ignored. With no page at all there is nothing to judge.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, materialize, table

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LONGEST = 24  # letters of a word
SMOOTHING = 1.0
#: What is no text in a page: scripts, styles, comments, tags, character references.
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]+;"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (null where none fits)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    out = pages.select(F.col("page_id"), rest.alias("rest"))
    host = F.regexp_extract("rest", r"\A([^/?#]*)", 1)
    out = out.select("page_id", _ascii_lower(host).alias("host"), F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"))
    rule = verdict = None
    for said, name, path in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)):  # the longest wins
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(path)
        rule = F.when(fits, name + path) if rule is None else rule.when(fits, name + path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


def pieces(host: str) -> list[str]:
    """Runs of letters of a host name."""
    return re.findall(r"[^\W\d_]+", host)


class Segmenter:
    """Most probable split of a concatenated name into words under a unigram model."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """counts: of all words that the names can hold; total: of all words, where these are not all."""
        self.counts = {w: n for w, n in counts.items() if n > 0}
        self.total = float((sum(self.counts.values()) if total is None else total) + 1)
        self.cost = {w: -math.log(n / self.total) for w, n in self.counts.items()}
        self.segment = lru_cache(100_000)(self._segment)

    def unknown(self, size: int) -> float:
        return math.log(self.total) + 2.5 * size

    def _segment(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                options.append((best[start] + self.cost.get(word, self.unknown(end - start)), start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(words))

    def host_words(self, host: str) -> list[str]:
        return [w for piece in pieces(host) for w in self.segment(piece)]


def tokens(words: list[str], path: str) -> list[str]:
    """Features: h:word for host words, p:token for path tokens; numbers are one token."""
    return ["h:" + w for w in words] + ["p:#" if t.isdigit() else "p:" + t for t in re.findall(r"[^\W_]+", path.lower())]


def word_counts(pages: DataFrame, text_col: str = "html") -> tuple[DataFrame, int]:
    """(w, n) of all words of all pages' texts; the sum of n."""
    plain = F.lower(F.regexp_replace(F.col(text_col), MARKUP, " "))
    words = pages.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("w")).where(F.length("w").between(2, LONGEST))
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    return counts, int(counts.agg(F.sum("n")).first()[0] or 0)


def host_table(hosts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """host and host_words (array) of distinct hosts."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host in batch.column("host").to_pylist():
                found = sorted({p[i:j] for p in pieces(host) for i in range(len(p)) for j in range(i + 2, min(len(p), i + LONGEST) + 1)})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found, pa.string())], names=["host", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts_ = batch.column("host").to_pylist()
            found = [Segmenter({x["w"]: x["n"] for x in known or []}, total).host_words(h) for h, known in zip(hosts_, batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.list_(pa.string()))], names=["host", "host_words"])

    hosts = materialize(hosts, "hosts")
    known = hosts.mapInArrow(candidates, "host string, w string").join(few(words), "w").groupBy("host").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    return materialize(hosts.join(known, "host", "left").mapInArrow(split, "host string, host_words array<string>"), "split")


def judge(pages: DataFrame, url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, host_words and block_score of every page."""
    parsed = parse(pages, url_col)
    hosts = host_table(parsed.select("host").distinct(), *word_counts(pages, text_col))
    # whether a table is small goes by the bytes of its texts: long urls count as several rows
    units = lambda *columns: F.ceil(sum((F.octet_length(c) for c in columns), F.lit(0)) / F.lit(64)) + 1

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(w, p) for w, p in zip(batch.column("host_words").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "tokens"])

    urls = parsed.groupBy("host", "path", F.col("rule_verdict").alias("label")).agg(F.count("*").alias("n")).join(few(hosts, units("host")), "host").select("host", "path", "n", "label", "host_words", F.array_join("host_words", " ").alias("split"))
    urls = materialize(urls.mapInArrow(featured, T.StructType([*urls.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))])), "urls")
    both = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(k) for k in ("allow", "block")]
    counted = materialize(urls.where(F.col("label").isNotNull()).select("n", "label", F.explode("tokens").alias("token")).groupBy("token").agg(*both), "tokens")
    documents = urls.agg(*both).first()
    kinds, *sums = counted.agg(F.count("*"), F.sum("allow"), F.sum("block")).first()
    allow, block = ((x or 0) + SMOOTHING * (kinds + 1) for x in sums)
    # multinomial naive Bayes with add-one smoothing; the odds are summed in order, so that runs agree
    prior = math.log(((documents["block"] or 0) + SMOOTHING) / ((documents["allow"] or 0) + SMOOTHING))
    odds = F.log((F.col("block") + SMOOTHING) / F.lit(block)) - F.log((F.col("allow") + SMOOTHING) / F.lit(allow))
    each = urls.select("host", "path", F.explode("tokens").alias("token")).join(few(counted), "token").groupBy("host", "path").agg(F.array_sort(F.collect_list(odds)).alias("odds"))
    z = F.aggregate(F.coalesce("odds", F.array().cast("array<double>")), F.lit(prior), lambda s, x: s + x)
    score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))
    scored = materialize(urls.join(each, ["host", "path"], "left").select("host", "path", F.col("split").alias("host_words"), score.alias("block_score")), "scored")
    out = parsed.join(few(scored, units("host", "path", "host_words")), ["host", "path"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "host_words", "block_score")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows for all pages."""
    return judge(table(spark, sf_dir, "pages"))
