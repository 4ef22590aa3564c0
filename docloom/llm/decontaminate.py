"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

An item is contained in a document when at least CONTAINED percent of the item's distinct shingles
(five words; an item of fewer words is one shingle of that many) are in the document. Items are
partitioned by the size of their shingle sets, in powers of two. A partition's sketches are bottom-k
MinHashes: the k least shingle hashes of each item. k is what an item of the partition's upper size
may miss, plus the hits that the partition asks for, more of them for larger items. A document is a
candidate for an item when it is long enough for it and holds so many of its sketch that the missing
ones are no more than a contained item may miss: the search loses nothing, and larger items are not
taken up for one chance hit. (Banded MinHash on both sides loses short items in long documents: their
Jaccard similarity tends to nothing.) Every candidate pair is then verified on the shingles' texts.

Everything is built from Spark's own functions. Where the sketches are few (checked), they go into
the plan as one literal and the search needs no shuffle; beyond that they are broadcast while their
number allows it (checked), and only then joined with documents' shingle hashes by a shuffle.

Nulls and texts without a word: no shingles, contained in nothing and containing nothing. Rows
whose ids repeat are searched each; equal result rows may repeat then. Other input columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, table, text_or_empty

WORDS = 5
CONTAINED = 75  # percent
#: Sketch values that may go into the plan.
LITERAL = 20_000
#: Sketch values of an item that partitions of large items ask for, at most.
ASKED = 4


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """body(value) with value worked out once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(words: Column, length: int) -> Column:
    """0-based starts of the shingles of that many words."""
    last = F.size(words) - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, length: int) -> Column:
    """A hash of each shingle of that many words, with repeats."""
    return F.transform(_starts(words, length), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(length))))


def may_miss(n: Column) -> Column:
    """Shingles that a contained item of n may miss."""
    return n - F.ceil(n * CONTAINED / 100).cast("int")


def sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, length, texts, partition (power of two of the set's size), sketch (the least hashes, ascending), hits (of the sketch, at least) and words (of a document, at least) of every item with words."""
    w = items.select(F.col(id_col).alias("item_id"), words_of(text_or_empty(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.size("w"), F.lit(WORDS)))
    of = lambda f: F.coalesce(*(F.when(F.col("length") == n, f(n)) for n in range(1, WORDS + 1)))
    texts = lambda n: F.array_distinct(F.transform(_starts(F.col("w"), n), lambda i: F.array_join(F.slice("w", i + 1, n), " ")))
    hashes = lambda n: F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), n)))
    h = w.select("item_id", "length", of(texts).alias("texts"), of(hashes).alias("hashes")).withColumn("partition", F.ceil(F.log2(F.size("texts"))).cast("int"))
    upper, n = F.pow(F.lit(2), F.col("partition")).cast("int"), F.size("hashes")
    asked = F.least(F.lit(ASKED), F.greatest(F.lit(1), F.col("partition") - 2))
    h = h.withColumn("sketch", F.slice("hashes", F.lit(1), F.least(may_miss(upper) + asked, n)))
    return h.select("item_id", "length", "texts", "partition", "sketch", (F.size("sketch") - may_miss(n)).alias("hits"), (n - may_miss(n) + F.col("length") - 1).alias("words"))


def search(docs: DataFrame, items: DataFrame, literal: int = LITERAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item and n_shared (distinct shingles) of all contained pairs."""
    sk = materialize(sketches(items), "sketches")  # small beside the documents; worked out once
    values = materialize(sk.select("length", F.explode("sketch").alias("hit"), "item_id", "hits", "words"), "values")
    lengths = sorted(r["length"] for r in sk.select("length").distinct().collect())
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    some = values.select("length", "hit").distinct().limit(literal + 1).collect()
    words = words_of(F.col("text"))
    listed = few(values.select("hit", "item_id", "hits", "words"))
    h = F.xxhash64("text").alias("h")
    if len(some) <= literal:
        wanted = {n: [r["hit"] for r in some if r["length"] == n] for n in lengths}
        hits = lambda w: F.concat(*(F.filter(shingle_hashes(w, n), lambda h: h.isin(wanted[n])) for n in lengths)) if lengths else F.array().cast("array<bigint>")  # noqa: E731,B023
    else:
        hits = lambda w: F.concat(*(shingle_hashes(w, n) for n in lengths))
    sized = _bound(words, lambda w: F.struct(F.size(w).alias("n"), F.array_distinct(hits(w)).alias("hits")))
    if len(some) <= literal:  # few documents have a hit; those are read once
        d = materialize(d.select("doc_id", "text", sized.alias("s")).where(F.size("s.hits") > 0), "hits")
        found = d.select("doc_id", h, "s.n", F.explode("s.hits").alias("hit"))
    else:
        found = d.select("doc_id", h, sized.alias("s")).select("doc_id", "h", "s.n", F.explode("s.hits").alias("hit"))
    # texts come back once for each pair that has enough hits, not with every hit
    enough = (F.size(F.collect_set("hit")) >= F.first("hits")).alias("enough")
    hit = found.join(listed, "hit").where("n >= words").groupBy("doc_id", "h", "item_id").agg(enough).where("enough")
    t = d.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text").dropDuplicates(["_id", "_h"])
    near = hit.join(t, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    # exact: each of the item's shingles, between blanks, in the document's words, between blanks
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    shared = _bound(spaced, lambda t: F.size(F.filter("texts", lambda s: F.contains(t, F.concat(F.lit(" "), s, F.lit(" "))))))
    found = near.join(sk.select("item_id", "texts"), "item_id").select("doc_id", "item_id", F.size("texts").alias("n_item"), shared.alias("n_shared"))
    return found.where(F.col("n_shared") * 100 >= F.col("n_item") * CONTAINED)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of docs that contain no item; columns as given. A row is known by its id and its text, nulls included."""
    key = F.struct(F.col("doc_id"), F.xxhash64(F.col("text")))
    found = few(materialize(search(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("found")).distinct(), "found"))
    marked = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), key.alias("key"))
    return marked.join(found, F.col("key").eqNullSafe(F.col("found")), "left_anti").select("row.*")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (document, benchmark item) pairs with containment."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = """WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
sizes AS (SELECT item_id, w, least(len(w), 5) AS n FROM items WHERE len(w) > 0),
needles AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM sizes),
counts AS (SELECT item_id, count(*) AS n_item FROM needles GROUP BY item_id),
straws AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s
  FROM docs, (SELECT DISTINCT n FROM sizes) WHERE len(w) >= n)
SELECT doc_id, item_id, n_item::INTEGER AS n_item, count(*)::INTEGER AS n_shared
FROM straws JOIN needles USING (s) JOIN counts USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 75"""
