"""Ranked lexical search: a dual-sorted wavelet tree per shard, exact top k by best-first descent.

A shard is a run of documents of one input split, about SHARD_TERMS terms, numbered by ascending id.
Its posting lists stand one after another, each ordered by falling impact (the part of a term's score
that depends on the document). The sequence of their document numbers is a wavelet tree, one bit
vector a level, most significant bit first: going down keeps the order inside a list's range, so at
every node a list's first entry is its greatest impact among the node's documents. The sum of a
query's weighted first entries bounds every document of the subtree, and is the score at a leaf.

A search opens nodes best first, those of equal bounds by least document, until k leaves lead: lists
without a document in a node leave it, nodes below the k-th score known so far are cut. All queries of
a block descend a shard's tree together, each with its own frontier. Shards of a first round say what
score the k-th document reaches at least; the rest are then searched under that bound.

The index is a written table, a row a shard, built from splits as they are: no text is shuffled. A
query reads it as a whole; queries come in blocks of bounded size (BLOCK_TERMS), each broadcast.
Document frequencies are sums over shards; only those of a block's terms reach the driver.

Terms are known by 64-bit hashes. Documents whose text is null or without terms are not counted and
never found. Items without terms find nothing. Repeated rows are documents of their own, each found;
equal scores go by id, null ids last. Items are the distinct (id, text) pairs, so a repeated item is
ranked once, and items of one id with different texts are ranked each. Other input columns are never
read. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, materialize, table
from .terms import term_counts, term_lists

TOP = 10
#: Terms of a shard's documents, about; a longer document is a shard by itself.
SHARD_TERMS = 1 << 20
#: Distinct terms of a block of queries, about.
BLOCK_TERMS = 100_000
#: One shard in so many is searched in the first round.
FIRST = 8
#: Nodes that a query opens at once.
OPENED = 16
#: Parameters of the score: its scale, and in percent how strongly length counts.
SCALE, LENGTH = 1_000_000_000, 75


def collection_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and the terms of all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            n = np.array(term_counts(batch.column("text").to_pylist()), np.int64)
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], names=["docs", "terms"])

    row = docs.select("text").mapInArrow(counted, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row["docs"] or 0, row["terms"] or 0


def impacts(tf: np.ndarray, length: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The document's part of a term's score, below 2**20."""
    m = 100 - LENGTH + LENGTH * length * docs // terms
    return SCALE * tf // (1000 * tf + 8 * m)


class Shard:
    """A dual-sorted wavelet tree: terms (sorted hashes), starts of their lists, impacts in list order, levels of bits."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, impact: np.ndarray, levels: list[np.ndarray], docs: int):
        self.terms, self.starts, self.impact, self.levels, self.docs = terms, starts, impact, levels, docs

    @classmethod
    def build(cls, lists: list[np.ndarray], docs: int, terms: int) -> Shard:
        """Of the term hashes of each document, in the order of documents' numbers; docs, terms: of the whole collection."""
        length = np.array([len(x) for x in lists], np.int64)
        h, d = np.concatenate(lists), np.repeat(np.arange(len(lists)), length)
        order = np.argsort(h, kind="stable")  # documents ascend within a term
        h, d = h[order], d[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        at = np.flatnonzero(new)
        tf, h, d = np.diff(np.append(at, len(h))), h[at], d[at]
        value = impacts(tf, length[d], docs, terms)
        first = np.concatenate(([True], h[1:] != h[:-1]))
        order = np.argsort((np.cumsum(first) - 1 << 20) + ((1 << 20) - 1 - value), kind="stable")
        d, value, starts = d[order], value[order], np.append(np.flatnonzero(first), len(h))
        levels = []
        for k in reversed(range(max(1, (len(lists) - 1).bit_length()))):
            bit = (d >> k & 1).astype(bool)
            levels.append(bit)
            d = np.concatenate([d[~bit], d[bit]])
        return cls(h[first], starts, value, levels, len(lists))

    def row(self) -> tuple[bytes, bytes, bytes, list[bytes]]:
        """As stored: bit vectors packed."""
        return self.terms.tobytes(), self.starts.astype(np.int32).tobytes(), self.impact.astype(np.int32).tobytes(), [np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def read(cls, terms: bytes, starts: bytes, impact: bytes, levels: list[bytes], docs: int) -> Shard:
        value = np.frombuffer(impact, np.int32)
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(value)).astype(bool) for b in levels]
        return cls(np.frombuffer(terms, np.uint64), np.frombuffer(starts, np.int32), value, bits, docs)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms (sorted hashes) the shard has, and their places among its terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        has = np.flatnonzero(self.terms[at] == terms)
        return has, at[has]


class Descent:
    """A shard's tree over the lists that some queries use: zeros before each place, and impacts, by level."""

    def __init__(self, shard: Shard, lists: np.ndarray):
        """lists: places of the wanted terms, ascending. The tree is narrowed to their lists, which keeps every order."""
        self.depth, self.docs = len(shard.levels), shard.docs
        size = np.diff(shard.starts)[lists]
        self.starts = np.concatenate(([0], np.cumsum(size)))
        edge = np.zeros(len(shard.impact) + 1, np.int8)
        np.add.at(edge, shard.starts[lists], 1)
        np.add.at(edge, shard.starts[lists + 1], -1)
        keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        n = int(self.starts[-1])
        self.zeros, self.split, self.value = np.zeros((self.depth, n + 1), np.int32), np.zeros(self.depth, np.int64), np.zeros((self.depth + 1, n), np.int32)
        self.value[0] = shard.impact[keep]
        for k, bit in enumerate(shard.levels):
            own = bit[keep]
            np.cumsum(~own, out=self.zeros[k, 1:])
            self.split[k] = self.zeros[k, -1]
            self.value[k + 1] = np.concatenate([self.value[k][~own], self.value[k][own]])
            keep = np.concatenate([keep[~bit], keep[bit]])

    def top(self, query: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of each query's k best documents that reach its least score and more than nought, best first.

        query, start, end, weight: a query's lists, sorted by query. least: by query.
        """
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        nodes = _Nodes(query[first].astype(np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.add.reduceat(weight * self.value[0][start], first), np.diff(np.append(first, len(query))), start, end, weight)
        nodes = nodes.take((nodes.bound >= least[nodes.query]) & (nodes.bound > 0))
        found, got = [], np.zeros(len(least), np.int64)
        while len(nodes.query):
            order = np.lexsort((nodes.low, -nodes.bound, nodes.query))
            q = nodes.query[order]
            begin = np.concatenate(([True], q[1:] != q[:-1]))
            run = np.flatnonzero(begin)[np.cumsum(begin) - 1]
            rank = np.arange(len(q)) - run
            inner = nodes.level[order] < self.depth
            opened = np.cumsum(inner)
            opened -= (opened - inner)[run]  # inner nodes of the query up to here
            # leaves before any inner node are the query's next best documents
            lead = (opened == 0) & (rank < k - got[q])
            out = order[lead]
            found.append((nodes.query[out], nodes.low[out], nodes.bound[out]))
            np.add.at(got, nodes.query[out], 1)
            kth = np.flatnonzero(~inner)  # k leaves, led or not, bound what is of use
            leaf = np.arange(len(kth)) - np.searchsorted(q[kth], q[kth])
            last = kth[leaf == np.maximum(k - got[q[kth]] + lead_count(lead, q, q[kth]), 1) - 1]
            least[q[last]] = np.maximum(least[q[last]], nodes.bound[order[last]])
            stay = np.zeros(len(q), bool)
            stay[order] = ~lead & (got[q] < k) & (nodes.bound[order] >= least[q])
            pick = np.zeros(len(q), bool)
            pick[order] = inner & (opened <= OPENED)
            pick &= stay
            nodes = nodes.take(stay & ~pick).joined(self.children(nodes.take(pick), least))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        q, d, s = (np.concatenate(x) for x in zip(*found))
        return q, d, s

    def children(self, nodes: _Nodes, least: np.ndarray) -> _Nodes:
        """Both halves of each node, without the lists that have no document there and without halves that cannot reach the least score."""
        each = np.repeat(np.arange(len(nodes.query)), nodes.lists)
        level = nodes.level[each]
        s0, e0 = self.zeros[level, nodes.start].astype(np.int64), self.zeros[level, nodes.end].astype(np.int64)
        split = self.split[level]
        half = 1 << self.depth - 1 - nodes.level
        parts = []
        for start, end, low in ((s0, e0, nodes.low), (split + nodes.start - s0, split + nodes.end - e0, nodes.low + half)):
            has = np.flatnonzero(end > start)
            of, start, end, weight = each[has], start[has], end[has], nodes.weight[has]
            lists = np.bincount(of, minlength=len(nodes.query))
            own = np.flatnonzero(lists)
            if not len(own):
                continue
            bound = np.add.reduceat(weight * self.value[nodes.level[of] + 1, start], np.cumsum(lists[own]) - lists[own])
            half_ = _Nodes(nodes.query[own], nodes.level[own] + 1, low[own], bound, lists[own], start, end, weight)
            parts.append(half_.take((bound >= least[half_.query]) & (bound > 0)))
        out = parts[0] if parts else nodes.take(np.zeros(len(nodes.query), bool))
        return out.joined(parts[1]) if len(parts) > 1 else out


def lead_count(lead: np.ndarray, query: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many leaves have just been given out for each of some queries; query is sorted."""
    total = np.concatenate(([0], np.cumsum(lead)))
    return total[np.searchsorted(query, of, side="right")] - total[np.searchsorted(query, of)]


class _Nodes:
    """Nodes of queries' frontiers, each with a range for every list that has documents there."""

    def __init__(self, query, level, low, bound, lists, start, end, weight):
        self.query, self.level, self.low, self.bound, self.lists, self.start, self.end, self.weight = query, level, low, bound, lists, start, end, weight

    def take(self, mask: np.ndarray) -> _Nodes:
        each = np.repeat(mask, self.lists)
        return _Nodes(self.query[mask], self.level[mask], self.low[mask], self.bound[mask], self.lists[mask], self.start[each], self.end[each], self.weight[each])

    def joined(self, other: _Nodes) -> _Nodes:
        return _Nodes(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("query", "level", "low", "bound", "lists", "start", "end", "weight")))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, int]:
    """The index, a row a shard, and the number of documents with terms."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, n_terms = collection_size(src)
    id_type = src.schema["doc_id"].dataType
    arrow = pa.list_(to_arrow_type(id_type))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = number = 0

        def shard() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0))
            made = Shard.build([x[1] for x in held], n_docs, n_terms)
            terms, starts, impact, levels = made.row()
            arrays = [pa.array([number], pa.int64()), pa.array([[x[0] for x in held]], arrow), *(pa.array([x], pa.binary()) for x in (terms, starts, impact)), pa.array([levels], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, terms in zip(ids, term_lists(batch.column("text").to_pylist())):
                if not len(terms):
                    continue
                if held and size + len(terms) > shard_terms:
                    yield shard()
                    held.clear()
                    size, number = 0, number + 1
                held.append((i, terms))
                size += len(terms)
        if held:
            yield shard()

    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("docs", T.ArrayType(id_type)), *T._parse_datatype_string("terms binary, starts binary, impact binary, levels array<binary>").fields])
    names = schema.names
    return materialize(src.where(F.col("text").isNotNull()).mapInArrow(built, schema), "index"), n_docs


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, h, term, times): the distinct terms of each distinct item; h is a hash of its text."""
    src = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct().withColumn("h", F.xxhash64("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(t, return_counts=True) for t in term_lists(batch.column("text").to_pylist())]
            size = [len(t) for t, _ in found]
            at = pa.array(np.repeat(np.arange(len(found)), size))
            term, times = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("h").take(at), pa.array(term.view(np.int64)), pa.array(times.astype(np.int64))], names=["item", "h", "term", "times"])

    schema = T.StructType([src.schema["item"], *T._parse_datatype_string("h long, term long, times long").fields])
    return src.mapInArrow(counted, schema)


def frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many documents each of some terms (sorted hashes) stands."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for t, s in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
                has, at = Shard(np.frombuffer(t, np.uint64), np.zeros(0), np.zeros(0), [], 0).find(wanted)
                total[has] += np.diff(np.frombuffer(s, np.int32))[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["term", "df"])

    rows = index.select("terms", "starts").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"] & (1 << 64) - 1: r["df"] for r in rows.collect()}  # terms of the block only


def _best(shards: DataFrame, queries: tuple, least: np.ndarray, k: int) -> DataFrame:
    """(q, doc_id, score): the k best documents of each query in each task's shards, and what ties with them."""
    shared = shards.sparkSession.sparkContext.broadcast((*queries, least))
    id_type = next(f for f in shards.schema if f.name == "docs").dataType.elementType

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, query, term, weight, least = shared.value  # query, term (place in terms), weight: sorted by query
        least = least.copy()
        kth = [np.zeros(0, np.int64)] * len(least)  # scores of the task's best so far
        for batch in batches:
            for number in range(batch.num_rows):
                t, s, i = (batch.column(c)[number].as_py() for c in ("terms", "starts", "impact"))
                shard = Shard.read(t, s, i, batch.column("levels")[number].as_py(), len(batch.column("docs")[number]))
                has, at = shard.find(terms)
                place = np.full(len(terms), -1)
                place[has] = np.arange(len(has))
                own = np.flatnonzero(place[term] >= 0)
                if not len(own):
                    continue
                tree = Descent(shard, at)
                list_ = place[term[own]]
                q, d, score = tree.top(query[own], tree.starts[list_], tree.starts[list_ + 1], weight[own], least.copy(), k)
                for x in np.unique(q).tolist():
                    best = np.sort(np.concatenate([kth[x], score[q == x]]))[::-1][:k]
                    kth[x] = best
                    if len(best) == k:
                        least[x] = max(least[x], int(best[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("docs")[number].values.take(pa.array(d)), pa.array(score)], names=["q", "doc_id", "score"])

    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return shards.select("docs", "terms", "starts", "impact", "levels").mapInArrow(searched, schema)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", shard_terms: int = SHARD_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    index, n_docs = build_index(docs, id_col, shard_terms=shard_terms)
    terms = materialize(query_terms(items, item_col), "query-terms")
    id_type, item_type = docs.schema[id_col].dataType, terms.schema["item"].dataType
    blocks = -(-terms.count() // block_terms)
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item", "h"), F.lit(blocks)) == block).orderBy("item", "h", "term").collect()  # one block of queries
        if rows:
            out = out.unionByName(_searched(index, n_docs, rows, item_type, k))
    return out


def _searched(index: DataFrame, n_docs: int, rows: list, item_type: T.DataType, k: int) -> DataFrame:
    """Results of a block of queries: rows (item, h, term, times), sorted."""
    spark = index.sparkSession
    items = list(dict.fromkeys((r["item"], r["h"]) for r in rows))
    number = {x: i for i, x in enumerate(items)}
    term = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    distinct = np.unique(term)
    df = frequencies(index, distinct)
    weight_of = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in distinct.tolist()], np.int64)
    place = np.searchsorted(distinct, term)
    query = np.array([number[r["item"], r["h"]] for r in rows], np.int64)
    weight = weight_of[place] * np.array([r["times"] for r in rows], np.int64)
    use = weight > 0
    queries = (distinct, query[use], place[use], weight[use])
    early = F.pmod(F.xxhash64("number", "docs"), F.lit(FIRST)) == 0
    least = np.zeros(len(items), np.int64)
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    first = materialize(best(_best(index.where(early), queries, least, k)), "first-round")
    for r in first.where(F.col("rank") == k).select("q", "score").collect():  # a number a query of the block
        least[r["q"]] = r["score"]
    found = best(first.drop("rank").unionByName(_best(index.where(~early), queries, least, k)))
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], T.StructType([T.StructField("n", T.LongType()), T.StructField("item_id", item_type)]))
    return found.join(F.broadcast(names), F.col("q") == F.col("n")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: the ten best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_TERMS = "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP12_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
size AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY r, doc_id, n, t),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, size GROUP BY t, n_docs),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, t),
scored AS (SELECT item_id, doc_id, r, sum(times * w * (({SCALE} * tf) // (1000 * tf + 8 * ({100 - LENGTH} + ({LENGTH} * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN weights USING (t) JOIN p USING (t), size GROUP BY item_id, doc_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
