"""N-gram Jaccard self-join: size-aware heavy-light.

A document's set holds its distinct five-word shingles (hashed to 64 bits, as are whole sets). Equal
sets are one class from the start. Every set orders its shingles the rarest first, by a bounded table
of frequent shingles counted over all documents, else by hash; sets that reach the similarity must
then share a shingle among their first n - ceil(t n) + 1, and two among one more.

Light sets (few shingles) enumerate all pairs of that longer prefix and meet others in equal pairs.
Heavy sets post their prefix to inverted lists, which are scanned; light sets near the boundary post
there, too. The boundary is the size of least cost under the sizes and repeats seen in all documents.

A list is not turned into all its pairs. It is scanned in rounds: members of different components are
compared by size and by parity signatures, whose difference bounds the sets' difference from below,
and each component gives out its few closest pairs, which are then checked exactly on whole sets.
Those that hold join components, so most of what a group of near copies holds is never given out.
The first round compares members with HEADS of their list only; the last gives out every pair left.
Lists longer than TILE are scanned tile by tile, without the pairs inside their largest component. No
link that could join two components is lost: a list leaves the rounds when all its pairs have been
dismissed, checked or found within one component.

Nulls and texts without words: empty set, linked with nothing, own component. Null ids: such a row is
compared like others; its component is the least id in it, or null. Repeated rows fall in one class.
Other input columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, few, materialize, most_frequent, partitions, table
from .graph import components
from .hashing import mix, shingle_sets

SIMILAR = 75  # percent
#: Entries of the broadcast table of frequent shingles.
FREQUENT = 200_000
#: Members of a list that all others are compared with in the first round.
HEADS = 64
#: Members of a list that are compared in one go.
TILE = 2048
#: Pairs that a component may give out of a list, round by round; the last round has no limit.
TRIES = (1, 8, 64, None)
#: Members of a list that its name is made of; longer lists are named by their key.
NAMED = 1 << 20
#: Pairs compared at once in a task.
COMPARED = 1 << 17
#: Bytes of signatures taken up at once.
SLICE = 1 << 21
#: Signature bits for each shingle, about; and the least number of bits.
SIGNATURE_BITS, LEAST_BITS = 2, 256
#: Cost of a candidate against that of a key.
CANDIDATE_COST = 20.0


def needed(n: int) -> int:
    """Least overlap of a set of n with any set it links to."""
    return -(-SIMILAR * n // 100)


def needed_by_larger(n: int) -> int:
    """Least overlap of a set of n with a set it links to that is no smaller."""
    return -(-2 * SIMILAR * n // (100 + SIMILAR))


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the set's counts by low bits of the hash; a power of two of bits."""
    bits = max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(1, SIGNATURE_BITS * len(shingles))))))
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def halved(signatures: np.ndarray) -> np.ndarray:
    """Signatures (one a row) of half the bits."""
    half = signatures.shape[1] // 2
    return signatures[:, :half] ^ signatures[:, half:]


def difference_bound(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their signatures."""
    x, y = (np.frombuffer(s, np.uint8)[None] for s in (a, b))
    while x.shape != y.shape:
        x, y = (halved(x), y) if x.shape > y.shape else (x, halved(y))
    return int(np.bitwise_count(x ^ y).sum())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the size, key and signature of its set; of a run of documents the shingles that several hold."""
    held, count = [], 0

    def repeats() -> pa.RecordBatch:
        h = np.concatenate(held)
        held.clear()
        h.sort()
        again, times = np.unique(h[1:][h[1:] == h[:-1]], return_counts=True)
        n = len(again)
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int32()), pa.array(again.view(np.int64)), pa.nulls(n, pa.binary()), pa.array((times + 1).astype(np.int32))], names=["doc_id", "n", "node", "sig", "times"])

    for batch in batches:
        kind = batch.column("doc_id").type
        sets = shingle_sets(batch.column("text").to_pylist())
        keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32())],
            names=["doc_id", "n", "node", "sig", "times"],
        )
        held += sets
        count += sum(map(len, sets))
        if count > 1 << 20:
            yield repeats()
            count = 0
    if count:
        yield repeats()


def boundary(sizes: dict[int, int], repeats: float) -> int:
    """The largest light size: the one of least cost. sizes: sets by size; repeats: of a shingle in others, on average."""
    n = np.array(sorted(sizes), np.int64)
    if not len(n):
        return 0
    count = np.array([sizes[k] for k in n.tolist()], float)
    least = -(-SIMILAR * n // 100)
    pairs = count * (n - least + 2) * (n - least + 1) / 2
    lists = count * (n - least + 1) * (1 + CANDIDATE_COST * repeats)
    best, cut = float(lists.sum()), 0
    for b in n[n <= 4096].tolist():
        cost = float(pairs[n <= b].sum() + lists[100 * n > SIMILAR * b].sum())
        if cost < best:
            best, cut = cost, b
    return cut


def keys_of(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set (pairs of its prefix if it is light, prefix shingles if a heavy set may link to it), and which of them hold when it is the smaller of a pair.

    A set that links to one no smaller shares more with it, so its prefix is shorter then.
    """
    n = len(shingles)
    if n < 2:
        return shingles[:0], np.zeros(0, bool)  # only an equal set links
    order = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        order = np.where(frequent[at] == shingles, rank[at] + 1, 0)
    front = shingles[np.argsort(order, kind="stable")[: n - needed(n) + 2]]
    short = n - needed_by_larger(n)
    keys, small = [], []
    if n <= light:
        i, j = np.triu_indices(len(front), 1)
        low, high = np.minimum(front[i], front[j]), np.maximum(front[i], front[j])
        keys.append(mix(low * np.uint64(0x9E3779B97F4A7C15) ^ high))
        small.append(j < short + 2)
    if 100 * n > SIMILAR * light:
        keys.append(front[: n - needed(n) + 1])
        small.append(np.arange(len(keys[-1])) < short + 1)
    return np.concatenate(keys), np.concatenate(small)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, n, node) sorted by these: the rows of lists of two or more members, under a name that equal lists share.

    n is twice the size, one more where the key does not hold for the smaller of a pair. members is the
    length of the list, or NAMED for any longer one.
    """
    kept, long = np.zeros((3, 0), np.int64), None  # the list at hand; its key once it is longer than NAMED

    def named(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        length = np.diff(np.append(start, rows.shape[1]))
        use = (length > 1) & (np.add.reduceat(1 - (rows[1] & 1), start) > 0)
        name = mix(np.add.reduceat(mix(rows[2].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows[1].view(np.uint64)), start) + length.astype(np.uint64)).view(np.int64)
        each = np.repeat(use, length)
        if each.any():
            yield out(np.repeat(name, length)[each], np.repeat(length, length)[each], rows[1:, each])

    def out(name: np.ndarray, members: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(members.astype(np.int32)), pa.array(rows[0].astype(np.int32)), pa.array(rows[1])], names=["list", "members", "n", "node"])

    for batch in batches:
        rows = np.concatenate([kept, np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "n", "node")])], axis=1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]
        if long is not None:  # goes on with a list that is too long to hold
            own = rows[0] == long
            if own.any():
                yield out(rows[0, own], np.full(int(own.sum()), NAMED), rows[1:, own])
                rows = rows[:, ~own]
            if not rows.shape[1]:
                kept = rows
                continue
            long = None
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        kept = rows[:, last:]
        if last:
            yield from named(rows[:, :last])
        if kept.shape[1] > NAMED:
            long = int(kept[0, 0])
            yield out(kept[0], np.full(kept.shape[1], NAMED), kept[1:])
            kept = kept[:, :0]
    if kept.shape[1]:
        yield from named(kept)


def _differences(signatures: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lower bounds of the differences of pairs of sets whose signatures differ in length by a factor of two at most."""
    size = np.array([len(x) for x in signatures])
    place = np.zeros(len(size), np.int64)
    full, half = {}, {}
    for w in np.unique(size).tolist():
        own = np.flatnonzero(size == w)
        place[own] = np.arange(len(own))
        full[w] = np.frombuffer(b"".join(signatures[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)
        half[w // 2] = halved(full[w])
    least, out = np.minimum(size[left], size[right]), np.zeros(len(left), np.int64)
    for w in np.unique(least).tolist():
        for x, y in ((w, w), (w, 2 * w), (2 * w, w)):
            pairs = np.flatnonzero((least == w) & (size[left] == x) & (size[right] == y))
            step = max(1, SLICE // w)  # long sets have long signatures
            for at in range(0, len(pairs), step):
                some = pairs[at : at + step]
                both = (full[w] if x == w else half[w])[place[left[some]]] ^ (full[w] if y == w else half[w])[place[right[some]]]
                out[some] = np.bitwise_count(both).sum(axis=1)
    return out


def closest_pairs(rows: pa.Table, tries: int | None, heads: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole lists, sorted by list, part and side: pairs (a, b) of classes to check, and the lists that have more.

    side 2: all pairs of such rows; sides 0 and 1: pairs of one with the other. Of the pairs of different
    components that size, key and signatures allow, each component of a list gives out the closest;
    heads: only pairs with so many first rows of a list. Pairs that failed before are given out again:
    every round takes several times as many as the one before, so they take up little room.
    """
    name, part, side, n, node, comp = (np.asarray(rows[c]).astype(np.int64) for c in ("list", "part", "side", "n", "node", "comp"))
    total = len(name)
    first = np.concatenate(([True], (name[1:] != name[:-1]) | (part[1:] != part[:-1])))
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, total))
    group = np.cumsum(first) - 1
    rank = np.arange(total) - start[group]
    partners = np.where(side == 1, np.add.reduceat((side == 0).astype(np.int64), start)[group], np.where(side == 2, rank, 0))
    if heads is not None:
        partners = np.minimum(partners, heads)
    signatures = rows["sig"].to_pylist()
    found = []
    ends = np.cumsum(partners)
    at = 0
    while at < total:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, side="right")))
        count = partners[at:to]
        right = np.repeat(np.arange(at, to), count)
        left = np.repeat(start[group[at:to]] - (np.cumsum(count) - count), count) + np.arange(len(right))
        at = to
        low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        fits = (comp[left] != comp[right]) & (low % 2 == 0) & (100 * (low >> 1) >= SIMILAR * (high >> 1))
        left, right = left[fits], right[fits]
        difference = _differences(signatures, left, right)
        near = (100 + SIMILAR) * difference <= (100 - SIMILAR) * ((n[left] >> 1) + (n[right] >> 1))
        found.append(np.stack([left[near], right[near], difference[near]]))
    left, right, difference = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    more = np.zeros(len(start), bool) if heads is None else (length > heads) & (np.maximum.reduceat(side, start) == 2)
    if tries is not None and len(left):
        which = np.tile(np.arange(len(left)), 2)
        g, c = group[left[which]], np.concatenate([comp[left], comp[right]])
        order = np.lexsort((difference[which], c, g))
        g, c = g[order], c[order]
        begin = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
        place = np.arange(len(order)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
        chosen = np.zeros(len(left), bool)
        chosen[which[order[place < tries]]] = True
        more[group[left[~chosen]]] = True
        left, right = left[chosen], right[chosen]
    low, high = np.minimum(node[left], node[right]), np.maximum(node[left], node[right])
    pairs = np.unique(np.stack([low, high]), axis=1) if len(left) else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1], np.unique(name[start[more]])


class Join:
    """The join's tables over one set of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = self.spark = docs.sparkSession
        bound_batches(spark)
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        schema = T.StructType([T.StructField("doc_id", self.docs.schema["doc_id"].dataType), *T._parse_datatype_string("n int, node long, sig binary, times int").fields])
        profile = materialize(self.docs.mapInArrow(_profile, schema), "profile")
        self.members = profile.where(F.col("times").isNull()).select("doc_id", "n", "node")
        classes = profile.where(F.col("times").isNull() & (F.col("n") > 0)).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        self.classes = materialize(classes, "classes")
        self.repeated = profile.where(F.col("times").isNotNull()).groupBy(F.col("node").alias("shingle")).agg(F.sum("times").alias("times"))

    def keys(self) -> DataFrame:
        """(key, n, node) of every class; n as for the lists."""
        frequent = most_frequent(self.repeated, "times", FREQUENT).orderBy(F.desc("times"), "shingle").toPandas()
        sizes = {r["n"]: r["count"] for r in self.classes.groupBy("n").count().collect()}
        total = sum(n * c for n, c in sizes.items())
        again = self.repeated.agg(F.sum(F.col("times").cast("double") * (F.col("times") - 1))).first()[0] or 0.0
        again -= float((frequent["times"].astype(float) * (frequent["times"] - 1)).sum()) if len(frequent) else 0.0  # those stand last and are rarely posted
        self.light = light = boundary(sizes, again / max(1, total))
        shingles = frequent["shingle"].to_numpy(np.int64).view(np.uint64) if len(frequent) else np.zeros(0, np.uint64)
        order = np.argsort(shingles)
        rank = np.arange(len(shingles))[::-1]  # the most frequent is last in every set
        shared = self.spark.sparkContext.broadcast((shingles[order], rank[order]))

        def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table_, rank_ = shared.value
            seen = set()  # a task posts each of its classes once, so that copies do not make long lists
            for batch in batches:
                sets, node = [], []
                for s in shingle_sets(batch.column("text").to_pylist()):
                    name = xxhash.xxh3_64_intdigest(s.tobytes())
                    if name not in seen:
                        seen.add(name)
                        sets.append(s)
                        node.append(name)
                keys = [keys_of(s, table_, rank_, light) for s in sets]
                twice = np.array([2 * len(s) for s in sets], np.int32)
                for at in range(0, len(keys), 500):
                    part = keys[at : at + 500]
                    size = [len(k) for k, _ in part]
                    small = np.concatenate([x for _, x in part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([k for k, _ in part]).view(np.int64)), pa.array(np.repeat(twice[at : at + 500], size) + (~small).astype(np.int32)), pa.array(np.repeat(np.array(node[at : at + 500], np.uint64).view(np.int64), size))],
                        names=["key", "n", "node"],
                    )

        return self.docs.where(F.col("text").isNotNull()).select("text").mapInArrow(posted, "key long, n int, node long")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of classes that link, checked on whole sets."""

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shingle_sets(batch.column("text").to_pylist())
                keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "set"])

        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.classes.select("node", "doc_id"), "node").select(F.col("doc_id").alias("_id")).distinct(), "wanted")
        texts = self.docs.join(few(wanted), self.docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select("text")
        whole = materialize(texts.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"]), "sets")

        def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= SIMILAR * (len(both) - shared))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
        return joined.mapInArrow(checked, "a long, b long")

    def candidates(self, rows: DataFrame, tries: int | None, heads: int | None) -> DataFrame:
        """(list, a, b): pairs to check (list is null), and lists with more pairs (a and b are null). rows: list, part, side, n, node, comp."""

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def found(rows: pa.Table) -> pa.RecordBatch:
                a, b, more = closest_pairs(rows, tries, heads)
                return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(more)]), *(pa.concat_arrays([pa.array(x), pa.nulls(len(more), pa.int64())]) for x in (a, b))], names=["list", "a", "b"])

            for batch in batches:
                held.append(batch)
                if sum(x.num_rows for x in held) > 2 * TILE:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    name, part = (np.asarray(rows[c]) for c in ("list", "part"))
                    cut = int(np.flatnonzero((name != name[-1]) | (part != part[-1]))[-1]) + 1 if name[0] != name[-1] or part[0] != part[-1] else 0
                    if cut:
                        yield found(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
            if held:
                yield found(pa.Table.from_batches(held))

        rows = rows.join(self.classes.select("node", "sig"), "node")
        rows = rows.select("list", "part", "side", "n", "node", "comp", "sig").repartition(partitions(self.spark), "list", "part").sortWithinPartitions("list", "part", "side", "node")
        return rows.mapInArrow(scanned, "list long, a long, b long")

    @staticmethod
    def tiled(rows: DataFrame, mixed: DataFrame) -> DataFrame:
        """rows (list, n, node, comp) with part and side: long lists in tiles, but for the pairs inside their largest component; mixed: list and members."""
        whole = rows.join(few(mixed.where(F.col("members") <= TILE).select("list")), "list", "left_semi").withColumns({"part": F.lit(0).cast("long"), "side": F.lit(2)})
        long = mixed.where(F.col("members") > TILE)
        if long.isEmpty():
            return whole
        part = rows.join(few(long.select("list")), "list", "left_semi")
        main = part.groupBy("list", "comp").count().groupBy("list").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.max("count").alias("inner"), F.sum("count").alias("all"))
        tiles = lambda c: F.greatest(F.lit(1), F.ceil(c / TILE)).cast("long")
        main = materialize(main.select("list", "main", tiles(F.col("inner")).alias("inner"), tiles(F.col("all") - F.col("inner")).alias("outer")), "tiles")
        part = part.join(few(main), "list").withColumn("inside", F.col("comp") == F.col("main"))
        own = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")))
        part = part.withColumn("own", own)
        place = lambda i, j, kind, side: F.struct(((i * F.col("outer") + j) * 2 + kind).alias("part"), side.alias("side"))
        to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        inner = F.transform(to("outer"), lambda j: place(F.col("own"), j, 0, F.lit(0)))
        across = F.transform(to("inner"), lambda i: place(i, F.col("own"), 0, F.lit(1)))
        among = F.transform(to("outer"), lambda j: place(F.least(j, F.col("own")), F.greatest(j, F.col("own")), 1, F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1)))
        placed = part.withColumn("at", F.explode(F.when(F.col("inside"), inner).otherwise(F.concat(across, among))))
        return whole.unionByName(placed.select("list", "n", "node", "comp", F.col("at.part").alias("part"), F.col("at.side").alias("side")))

    def components(self) -> DataFrame:
        """(node, comp) of every class that links with another."""
        n = partitions(self.spark)
        lists = self.keys().repartition(n, "key").sortWithinPartitions("key", "n", "node").mapInArrow(_lists, "list long, members int, n int, node long")
        lists = materialize(lists.distinct(), "lists")
        # lists that are too long for one task are dealt to several, each with heads of its own
        rows = lists.select("list", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / TILE)).alias("part"), F.lit(2).alias("side"), "n", "node", F.col("node").alias("comp"))
        comp = failed = None
        for k, tries in enumerate(TRIES):
            found = materialize(self.candidates(rows, tries, None if k else HEADS), "found")
            pairs = found.where(F.col("list").isNull()).select("a", "b").distinct()
            pairs = materialize(pairs if failed is None else pairs.join(failed, ["a", "b"], "left_anti"), "pairs")
            links = materialize(self.linked(pairs), "links")
            wrong = pairs.join(links, ["a", "b"], "left_anti")
            failed = materialize(wrong if failed is None else failed.union(wrong), "failed")
            if comp is None:
                comp = materialize(components(links), "comp")
            elif not links.isEmpty():
                named = links.join(comp.toDF("a", "x"), "a", "left").join(comp.toDF("b", "y"), "b", "left")
                merged = materialize(components(named.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))), "merged")
                moved = comp.join(merged.toDF("comp", "new"), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
                comp = materialize(moved.union(merged.join(comp, "node", "left_anti").select("node", "comp")), "comp")
            left = found.where(F.col("list").isNotNull()).select("list").distinct()
            if tries is None or left.isEmpty():
                break
            lists = lists.join(few(materialize(left, "left")), "list", "left_semi")
            rows = materialize(lists.select("list", "n", "node").join(comp, "node", "left").select("list", "n", "node", F.coalesce("comp", "node").alias("comp")), "rows")
            mixed = materialize(rows.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low <> high").select("list", "members"), "mixed")
            if mixed.isEmpty():
                break
            rows = self.tiled(rows, mixed)
        return comp

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, set_key and component_id of every row."""
        comp = self.components()
        least = self.classes.join(comp, "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        linked = comp.join(least, "comp").select("node", "component_id")
        own = self.classes.join(linked, "node", "left").select("node", F.coalesce("component_id", F.col("doc_id")).alias("component_id"))
        # an empty set has no class: its row is its own component
        out = self.members.join(own, "node", "left")
        return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("node").alias("set_key"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets) and component_id of every row of docs."""
    return Join(docs, id_col, text_col).groups()


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group stays. Columns as given; rows without words stay.

    A row is known by its id and its text, nulls included. The row of the least id stays (null ids
    stand last; of equal ids the least hash of the text), and one of its exact repeats.
    """
    row_key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text")).alias("hash"))
    marked = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), row_key.alias("row_key"))  # no name of the input can clash
    groups = near_duplicates(docs.select(row_key.alias("row_key"), "text"), "row_key").where(F.col("n_shingles") > 0)
    keys = groups.groupBy(F.col("doc_id").alias("key")).agg((~F.first("component_id").eqNullSafe(F.col("doc_id"))).alias("gone"), F.count("*").alias("rows"))
    marks = materialize(keys.where("gone or rows > 1"), "marks")
    key_of = lambda marks: marked["row_key"].eqNullSafe(marks["key"])
    listed = few(marks.select("key"))
    kept = marked.join(listed, key_of(listed), "left_anti")
    again = marks.where("not gone").select("key")
    if not again.isEmpty():
        again = few(again)
        kept = kept.union(marked.join(again, key_of(again), "left_semi").dropDuplicates(["row_key"]))
    return kept.select("row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows for all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
