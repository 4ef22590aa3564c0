"""Language-model scores by Brown class-based bigrams.

Words are counted over all training documents. The CLUSTERED most frequent get classes by the
exchange algorithm: each word moves to the class that most raises the likelihood of the class
bigrams. Words move in slices, dealt by a hash: those of a slice against the same counts, which Spark
then sums anew, so classes don't depend on how the words are split among tasks. It ends when no word
moves or a turn of all slices gains less than GAIN. Bigram counts come from all training documents. Every other word seen twice or more then gets the class that most raises the
likelihood given its own contexts, gathered over all training documents; there is no bound on these
words, and their classes are a table. Words seen once stand for unseen ones and share a class with
these. The end token is a class of its own and stands before the first word.

p(word | previous) = p(class | class of previous) * p(word | class). Class transitions are smoothed
towards the class's own frequency; emissions of the last class leave room for an unseen word.

The DICTIONARY most frequent words are scored in the tasks that read the texts. The others are
looked up in the tables of counts and classes by a shuffle, so nothing depends on the vocabulary
fitting anywhere. Words are known by 64-bit hashes.

Nulls: a null text is the empty text (one end token); a null id belongs to the fold of the empty
text. Repeated rows count and are scored each. Other input columns are ignored. Without training
documents every word is unseen. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fold, materialize, most_frequent, partitions, table
from .hashing import word_lists

CLUSTERED, CLASSES = 8192, 32
DICTIONARY = 200_000
#: Slices of the words, which move one after another; slices are halved where moving one lowers the likelihood, until there are more than FINEST.
SLICES, FINEST = 2, 8
#: Relative gain of likelihood by all slices below which the exchange ends.
GAIN = 5e-4
#: Words whose moves are worked out at once.
MOVED = 64
ADD = 0.1
#: Weight of a class's own frequency in its transitions.
PRIOR = 10.0
#: Tokens counted together in a task.
HELD = 1 << 22
_SLOT_BITS = 20
MISSED = 255  # in a path of classes


class Dictionary:
    """Index of a word by its hash; the most frequent words, in order of frequency."""

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        self.slot_key = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.slot_index = np.full(1 << _SLOT_BITS, self.size, np.int32)
        slots, first = np.unique(self._slots(hashes), return_index=True)
        self.slot_key[slots], self.slot_index[slots] = hashes[first], first
        rest = np.setdiff1d(np.arange(self.size), first)
        rest = rest[np.argsort(hashes[rest])]
        self.rest_key, self.rest_index = hashes[rest], rest.astype(np.int32)

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each word; ``size`` for others."""
        slots = self._slots(h)
        out = np.where(self.slot_key[slots] == h, self.slot_index[slots], np.int32(self.size))
        if len(self.rest_key):
            missed = np.flatnonzero(out == self.size)
            at = np.minimum(np.searchsorted(self.rest_key, h[missed]), len(self.rest_key) - 1)
            out[missed] = np.where(self.rest_key[at] == h[missed], self.rest_index[at], np.int32(self.size))
        return out


def _pairs(parts: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    key, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        found = word_lists(batch.column("text").to_pylist())
        parts += found
        size += sum(map(len, found))
        if size > HELD:
            yield _pairs(parts, ["h", "n"])
            parts, size = [], 0
    if size:
        yield _pairs(parts, ["h", "n"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(between: np.ndarray) -> float:
    """Log-likelihood of class bigrams, less what does not depend on the classes."""
    return float(_f(between).sum() - _f(between.sum(axis=1)).sum() - _f(between.sum(axis=0)).sum())


def gains(left: np.ndarray, right: np.ndarray, loops: np.ndarray, m: np.ndarray, movable: int) -> np.ndarray:
    """For each word and class, how much the likelihood rises if the word joins it.

    left, right: counts by class of the words before and after each word, without the word itself;
    loops: counts of the word after itself; m: class bigrams without the word (one matrix for all
    words, or one each).
    """
    m = m if m.ndim == 3 else m[None]
    rows, columns = m.sum(axis=2) + left, m.sum(axis=1) + right  # the word's neighbours keep their classes
    b = np.arange(movable)
    into, out, corner = m[:, :, :movable], m[:, :movable, :], m[:, b, b]
    gain = (_f(into + left[:, :, None]) - _f(into)).sum(axis=1) + (_f(out + right[:, None, :]) - _f(out)).sum(axis=2)
    le, ri, s = left[:, :movable], right[:, :movable], loops[:, None]
    gain += _f(corner + le + ri + s) - _f(corner + le) - _f(corner + ri) + _f(corner)
    rows, columns = rows[:, :movable], columns[:, :movable]
    return gain - (_f(rows + right.sum(axis=1)[:, None] + s) - _f(rows) + _f(columns + left.sum(axis=1)[:, None] + s) - _f(columns))


def best_classes(word: np.ndarray, key: np.ndarray, n: np.ndarray, words: int, m: np.ndarray) -> np.ndarray:
    """Of words that stand in the last class but one, the class whose likelihood gain is largest: as :func:`gains`, over the contexts that a word has.

    word, key, n: contexts sorted by word: side times classes plus class, and counts; m: class bigrams with the words.
    """
    total, other, movable = len(m), len(m) - 2, len(m) - 2
    counts = np.bincount(word * 2 * total + key, n, words * 2 * total).reshape(words, 2, total)
    left, right = counts[:, 0], counts[:, 1]
    gain = np.zeros((words, movable))
    for side, table, back in ((0, m[:, :movable], right), (1, m[:movable, :].T, left)):
        use = np.flatnonzero(key // total == side)
        w, k = word[use], key[use] - side * total
        base = table[k]
        own = k == other  # without the word itself
        base[own] = np.maximum(base[own] - back[w[own], :movable], 0.0)
        part = _f(base + n[use][:, None]) - _f(base)
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else w
        if len(w):
            gain[w[first]] += np.add.reduceat(part, first, axis=0)
    le, ri, corner = left[:, :movable], right[:, :movable], np.diag(m)[:movable]
    gain += _f(corner + le + ri) - _f(corner + le) - _f(corner + ri) + _f(corner)
    rows, columns = m.sum(axis=1)[:movable], m.sum(axis=0)[:movable]
    gain -= _f(rows + right.sum(axis=1)[:, None]) - _f(rows) + _f(columns + left.sum(axis=1)[:, None]) - _f(columns)
    return gain.argmax(axis=1)


def exchange(own: np.ndarray, left: np.ndarray, right: np.ndarray, loops: np.ndarray, between: np.ndarray, movable: int) -> np.ndarray:
    """New classes of some words: for each the one that most raises the likelihood of class bigrams, all against the same counts.

    own: their classes; left, right: counts by class of predecessor and successor; loops: counts of
    the word after itself; between: class bigrams of all words; classes below ``movable`` take words.
    """
    m, out = between.astype(float), own.copy()
    for at in range(0, len(own), MOVED):  # a few at a time bounds memory
        some = np.arange(at, min(len(own), at + MOVED))
        k, a, s = np.arange(len(some)), own[some], loops[some].astype(float)
        le, ri = left[some].astype(float), right[some].astype(float)
        le[k, a] -= s  # contexts without the word itself
        ri[k, a] -= s
        without = np.repeat(m[None], len(some), axis=0)
        without[k, :, a] -= le
        without[k, a, :] -= ri
        without[k, a, a] -= s
        gain = gains(le, ri, s, without, movable)
        best = gain.argmax(axis=1)
        out[some] = np.where(gain[k, best] <= gain[k, a] + 1e-9, a, best)
    return out


def slice_of(word: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a round that a word (its index) moves in."""
    return (word.astype(np.int64) * 2654435761 & 0xFFFFFFFF) * slices >> 32


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, side, other, n) sorted by w as one row for each word: the keys side and other, and the counts."""
    held, last = [], None

    def row() -> pa.RecordBatch:
        side, other, n = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([(side.astype(np.int32) << 24 | other).tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary())], names=["w", "keys", "counts"])

    for batch in batches:
        w, *rest = (np.asarray(batch.column(c)) for c in ("w", "side", "other", "n"))
        cuts = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(w)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and w[a] != last:
                    yield row()
                    held = []
                last = int(w[a])
                held.append([x[a:b] for x in rest])
    if held:
        yield row()


def cluster(bigrams: DataFrame, clustered: int, units: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each unit, class bigrams, and the likelihood after each round. bigrams: (p, c, n) over units; the first ``clustered`` units are words, the others classes of their own."""
    spark = bigrams.sparkSession
    movable = min(classes, max(1, clustered))
    of = np.concatenate([np.arange(clustered) % movable, movable + np.arange(units - clustered)]).astype(np.int32)
    total = movable + units - clustered
    # a word's neighbours on either side; side 1 of every unit has each bigram once
    sides = bigrams.select(F.explode(F.array(F.struct(F.col("c").alias("w"), F.lit(0).alias("side"), F.col("p").alias("other"), "n"), F.struct(F.col("p").alias("w"), F.lit(1).alias("side"), F.col("c").alias("other"), "n"))).alias("x")).select("x.*")
    words = materialize(sides.repartition(partitions(spark), "w").sortWithinPartitions("w").mapInArrow(_by_word, "w int, keys binary, counts binary"), "contexts")

    def dense(batch: pa.RecordBatch, of_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of a batch, their counts by side and class, and after themselves."""
        w = np.asarray(batch.column("w")).astype(np.int64)
        out, loops = np.zeros((len(w), 2, total)), np.zeros(len(w))
        for k, (keys, counts) in enumerate(zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist())):
            keys, counts = np.frombuffer(keys, np.int32), np.frombuffer(counts, np.int64)
            side, other = keys >> 24, keys & 0xFFFFFF
            out[k] = np.bincount(side * total + of_[other], counts, 2 * total).reshape(2, total)
            loops[k] = counts[(side == 1) & (other == w[k])].sum()
        return w, out, loops

    def counted(of: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros((total, total))
            for batch in batches:
                w, out, _ = dense(batch, shared.value)
                np.add.at(m, shared.value[w], out[:, 1])
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["i", "j", "n"])

        m = np.zeros((total, total))
        for r in words.mapInArrow(sums, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
            m[r["i"], r["j"]] = r["n"]
        return m

    def change(of: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """How class bigrams change when words move: only the contexts of those that move are read."""
        shared = spark.sparkContext.broadcast((of, tried))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            old, new = shared.value
            m = np.zeros(total * total)
            add = lambda i, j, n: np.bincount(i.astype(np.int64) * total + j, n, total * total)
            for batch in batches:
                w = np.asarray(batch.column("w"))
                batch = batch.filter(pa.array(old[w] != new[w]))
                for w, keys, counts in zip(batch.column("w").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                    keys, counts = np.frombuffer(keys, np.int32), np.frombuffer(counts, np.int64)
                    other, after = keys & 0xFFFFFF, keys >> 24 == 1
                    c, n = other[after], counts[after]
                    m += add(np.full(len(c), new[w]), new[c], n) - add(np.full(len(c), old[w]), old[c], n)
                    before = ~after & (old[other] == new[other])  # bigrams of two that move count with the first
                    p, n = other[before], counts[before]
                    m += add(old[p], new[w], n) - add(old[p], old[w], n)
            at = np.flatnonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at])], names=["at", "n"])

        out = np.zeros(total * total)
        for r in words.mapInArrow(sums, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out.reshape(total, total)

    between = counted(of)
    reached = [likelihood(between)]
    slices, turn, still, before = SLICES, 0, 0, reached[0]
    while clustered > 1 and slices <= FINEST and still < slices:
        shared, number = spark.sparkContext.broadcast((of, between)), turn % slices

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_, between_ = shared.value
            for batch in batches:
                w = np.asarray(batch.column("w"))
                w, out, loops = dense(batch.filter(pa.array((w < clustered) & (slice_of(w, slices) == number))), of_)  # noqa: B023
                if len(w):
                    new = exchange(of_[w], out[:, 0], out[:, 1], loops, between_, movable)
                    yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(new.astype(np.int32))], names=["w", "cls"])

        new = words.mapInArrow(moved, "w int, cls int").toArrow()
        tried, turn = of.copy(), turn + 1
        tried[np.asarray(new["w"])] = np.asarray(new["cls"])
        if (tried == of).all():
            still += 1
        elif likelihood(counts := between + change(of, tried)) > reached[-1]:
            of, between, still = tried, counts, 0
            reached.append(likelihood(counts))
        else:  # too many moved together
            slices, turn, still, before = 2 * slices, 0, 0, -np.inf
            continue
        if turn % slices == 0:
            if reached[-1] - before < GAIN * abs(reached[-1]):
                break
            before = reached[-1]
    return of, between, reached


class Model:
    """What scoring needs, all bounded: dictionary, log counts, classes, transitions, emissions."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, cls: np.ndarray, sizes: np.ndarray, bigrams: np.ndarray, tokens: int, kinds: int, once: int):
        """counts and classes of the dictionary's words; tokens of all words of each class; class bigrams (the last two classes: words seen once or not at all, end); training tokens and distinct ones; words seen once."""
        self.hashes, self.dictionary, self.tokens, self.kinds = hashes, Dictionary(hashes), tokens, kinds
        n = len(bigrams)
        self.rest, self.end = n - 2, n - 1
        self.cls = np.append(cls, self.rest).astype(np.int32)
        self.log_total = np.log10(tokens + ADD * (kinds + 1))
        self.base = np.append(np.log10(counts + ADD), 0.0)
        of_class = bigrams.sum(axis=0)
        own = (of_class + ADD) / (of_class.sum() + ADD * n)
        self.step = np.log10((bigrams + PRIOR * own) / (bigrams.sum(axis=1, keepdims=True) + PRIOR))
        self.log_size = np.log10(np.maximum(sizes, 1.0))
        self.log_size[self.rest] = np.log10(once + ADD * (once + 1))
        self.emit = np.append(np.log10(counts) - self.log_size[cls], 0.0) if len(counts) else np.zeros(1)
        self.log_end = float(np.log10((of_class[self.end] if tokens else 0) + ADD))

    def dictionary_hashes(self) -> np.ndarray:
        """The dictionary's words, as signed hashes."""
        return self.hashes.view(np.int64)

    def known(self, words: np.ndarray) -> tuple[int, int, float, float, np.ndarray, np.ndarray]:
        """Of a text: tokens, known ones, base score and emissions, without what its words outside of the dictionary add; its path of classes (MISSED for these words); these words."""
        at = self.dictionary.find(words)
        missed = at == self.dictionary.size
        path = np.where(missed, MISSED, self.cls[at]).astype(np.uint8)
        rest = int(missed.sum())
        base = float(self.base[at].sum()) + self.log_end - (len(words) + 1) * self.log_total
        return len(words) + 1, len(words) - rest + (1 if self.tokens else 0), base, float(self.emit[at].sum()), path, words[missed]

    def steps(self, path: np.ndarray) -> float:
        """Log probability of a text's class transitions."""
        whole = np.concatenate(([self.end], path, [self.end]))
        return float(self.step[whole[:-1], whole[1:]].sum())

    def emissions(self, counts: np.ndarray, cls: np.ndarray) -> float:
        """Log probability of words outside of the dictionary given their classes; a word seen once or never has the last class."""
        return float((np.log10(np.where(cls == self.rest, counts + ADD, np.maximum(counts, 1))) - self.log_size[cls]).sum())


_WORKER: dict = {}


def _held(token: str, make):
    if token not in _WORKER:
        _WORKER.clear()
        _WORKER[token] = make()
    return _WORKER[token]


def _paths(batch: pa.RecordBatch, dictionary: Dictionary, of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of all words of a batch's texts in order, an end before, between and after the texts; the words' hashes (0 at the ends)."""
    lists = word_lists(batch.column("text").to_pylist())
    stop = np.cumsum([len(w) + 1 for w in lists])
    size = int(stop[-1]) + 1 if len(stop) else 1
    path, words, inner = np.full(size, end, np.int64), np.zeros(size, np.uint64), np.ones(size, bool)
    inner[0] = False
    inner[stop] = False
    if lists:
        words[inner] = np.concatenate(lists)
        path[inner] = of[dictionary.find(words[inner])]
    return path, words


def bigram_counts(train: DataFrame, hashes: np.ndarray, of: np.ndarray, units: int) -> DataFrame:
    """(p, c, n): bigrams of the units of a dictionary's words; of: their units, and that of other words at the end; the last unit is the end token."""
    shared, token = train.sparkSession.sparkContext.broadcast((hashes, of)), uuid.uuid4().hex

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, of_ = _held(token, lambda: (Dictionary(shared.value[0]), shared.value[1]))
        parts, size = [], 0
        for batch in batches:
            path, _ = _paths(batch, dictionary, of_, units - 1)
            parts.append(path[:-1] * units + path[1:])
            size += len(path)
            if size > HELD:
                yield _pairs(parts, ["pair", "n"])
                parts, size = [], 0
        if size:
            yield _pairs(parts, ["pair", "n"])

    summed = train.select("text").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.select(F.expr(f"cast(pair div {units} as int)").alias("p"), (F.col("pair") % units).cast("int").alias("c"), "n")


def joined_classes(train: DataFrame, hashes: np.ndarray, cls: np.ndarray, between: np.ndarray) -> DataFrame:
    """(h, c, cls) of every word outside of the clustered ones that is seen twice or more: the class that its contexts make most likely.

    cls: classes of the clustered words; between: class bigrams, the last two classes being other
    words and the end. A task gives out one row for each word of a few million tokens: its contexts
    by side and class. They meet by a sort, and stream by word after word.
    """
    spark = train.sparkSession
    total = len(between)
    other = total - 2
    shared, token = spark.sparkContext.broadcast((hashes, np.append(cls, other), between)), uuid.uuid4().hex

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, of = _held(token, lambda: (Dictionary(shared.value[0]), shared.value[1]))
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            h, side = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((side, h))
            h, side = h[order], side[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (side[1:] != side[:-1])))
            n = np.diff(np.append(np.flatnonzero(new), len(h))).astype(np.uint32)
            h, side = h[new], side[new].astype(np.uint32)
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            entries = (side << np.uint32(24) | n).tobytes()
            at = np.append(first, len(h)) * 4
            packed = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(entries)]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), packed], names=["h", "entries"])

        for batch in batches:
            path, words = _paths(batch, dictionary, of, total - 1)
            at = np.flatnonzero(path == other)
            held += [(words[at], path[at - 1]), (words[at], path[at + 1] + total)]
            size += len(at)
            if size > HELD // 4:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value[2]
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # entries (word, side and class, count) of rows not yet given out

        def done(h: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((key, h))
            h, key, n = h[order], key[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]))))
            h, key, n = h[new], key[new], np.add.reduceat(n, new)
            first = np.concatenate(([True], h[1:] != h[:-1]))
            c = np.add.reduceat(np.where(key < total, n, 0), np.flatnonzero(first))
            often = c > 1
            use = often[np.cumsum(first) - 1]
            word = (np.cumsum(often) - 1)[np.cumsum(first) - 1][use]
            best = best_classes(word, key[use], n[use], int(often.sum()), m)
            return pa.RecordBatch.from_arrays([pa.array(h[first][often]), pa.array(c[often]), pa.array(best.astype(np.int32))], names=["h", "c", "cls"])

        for batch in batches:
            h, packed = np.asarray(batch.column("h")), batch.column("entries")
            length = np.array([len(x) for x in packed.to_pylist()], np.int64) // 4
            entries = np.frombuffer(b"".join(packed.to_pylist()), np.uint32)
            kept.append((np.repeat(h, length), (entries >> np.uint32(24)).astype(np.int64), (entries & np.uint32(0xFFFFFF)).astype(np.int64)))
            if sum(len(x[0]) for x in kept) > 1 << 17:
                each, key, n = (np.concatenate(x) for x in zip(*kept))
                whole = each != each[-1]  # the last word may go on
                if whole.any():
                    yield done(each[whole], key[whole], n[whole])
                code, back = np.unique(key[~whole], return_inverse=True)
                kept = [(np.full(len(code), each[-1]), code, np.bincount(back, n[~whole]).astype(np.int64))]
        if kept:
            yield done(*(np.concatenate(x) for x in zip(*kept)))

    found = train.select("text").mapInArrow(contexts, "h long, entries binary")
    return found.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(assigned, "h long, c long, cls int")


def learn(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model of training texts (column text) and the table (h, c, cls) of all words: counts and classes (null: seen once)."""
    spark = train.sparkSession
    counts = materialize(train.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    top = most_frequent(counts.where("c > 1"), "c", DICTIONARY).toPandas().sort_values(["c", "h"], ascending=[False, True])
    words, ends = counts.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long"))).first(), train.count()
    tokens, kinds, once = int(words[0] or 0) + ends, int(words[1]) + (1 if ends else 0), int(words[2] or 0)
    hashes, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64).astype(float)
    clustered = min(CLUSTERED, len(c))
    core = hashes[:clustered]
    of, between, _ = cluster(materialize(bigram_counts(train, core, np.arange(clustered + 1), clustered + 2), "bigrams"), clustered, clustered + 2)
    joined = materialize(joined_classes(train, core, of[:clustered], between), "joined")
    cls = np.append(of[:clustered], np.zeros(len(c) - clustered, np.int32))
    wanted = spark.createDataFrame(pd.DataFrame({"h": hashes[clustered:].view(np.int64), "at": np.arange(clustered, len(c), dtype=np.int32)}), "h long, at int")
    place = joined.join(F.broadcast(wanted), "h").select("at", "cls").toPandas()  # DICTIONARY rows at most
    cls[place["at"].to_numpy()] = place["cls"].to_numpy()
    # class bigrams of the dictionary; those of words outside of it are shared out among the classes by their tokens
    total = len(between)
    n = np.zeros((total, total))
    for r in bigram_counts(train, hashes, np.append(cls, total - 2), total).collect():
        n[r["p"], r["c"]] = r["n"]
    sizes = np.bincount(of[:clustered], c[:clustered], total)
    for r in joined.groupBy("cls").agg(F.sum("c").alias("c")).collect():
        sizes[r["cls"]] += r["c"]
    outside = np.maximum(0.0, sizes - np.bincount(cls, c, total))
    outside[total - 2] = once
    share = outside / max(1.0, outside.sum())
    for m in (n, n.T):
        rest = m[:, total - 2].copy()
        m[:, total - 2] = 0
        m += rest[:, None] * share[None, :]
    model = Model(hashes, c, cls, sizes, n, tokens, kinds, once)
    return model, counts.join(joined.select("h", "cls"), "h", "left")


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row. counts: as learn gives it."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _held(token, lambda: shared.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [m.known(w) for w in word_lists(batch.column("text").to_pylist())]
            columns = list(zip(*found)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            ids = pa.array(np.arange(row, row + len(found)), pa.int64())
            row += len(found)
            path, missed = pa.array([x.tobytes() for x in columns[4]], pa.binary()), pa.array([x.view(np.int64) for x in columns[5]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, *(pa.array(c, k) for c, k in zip(columns, kinds)), path, missed], names=["doc_id", "row", "n_tokens", "n_known", "base", "model", "path", "missed"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _held(token, lambda: shared.value)
        for batch in batches:
            known, base, score = [], [], []
            for path, places, counts, classes, n_known, b, e in zip(*(batch.column(x).to_pylist() for x in ("path", "places", "counts", "classes", "n_known", "base", "model"))):
                whole = np.frombuffer(path, np.uint8).astype(np.int64)
                if places:
                    c, cls = np.array(counts, np.int64), np.array([m.rest if k is None else k for k in classes], np.int64)
                    whole[np.flatnonzero(whole == MISSED)[places]] = cls
                    n_known += int((c > 0).sum())
                    b += float(np.log10(c + ADD).sum())
                    e += m.emissions(c, cls)
                known.append(n_known)
                base.append(b)
                score.append(e + m.steps(whole))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([src.schema["doc_id"], *T._parse_datatype_string("row long, n_tokens long, n_known long, base double, model double, path binary, missed array<long>").fields])
    part = materialize(src.mapInArrow(read, schema), "scores")
    seen = part.select("row", F.posexplode("missed").alias("place", "h"))
    found = seen.join(counts, "h", "left").select("row", F.struct("place", F.coalesce("c", F.lit(0)).alias("c"), "cls").alias("x"))
    more = found.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("x"))  # one text's words
    more = more.select("row", F.col("x.place").alias("places"), F.col("x.c").alias("counts"), F.col("x.cls").alias("classes"))
    out = part.drop("missed").join(more, "row", "left").mapInArrow(scored, T.StructType([src.schema["doc_id"], *T._parse_datatype_string("n_tokens long, n_known long, base_score double, score double").fields]))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op5_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows for all documents; learned from the training fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = learn(docs.where(fold() % 10 != 0))
    out = score_texts(docs, model, counts)
    return out.select("doc_id", (fold() % 10 == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
