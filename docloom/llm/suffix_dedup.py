"""Suffix-array deduplication: bytes covered by a string of LENGTH bytes that also starts elsewhere.

A suffix array of the whole corpus cannot be shared out among tasks, so repeats are first routed.
Each window of LENGTH bytes is named by its least gram (winnowing), which depends on the window alone;
windows whose gram occurs once go. What is left is cut into blocks of WINDOWS windows at places fixed
by the gram. All windows of a block share a core; blocks with equal cores meet by a shuffle. Blocks
that are equal as a whole repeat in all their windows. The others differ in their margins, and a
suffix array over the whole margins, with the core as one symbol, tells which of their windows
repeat: the windows whose neighbours in suffix order share a window's length.

The array is built by linear grouping: suffixes are grouped by their longest Lyndon prefix, groups
being processed in descending order along previous-smaller pointers; the order inside the groups is
then emitted in one pass over the array, without renaming and recursion.

No group of blocks is held whole: equal blocks stream by, and a core with more than HELD different
margins is compared window by window through one more shuffle. Strings are judged on the input; each
row is a document of its own, so the text of a repeated row repeats wholly if it has LENGTH bytes.

Nulls: a null text is the empty text; a null id stays null. Texts below LENGTH bytes are kept. Other
input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, few, materialize, partitions, table, text_or_empty
from .hashing import SEGMENT, mix, prefix_sums, span_hashes

LENGTH = 400
GRAM = 96
#: Windows of a block.
WINDOWS = 64
#: Different margins of a core that a task holds; more are compared through a shuffle.
HELD = 20_000
#: Symbols of a suffix array, about.
SYMBOLS = 1 << 15
_POSITION = 21  # low bits that hold a position


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in ascending order; its last symbol must be its unique least.

    Every step is linear: symbols are counted into buckets, the members of a group stay in text order
    (previous-smaller pointers of one group ascend with the text), and what moves is bucketed by how
    many of the group follow, whose sum is the group's size.
    """
    n = len(s)
    low = min(s)
    buckets: list[list[int]] = [[] for _ in range(max(s) - low + 1)]
    for i, c in enumerate(s):
        buckets[c - low].append(i)
    group, members, start_of, end_of = [0] * n, {}, {}, {}
    at = 0
    for some in buckets:
        if some:
            end = at + len(some)
            for i in some:
                group[i] = at
            members[at], start_of[end], end_of[at] = some, at, end
            at = end
    smaller = [-1] * n
    end = n
    while end:  # groups in descending order
        g = start_of[end]
        times: dict[int, int] = {}  # in text order
        for i in members.pop(g):
            if group[i] != g:
                continue
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: list[dict[int, list[int]]] = [{} for _ in range(max(times.values(), default=0) + 1)]
        for j, k in times.items():
            moved[k].setdefault(group[j], []).append(j)
        for by_group in reversed(moved):  # a prefix that more of this group's follow is larger
            for h, some in by_group.items():
                top = end_of[h]
                new = top - len(some)
                members[new] = some
                if new != h:
                    start_of[top], start_of[new], end_of[new], end_of[h] = new, h, top, new
                    for j in some:
                        group[j] = new
        end = g
    sa, free, placed = [n - 1] * n, list(range(n)), [False] * n
    placed[n - 1] = True
    for k in range(n):
        j = sa[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            sa[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
    return sa


def repeated_starts(cores: list[list[tuple[bytes, bytes]]]) -> list[list[list[int]]]:
    """For each core and each of its (left, right) margins: how many left bytes those windows take that another margin pair has, too."""
    records = [(g, left, right) for g, pairs in enumerate(cores) for left, right in pairs]
    total = len(records)
    s, middle = [], []
    for k, (g, left, right) in enumerate(records):
        middle.append(len(s) + len(left))
        s += [total + b for b in left]
        s.append(total + 256 + g)
        s += [total + b for b in right]
        s.append(total - 1 - k)  # every end is unlike any other; the last is the least symbol
    wanted = {m - o: (k, o) for k, (m, (_, left, _)) in enumerate(zip(middle, records)) for o in range(min(WINDOWS - 1, len(left)) + 1)}
    found: list[list[int]] = [[] for _ in records]
    previous, before = None, None  # the suffix before and its first symbols
    marked = set()
    for i in suffix_array(s):
        head = s[i : i + WINDOWS]
        if head == before:
            for x in (previous, i):
                if x in wanted and x not in marked:
                    marked.add(x)
                    k, o = wanted[x]
                    found[k].append(o)
        previous, before = i, head
    out, at = [], 0
    for pairs in cores:
        out.append(found[at : at + len(pairs)])
        at += len(pairs)
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same least gram (the leftmost of equals): its hash and place, first and last window."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    step = SEGMENT - LENGTH
    parts = []
    for at in range(0, n - LENGTH + 1, step):
        part = data[at : at + SEGMENT]
        h = mix(span_hashes(prefix_sums(part), slice(0, len(part) - GRAM + 1), slice(GRAM, len(part) + 1)))
        least, have, width = h & ~np.uint64((1 << _POSITION) - 1) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - GRAM + 1
        while have < width:
            go = min(have, width - have)
            least = np.minimum(least[:-go], least[go:])
            have += go
        least = least[:step]  # later windows belong to the next part
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        place = (least[first] & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        parts.append((h[place], place + at, first + at, np.append(first[1:], len(least)) - 1 + at))
    h, place, first, last = (np.concatenate(x) for x in zip(*parts))
    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))  # a run goes on in the next part
    return h[start], place[start], first[start], np.append(last[start[1:] - 1], last[-1])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows by their least gram, as rows (route, h, tkey, place, first, last).

    A gram seen at several places here repeats: its rows are dealt by text, not by gram, and one row
    without a place tells the other tasks. So a gram that is everywhere does not meet in one task.
    """
    seen = set()  # a task gives each text once
    names = ["route", "h", "tkey", "place", "first", "last"]

    def given(rows: list[tuple]) -> pa.RecordBatch:
        h, *rest = (np.concatenate(c) for c in zip(*rows))
        kinds, at, times = np.unique(h, return_inverse=True, return_counts=True)
        again = kinds[times > 1]
        route = np.where(times[at] > 1, mix(rest[0].view(np.uint64)).view(np.int64), h)
        none = np.zeros(len(again), np.int64)
        told = (again, again, none, none - 1, none, none)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip((route, h, *rest), told)], names=names)

    for batch in batches:
        rows = []
        for key, text in zip(batch.column("tkey").to_pylist(), batch.column("text").to_pylist()):
            if key in seen:
                continue
            seen.add(key)
            h, place, first, last = anchors(np.frombuffer(text.encode(), np.uint8))
            rows.append((h.view(np.int64), np.full(len(h), key, np.int64), place, first, last))
            if sum(len(r[0]) for r in rows) > 1 << 16:
                yield given(rows)
                rows = []
        if rows:
            yield given(rows)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by route, h, tkey, place those whose h has several (tkey, place), or is known to."""
    kept, given = None, False  # the last row that is not known to repeat, and whether it was given out
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in rows[1:, rows[2] >= 0]], names=["tkey", "place", "first", "last"])
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns])
        known = rows[0] != rows[1]
        if known.any():
            yield out(rows[1:, known])
        rows = rows[1:, ~known]
        old = 0 if kept is None else 1
        if old:
            rows = np.concatenate([kept, rows], axis=1)
        if rows.shape[1] == 0:
            continue
        same = (rows[:3, 1:] == rows[:3, :-1]).all(axis=0)
        rows = rows[:, np.concatenate(([True], ~same))]
        equal = rows[0, 1:] == rows[0, :-1]
        many = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        last = bool(many[-1]) or (given and rows.shape[1] == 1)
        if old and given:
            many[0] = False
        kept, given = rows[:, -1:].copy(), last
        if many.any():
            yield out(rows[:, many])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once."""
    seen = set()
    for batch in batches:
        keys = batch.column("tkey").to_pylist()
        fresh = [k not in seen and not seen.add(k) for k in keys]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (core and whole hash, text key, first window, left and right margin) of each text's windows with repeated grams."""
    names = ["core", "whole", "tkey", "at", "left", "right"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        rows = []
        for key, text, grams in zip(batch.column("tkey").to_pylist(), batch.column("text").to_pylist(), batch.column("grams").to_pylist()):
            data, seen = text.encode(), set()
            n = len(data)
            for g in grams:
                place = g["place"]
                for j in range((place - g["last"]) // WINDOWS, (place - g["first"]) // WINDOWS + 1):
                    high = place - j * WINDOWS  # the block's last window
                    low = high - WINDOWS + 1
                    if low in seen:
                        continue
                    seen.add(low)
                    left, core, right = data[max(0, low) : high], data[high : low + LENGTH], data[low + LENGTH : min(n, high + LENGTH)]
                    rows.append((signed(xxhash.xxh3_64_intdigest(core)), signed(xxhash.xxh3_64_intdigest(left + core + right, seed=len(left))), key, low, left, right))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class _Margins:
    """Blocks of one core that differ in their margins, and the windows found to repeat."""

    def __init__(self):
        self.out: list[tuple] = []  # (window key or None, text key, first byte, end)
        self.waiting: list[list[tuple[bytes, bytes, int, int]]] = []
        self.symbols = 0

    def window_rows(self, core: int, left: bytes, right: bytes, key: int, low: int) -> None:
        """One row for each window of a block, to be compared by a shuffle."""
        for o in range(max(0, WINDOWS - 1 - len(right)), min(WINDOWS - 1, len(left)) + 1):
            name = xxhash.xxh3_64_intdigest(b"%d %d " % (core, o) + left[len(left) - o :] + right[: WINDOWS - 1 - o])
            p = low + WINDOWS - 1 - o
            self.out.append((name - (1 << 64) if name >> 63 else name, key, p, p + LENGTH))

    def whole(self, left: bytes, right: bytes, key: int, low: int) -> None:
        """All windows of a block repeat."""
        first, last = low + WINDOWS - 1 - len(left), low + len(right)
        if first <= last:
            self.out.append((None, key, first, last + LENGTH))

    def compare(self, blocks: list[tuple[bytes, bytes, int, int]]) -> None:
        """Blocks (left, right, text key, first window) of one core with different margins."""
        self.waiting.append(blocks)
        self.symbols += sum(len(left) + len(right) + 2 for left, right, *_ in blocks)
        if self.symbols > SYMBOLS:
            self.sort()

    def sort(self) -> None:
        if self.waiting:
            for blocks, starts in zip(self.waiting, repeated_starts([[b[:2] for b in blocks] for blocks in self.waiting])):
                for (_, _, key, low), found in zip(blocks, starts):
                    for o in found:  # the windows that take so many bytes before the core
                        self.out.append((None, key, low + WINDOWS - 1 - o, low + WINDOWS - 1 - o + LENGTH))
        self.waiting, self.symbols = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [()] * 4
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["name", "tkey", "start", "end"])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of repeated windows, from blocks sorted by core, whole, tkey, at."""
    m = _Margins()
    core = whole = None
    first = None  # the first block of the whole at hand
    count = 0
    held: list[tuple] = []  # one block for each whole of the core, as (left, right, key, low)
    over = False

    def close() -> None:
        nonlocal held, over
        if len(held) > 1 and not over:
            m.compare(held)
        held, over = [], False

    for batch in batches:
        keys = [np.asarray(batch.column(c)) for c in ("core", "whole", "tkey", "at")]
        n = len(keys[0])
        if not n:
            continue
        # blocks whose core is alone in this batch need no work, but for those at its ends
        c = keys[0]
        equal = c[1:] == c[:-1]
        busy = np.concatenate((equal, [True])) | np.concatenate(([True], equal))
        at = np.flatnonzero(busy)
        part = batch.take(pa.array(at))
        for co, wh, key, low, left, right in zip(*(part.column(x).to_pylist() for x in ("core", "whole", "tkey", "at", "left", "right"))):
            if co != core:
                close()
                core, whole = co, None
            if wh != whole:
                whole, first, count = wh, (left, right, key, low), 1
                held.append(first)
                if over:
                    m.window_rows(core, *first)
                    held.pop()
                elif len(held) > HELD:
                    over = True
                    for b in held:
                        m.window_rows(core, *b)
                    held = []
            elif (key, low) != first[2:]:
                if count == 1:
                    m.whole(*first)
                count = 2
                m.whole(left, right, key, low)
            if len(m.out) > 1 << 16:
                yield m.batch()
        if m.out:
            yield m.batch()
    close()
    m.sort()
    if m.out:
        yield m.batch()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of ranges sorted by tkey, start."""
    key, start, end = None, 0, 0
    for batch in batches:
        k, s, e = (np.asarray(batch.column(c)) for c in ("tkey", "start", "end"))
        rows = []
        for x, a, b in zip(k.tolist(), s.tolist(), e.tolist()):
            if x == key and a <= end:
                end = max(end, b)
            else:
                if key is not None:
                    rows.append((key, start, end))
                key, start, end = x, a, b
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["tkey", "start", "end"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (key, start, end)], names=["tkey", "start", "end"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(tkey, start, end): maximal runs of bytes to remove from each distinct text; texts: columns tkey and text."""
    n = partitions(texts.sparkSession)
    long = texts.where(F.octet_length("text") >= LENGTH)
    grams = long.mapInArrow(_anchored, "route long, h long, tkey long, place long, first long, last long")
    active = materialize(grams.repartition(n, "route").sortWithinPartitions("route", "h", "tkey", "place").mapInArrow(_repeated, "tkey long, place long, first long, last long"), "grams")
    keys = few(materialize(active.select("tkey").distinct(), "keys"))
    wanted = long.join(keys, "tkey", "left_semi").mapInArrow(_once, "tkey long, text string")
    by_text = active.groupBy("tkey").agg(F.collect_list(F.struct("place", "first", "last")).alias("grams"))
    blocks = wanted.join(by_text.hint("shuffle_hash"), "tkey").mapInArrow(_blocks, "core long, whole long, tkey long, at long, left binary, right binary")
    ranges = materialize(blocks.repartition(n, "core").sortWithinPartitions("core", "whole", "tkey", "at").mapInArrow(_matched, "name long, tkey long, start long, end long"), "ranges")
    windows = ranges.where(F.col("name").isNotNull()).distinct()
    again = windows.groupBy("name").count().where("count > 1").select("name")
    found = ranges.where(F.col("name").isNull()).drop("name").union(windows.join(again, "name", "left_semi").drop("name"))
    return found.repartition(n, "tkey").sortWithinPartitions("tkey", "start").mapInArrow(_merged, "tkey long, start long, end long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        for text, copies, marks in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), batch.column("spans").to_pylist()):
            data = text.encode()
            if copies and len(data) >= LENGTH:
                marks = [{"start": 0, "end": len(data)}]
            marks = sorted((m["start"], m["end"]) for m in marks or [])
            out, at = [], 0
            for a, b in marks:
                out.append(data[at:a])
                at = b
            rest = b"".join([*out, data[at:]])
            kept.append(rest)
            removed.append(len(data) - len(rest))
            spans.append(len(marks))
        size = [len(k) + r for k, r in zip(kept, removed)]
        chars = [len(k.decode(errors="ignore")) for k in kept]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans, chars)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_chars", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        sha = pa.array([hashlib.sha256(k).hexdigest() for k in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sha], names=[*batch.schema.names[:-1], "kept_sha256"])


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, copies (whether the text occurs again) and spans of every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("tkey", F.xxhash64("text"))
    spans = repeated_spans(rows.select("tkey", "text")).groupBy("tkey").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    copies = rows.where(F.octet_length("text") >= LENGTH).groupBy("tkey").count().where("count > 1").select("tkey", F.lit(True).alias("copies"))
    marks = materialize(spans.join(copies, "tkey", "full"), "marks")
    return rows.join(few(marks, F.when(F.col("spans").isNull(), 1).otherwise(F.size("spans"))), "tkey", "left").select("doc_id", "text", "copies", "spans")


def _schema(rows: DataFrame, last: str) -> T.StructType:
    return T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(f"n_bytes long, n_removed long, n_spans long, kept_chars long, {last}").fields])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, which may split a character) and kept_chars (its whole characters) of every row."""
    rows = _marked(docs, id_col, text_col)
    return rows.mapInArrow(_cut, _schema(rows, "kept binary"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`remove_repeats` over all documents."""
    rows = _marked(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.mapInArrow(_digest, _schema(rows, "kept_sha256 string"))
