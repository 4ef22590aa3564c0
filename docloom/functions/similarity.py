"""Four similarities that must not be mixed up: edit ratio, token overlap (two token lengths), weighted alias hits."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize, tokens

#: Characters of a pattern that fit a word; patterns that are compared at once; ids that a batch of pairs holds.
WORD, AT_ONCE, BATCH_IDS = 64, 16, 1 << 18


def edit_ratio_of_keys(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two normalized texts; 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(a, b) / longest))


def edit_distances(patterns: list[str], texts: list[str]) -> np.ndarray:
    """Edit distances of every pattern (rows) and every text (columns): a column of the table of distances is kept as bits of a word, for many pairs at once."""
    if any(len(p) > WORD for p in patterns):
        if all(len(t) <= WORD for t in texts):
            return edit_distances(texts, patterns).T
        long = [k for k, p in enumerate(patterns) if len(p) > WORD]
        out = np.zeros((len(patterns), len(texts)), np.int32)
        rest = [k for k, p in enumerate(patterns) if len(p) <= WORD]
        out[rest] = edit_distances([patterns[k] for k in rest], texts)
        out[long] = [_distances(patterns[k], texts) for k in long]
        return out
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    known, lengths = np.unique(np.concatenate([*points, np.zeros(0, np.uint32)])), np.array([len(p) for p in points], np.int64)
    code = {chr(c): k for k, c in enumerate(known.tolist())}
    read = np.full((max(lengths, default=0), len(texts)), len(known), np.int64)  # a character behind the end is in no pattern
    for k, p in enumerate(points):
        read[: len(p), k] = np.searchsorted(known, p)
    ends = {n: np.flatnonzero(lengths == n) for n in set(lengths.tolist())}
    return np.concatenate([np.zeros((0, len(texts)), np.int32), *(_bit_distances(patterns[k : k + AT_ONCE], code, read, ends) for k in range(0, len(patterns), AT_ONCE))])


def _bit_distances(patterns: list[str], code: dict[str, int], read: np.ndarray, ends: dict[int, np.ndarray]) -> np.ndarray:
    """Distances of some patterns. read: the texts' characters by place, as codes; ends: the texts of each length."""
    one = np.uint64(1)
    sizes = np.array([[len(p)] for p in patterns], np.int32)
    masks = np.zeros((len(patterns), len(code) + 1), np.uint64)
    for k, p in enumerate(patterns):
        for place, c in enumerate(p):
            if c in code:
                masks[k, code[c]] |= one << np.uint64(place)
    shape = (len(patterns), read.shape[1])
    last = np.maximum(sizes - 1, 0).astype(np.uint64)
    up, down, score, out = np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64), np.broadcast_to(sizes, shape).copy(), np.zeros(shape, np.int32)
    same, x, h, bit = (np.empty(shape, np.uint64) for _ in range(4))
    if 0 in ends:
        out[:, ends[0]] = sizes
    for place, codes in enumerate(read):
        np.take(masks, codes, axis=1, out=same)
        np.bitwise_and(same, up, out=x)  # x: ((same & up) + up ^ up) | same
        np.add(x, up, out=x)
        np.bitwise_xor(x, up, out=x)
        np.bitwise_or(x, same, out=x)
        np.bitwise_or(same, down, out=same)
        np.bitwise_or(x, up, out=h)  # h: down | ~(x | up), where a row's distance grows
        np.invert(h, out=h)
        np.bitwise_or(h, down, out=h)
        np.bitwise_and(up, x, out=x)  # x: where it falls
        np.right_shift(h, last, out=bit)
        score += np.bitwise_and(bit, one, out=bit).view(np.int64).astype(np.int32)
        np.right_shift(x, last, out=bit)
        score -= np.bitwise_and(bit, one, out=bit).view(np.int64).astype(np.int32)
        np.left_shift(h, one, out=h)
        np.bitwise_or(h, one, out=h)
        np.left_shift(x, one, out=x)
        np.bitwise_or(same, h, out=up)
        np.invert(up, out=up)
        np.bitwise_or(up, x, out=up)
        np.bitwise_and(h, same, out=down)
        if place + 1 in ends:
            out[:, ends[place + 1]] = score[:, ends[place + 1]]
    for k in np.flatnonzero(sizes[:, 0] == 0):
        for n, at in ends.items():
            out[k, at] = n
    return out


def _distances(pattern: str, texts: list[str]) -> list[int]:
    """Distances of a pattern of any length, row by row."""
    out = []
    for t in texts:
        row = list(range(len(t) + 1))
        for i, c in enumerate(pattern, 1):
            before, row[0] = row[0], i
            for j, x in enumerate(t, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != x))
        out.append(row[-1])
    return out


@functools.lru_cache
def _ratio(distance: int, longest: int) -> float:
    """1 - distance / longest to six places, as Spark rounds; 0 for no text."""
    return float(Decimal(repr(1.0 - distance / longest)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if longest else 0.0


@functools.lru_cache(4)
def _ratios(most: int) -> np.ndarray:
    """The ratios of all distances (rows) and longest lengths (columns) up to most."""
    return np.array([[_ratio(min(d, n), n) for n in range(most + 1)] for d in range(most + 1)])


def rated_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a_ids, b_ids and ratio of every pair of a text of a and a text of b; each row of the batches has both as array<struct<text, ids>>.

    ratio: as :func:`edit_ratio_of_keys`, to six places. Batches go out as large as their ids allow.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            (a, a_ids), (b, b_ids) = (batch.column(c).slice(k, 1).flatten().flatten() for c in ("a", "b"))
            a, b = a.to_pylist(), b.to_pylist()
            of_a, of_b = (np.array([len(t) for t in x], np.int64) for x in (a, b))
            distances, longest = edit_distances(b, a), np.maximum(of_b[:, None], of_a[None, :])
            most = int(longest.max(initial=0))
            ratios = _ratios(most)[distances, longest] if most <= 256 else np.vectorize(_ratio, [float])(distances, longest)
            ratios[(of_b == 0)[:, None] | (of_a == 0)[None, :]] = 0.0
            step = max(1, BATCH_IDS // (len(a_ids.flatten()) + len(a) * max(pa.compute.list_value_length(b_ids).to_pylist())))
            for i in range(0, len(b), step):
                n = min(step, len(b) - i)
                of_pairs = [a_ids.take(pa.array(np.tile(np.arange(len(a)), n))), b_ids.take(pa.array(np.repeat(np.arange(i, i + n), len(a)))), pa.array(ratios[i : i + n].ravel())]
                yield pa.RecordBatch.from_arrays(of_pairs, ["a_ids", "b_ids", "ratio"])


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    return edit_ratio_of_keys(normalize(a), normalize(b))


def overlap_of_tokens(a: Column, b: Column) -> Column:
    """Common tokens by the larger token set; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def token_overlap(a: Column | str, b: Column | str, longer_than: int) -> Column:
    """longer_than 2 for rows of a table, 1 for names."""
    return overlap_of_tokens(tokens(a, longer_than), tokens(b, longer_than))


def _joined(group: tuple[str, ...]) -> Callable[[Column], Column]:
    members = F.array(*map(F.lit, group))
    return lambda found: F.when(F.arrays_overlap(found, members), F.array_union(found, members)).otherwise(found)


def with_aliases(found: Column, groups: list[tuple[str, ...]]) -> Column:
    """Tokens and, group after group, all members of each alias group that they hit."""
    out = found
    for group in groups:
        out = let(out, _joined(group))
    return out


def alias_score(a: Column | str, b: Column | str, groups: list[tuple[str, ...]]) -> Column:
    """Common tokens of two texts after alias expansion: 1 for tokens of up to two characters, else 2."""
    return score_of_tokens(*(with_aliases(tokens(c, 1), groups) for c in (a, b)))


def score_of_tokens(x: Column, y: Column) -> Column:
    """:func:`alias_score` of two lists of tokens."""
    return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, t: s + F.when(F.length(t) <= 2, 1).otherwise(2))


def mean_best(left: Column, right: Column) -> Column:
    """Mean over the left names (normalized) of the best edit ratio to a right one; not symmetric; 0 if a side is empty."""
    best = F.transform(left, lambda x: F.array_max(F.transform(right, lambda y: edit_ratio_of_keys(x, y))))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(left))
