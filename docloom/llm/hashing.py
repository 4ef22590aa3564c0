"""Vectorised hashes of words, shingles and byte windows inside a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SHINGLE = 5
#: Bytes hashed at once: bounds memory for very long texts.
SEGMENT = 1 << 20
#: Bytes of short texts hashed together.
GROUP = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.empty(SEGMENT + 4096, np.uint64)
        p[0], n = 1, 1
        while n < len(p):
            step = np.uint64(pow(b, n, 1 << 64))
            p[n : 2 * n] = p[: min(n, len(p) - n)] * step
            n *= 2
        out.append(p)
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring of ``data`` (at most SEGMENT + 4095 bytes) follows."""
    power, _ = _powers()
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    _, inverse = _powers()
    return (sums[end] - sums[start]) * (inverse[start] if not isinstance(start, slice) else inverse[: len(sums)][start])


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of at most SEGMENT lower-cased bytes."""
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, stop = edges[::2], edges[1::2]
    return mix(span_hashes(prefix_sums(data), start, stop) + (stop - start).astype(np.uint64)), start


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
    data = np.frombuffer(text.lower(), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):  # cut at white space; a word that fills a segment takes the other way
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if not len(gaps):
                return _slow_word_hashes(text)
            end = at + int(gaps[-1]) + 1
        out.append(_words(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _slow_word_hashes(text: bytes) -> np.ndarray:
    """The same hashes for texts with a word longer than a segment."""
    out = []
    for word in text.lower().split():
        h = 0
        for at in range(0, len(word), SEGMENT):
            part = np.frombuffer(word[at : at + SEGMENT], np.uint8)
            h = (h + int(prefix_sums(part)[-1]) * pow(_BASE, at, 1 << 64)) & _MASK
        out.append((h + len(word)) & _MASK)
    return mix(np.array(out, np.uint64))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts in place."""
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hash of the shingle that starts at each word but the last four."""
    n = max(0, len(words) - SHINGLE + 1)
    h = words[:n] * _PLACES[0]
    for k in range(1, SHINGLE):
        h += words[k : n + k] * _PLACES[k]
    return mix(h)


def _short(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer than five words."""
    n = len(words)
    return mix((words * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else words


def word_lists(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the hashes of its words, in order."""
    out: list[np.ndarray] = []
    for words, ends in _grouped(texts):
        begin = 0
        for end in ends:
            out.append(words[begin:end])
            begin = end
    return out


def _grouped(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Word hashes of short texts together, and where each text ends among them."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < GROUP):
            group.append((texts[at] or "").encode())
            size += len(group[-1]) + 1
            at += 1
        if len(group) == 1:
            words = word_hashes(group[0])
            yield words, [len(words)]
        elif size < SEGMENT:
            words, starts = _words(np.frombuffer(b" ".join(group).lower(), np.uint8))
            yield words, np.searchsorted(starts, np.cumsum([len(g) + 1 for g in group])).tolist()
        else:  # a long text came last
            for g in group:
                words = word_hashes(g)
                yield words, [len(words)]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its five-word shingles; fewer words are one shingle, none are none."""
    out: list[np.ndarray] = []
    for words, ends in _grouped(texts):
        shingles, begin = _shingles(words), 0
        for end in ends:
            out.append(distinct(shingles[begin : end - SHINGLE + 1].copy()) if end - begin >= SHINGLE else _short(words[begin:end]))
            begin = end
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text])[0]
