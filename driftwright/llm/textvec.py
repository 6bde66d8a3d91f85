"""Numpy views of text: code points, words and word hashes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Odd multiplier of the rolling polynomial, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters that are worked on at once; a longer document is a chunk by itself.
CHUNK = 200_000


@lru_cache(1)
def word_chars() -> np.ndarray:
    """For each code point, whether it belongs to words (letters and numerals of any script)."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` characters, or one document."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in order, and the offsets of the documents (one more than there are)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK), np.uint64(base), np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def word_spans(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of word characters; runs end with their document."""
    inside = (word_chars() if table is None else table)[flat]
    edge = np.zeros(len(flat) + 1, bool)
    if len(flat):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[offsets] = True
        edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    if len(at) < 2:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, end = at[:-1], at[1:]
    keep = inside[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points, alike wherever the span stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(flat)), out=sums[1:])
        return mix((sums[end] - sums[start]) * powers(INVERSE, len(flat) + 1)[start])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each lower-cased word of ``texts``, in order."""
    flat, offsets = code_points([t.lower() for t in texts])
    start, end, doc = word_spans(flat, offsets)
    return span_hashes(flat, start, end), doc


def shingles(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a document; a document of fewer words has one of all of them."""
    if not len(hashes):
        return hashes, doc
    with np.errstate(over="ignore"):
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.append(first, len(doc)))
        place = np.arange(len(doc)) - np.repeat(first, size)
        room = np.repeat(size, size) - place
        full = np.flatnonzero((room >= n) | (place == 0))
        out = np.zeros(len(full), np.uint64)
        for k in range(n):
            has = room[full] > k
            out[has] = mix(out[has] * np.uint64(31) + hashes[full[has] + k] + np.uint64(k + 1))
        return out, doc[full]
