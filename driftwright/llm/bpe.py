"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are split by the vocabulary's pattern. The distinct chunks that have not been met before are grouped
by byte length into matrices of ids. Each round, every row merges its leftmost pair of least rank; the pairs
are looked up in a hashed table and rows are compacted to the left. Chunks of more than ``LONG`` bytes, where
a round for each merge would take quadratic time, take the same merges from a heap instead.

Null texts count as empty; an empty text has no ids. Ties of rank within a row are between equal pairs and
go to the leftmost. Very long texts, and texts without a place to split, are encoded in full. Repeated rows
get equal results. Columns of the input pass through; those named like an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, spare

LONG = 512
#: Chunks that a worker remembers before it starts anew.
MEMORY = 200_000
#: Characters of short texts that are decoded together.
TOGETHER = 1 << 18
NONE = np.int64(-1)
FAR = np.int64(1 << 40)


class Vocabulary:
    """Ranks of byte strings as arrays: an open-addressing table of pairs, and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        # every split of a piece into two pieces is a pair that may be merged into it
        pairs = [(ranks[p[:i]], ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        self._fill(np.array(pairs, np.int64).reshape(-1, 3))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, pairs: np.ndarray) -> None:
        self.bits = max(4, int(len(pairs) * 2).bit_length())
        self.keys = np.full(1 << self.bits, NONE)
        self.values = np.full(1 << self.bits, FAR)
        key, value = (pairs[:, 0] << 20) | pairs[:, 1], pairs[:, 2]
        slot, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            free = self.keys[slot] == NONE
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            placed = np.zeros(len(key), bool)
            placed[one] = free[one]
            self.keys[slot[placed]], self.values[slot[placed]] = key[placed], value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair merges into, ``FAR`` where it doesn't merge."""
        key = (left << 20) | right
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], FAR)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != NONE) & (left >= 0) & (right >= 0))
        at = slot[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (self.keys[at] != NONE)
            open_, at = open_[go], at[go]
        return out

    def merge_matrix(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of ids of one length to the end; the ids, padded with -1, and their numbers."""
        n, width = rows.shape
        ids, size = rows.copy(), np.full(n, width, np.int64)
        rank = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        column = np.arange(width)
        while len(live) and rank.shape[1]:
            at = rank.argmin(1)  # the first of equal ranks: the leftmost pair
            least = rank[np.arange(len(rank)), at]
            go = least < FAR
            live, rank, at, least = live[go], rank[go], at[go], least[go]
            if not len(live):
                break
            own = ids[live]
            own[np.arange(len(live)), at] = least
            # compaction: what stands right of the merged pair moves one place to the left
            source = column[None, :] + (column[None, :] > at[:, None])
            own = np.where(source < width, np.take_along_axis(own, np.minimum(source, width - 1), 1), NONE)
            ids[live] = own
            size[live] -= 1
            shift = column[None, : width - 1] + (column[None, : width - 1] > at[:, None])
            rank = np.where(shift < width - 1, np.take_along_axis(rank, np.minimum(shift, width - 2), 1), FAR)
            r = np.arange(len(live))
            has_right = at + 1 < size[live]
            new = self.pair_rank(own[r, at], np.where(has_right, own[r, np.minimum(at + 1, width - 1)], NONE))
            rank[r[at < width - 1], at[at < width - 1]] = np.where(has_right, new, FAR)[at < width - 1]
            left = at > 0
            rank[r[left], at[left] - 1] = self.pair_rank(own[r[left], at[left] - 1], own[r[left], at[left]])
        return ids, size

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long chunk, with a heap of pairs and links between neighbours."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.pair_rank(ids[:-1], ids[1:])
        ids = ids.tolist()
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first < FAR).tolist()]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = self.pair_rank(np.array([ids[i]]), np.array([ids[j]]))[0]
                if rank < FAR:
                    heapq.heappush(heap, (int(rank), i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = rank, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_chunks(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each chunk as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = np.array([self.ranks[p]], "<u4").tobytes()
            elif len(p) > LONG:
                out[i] = self.merge_long(p).astype("<u4").tobytes()
            elif p:
                by_length.setdefault(len(p), []).append(i)
        for width, group in by_length.items():
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                raw = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8).reshape(len(part), width)
                ids, size = self.merge_matrix(self.byte_ids[raw])
                ids = ids.astype("<u4")
                for row, (i, n) in enumerate(zip(part, size.tolist(), strict=True)):
                    out[i] = ids[row, :n].tobytes()
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` one after the other."""
        ids = ids.astype(np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.starts[ids] - (ends - size), size)
        return self.bytes[shift + np.arange(len(shift))]


class Encoder:
    """A vocabulary with the pattern that splits texts, and a bounded memory of chunks."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.split, self.known = vocabulary, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes; ``texts`` are encoded together."""
        split = [self.split(t) for t in texts]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        fresh = list({c for row in split for c in row} - known.keys())
        known.update(zip(fresh, self.vocabulary.encode_chunks([c.encode("utf-8", "replace") for c in fresh]), strict=True))
        return [b"".join(map(known.__getitem__, row)) for row in split]


def _encoder(vocabulary_path: str, pattern: str, keep: str):
    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if keep == "digests" else {"ids": "binary", "decoded": "binary"}

    @F.pandas_udf(T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items())))
    def encode_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Vocabulary.load(vocabulary_path), pattern)
        vocabulary = encoder.vocabulary
        for series in batches:
            texts = ["" if t is None else t for t in series]
            rows, lo = [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TOGETHER):
                    size += len(texts[hi])
                    hi += 1
                coded = encoder.encode(texts[lo:hi])
                ids = np.frombuffer(b"".join(coded), "<u4")
                back = vocabulary.decode(ids)
                ends = np.concatenate(([0], np.cumsum(vocabulary.lengths[ids])))
                at = 0
                for own in coded:
                    n = len(own) // 4
                    plain = back[ends[at] : ends[at + n]]
                    at += n
                    rows.append((n, hashlib.sha256(own).hexdigest(), hashlib.sha256(plain).hexdigest()) if keep == "digests" else (own, plain.tobytes()))
                lo = hi
            yield pd.DataFrame(rows, columns=list(fields))

    return encode_text


def encode(df: DataFrame, vocabulary_path: str, pattern: str, *, text: str | Column = "text", keep: str = "ids") -> DataFrame:
    """``df`` with ids (little-endian unsigned 32-bit) and the bytes decoded from them.

    With ``keep="digests"``: n_tokens, ids_sha256 and decoded_sha256 instead. ``vocabulary_path`` holds lines
    of a base64 byte string and its rank and must be there on every machine.
    """
    if keep not in ("ids", "digests"):
        raise ValueError(f"keep: {keep!r}")
    small_batches(df.sparkSession)
    udf = _encoder(vocabulary_path, pattern, keep)
    c = F.col(text) if isinstance(text, str) else text
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if keep == "digests" else ["ids", "decoded"]
    own = spare(df, "found")
    found = df.withColumn(own, udf(c))
    return found.withColumns({n: F.col(f"{own}.{n}") for n in names}).drop(own)
