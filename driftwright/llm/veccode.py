"""Product codes of vectors: integer k-means over sub-vectors, nearest entries by kd-trees.

Each component x becomes the integer floor(scale * x). Vectors are cut into equal consecutive parts, and each part
position has a codebook, which starts as that part of the vectors of least id. A round assigns every part to the
nearest entry of its codebook (squared Euclidean distance, ties to the lower index) and moves each entry to the
componentwise floor of the mean of its parts; an entry without parts stays. After the last round parts are
assigned once more, which gives the code.

A kd-tree of each codebook is broadcast in each round: its size is that of the codebooks, which are parameters.
Tasks search all parts of a batch of vectors at once: each query has a stack of nodes, goes to the nearer child
first, and leaves out a node only if its bounding box is farther than the best entry so far. A box that is just as
far is visited, as an entry of a lower index may lie in it. Distances are integers, so no tie is lost to rounding.
Tasks return sums and counts of the entries, at most one row for each entry, which Spark adds up as decimals; the
totals, a row for each entry, are all that passes the driver. A retried task returns the same integers.

Vectors that are null or hold a null or non-finite component are dropped. The dimension is that of the first
vector that is left, by id; it must be a multiple of the parts. A vector of another dimension, or with a component
whose integer is beyond +-2^27 (so that errors fit 64 bits), teaches nothing and has a null code and error. Vectors
of null ids are coded, but never first entries. Repeated ids are rows of their own; as first entries they are taken
in the order of their components. Fewer vectors than entries make smaller codebooks; an empty table has an empty
result. Other columns are ignored; the columns for id, vector and label may have any names, dots included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

MOST = 1 << 27
#: Entries of a leaf of the kd-tree, and queries that are searched at once.
LEAF, QUERIES = 4, 1 << 16


@dataclass(frozen=True)
class Forest:
    """The kd-trees of all codebooks, their nodes in one array; node p is the root of part p."""

    low: np.ndarray  # nodes x width: the box around a node's entries
    high: np.ndarray
    left: np.ndarray  # -1 for leaves
    right: np.ndarray
    entries: np.ndarray  # nodes x LEAF: indexes of a leaf's entries, the last one repeated
    books: np.ndarray  # parts x entries x width

    @staticmethod
    def of(books: np.ndarray) -> Forest:
        parts, _, width = books.shape
        low, high, left, right, entries = [None] * parts, [None] * parts, [-1] * parts, [-1] * parts, [[0] * LEAF for _ in range(parts)]
        for part in range(parts):
            rest = [(part, np.arange(books.shape[1]))]
            while rest:
                node, own = rest.pop()
                points = books[part, own]
                low[node], high[node] = points.min(0), points.max(0)
                if len(own) <= LEAF:
                    entries[node] = np.pad(own, (0, LEAF - len(own)), "edge").tolist()
                    continue
                # halves by position in the order of the widest dimension, so equal entries need no care
                own = own[np.argsort(points[:, np.argmax(high[node] - low[node])], kind="stable")]
                left[node], right[node] = len(left), len(left) + 1
                rest += [(left[node], np.sort(own[: len(own) // 2])), (right[node], np.sort(own[len(own) // 2 :]))]
                for x, empty in ((low, None), (high, None), (left, -1), (right, -1), (entries, [0] * LEAF)):
                    x += [empty, empty]
        return Forest(np.array(low).reshape(-1, width), np.array(high).reshape(-1, width), np.array(left), np.array(right), np.array(entries), books)

    def _far(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Squared distance of queries to the boxes of nodes."""
        gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry nearest to each row of ``x`` in the codebook ``part``."""
        n = len(x)
        best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        depth = 2 + int(np.ceil(np.log2(max(2, self.books.shape[1]))))
        nodes, bounds, top = np.zeros((n, depth), np.int64), np.zeros((n, depth), np.int64), np.zeros(n, np.int64)
        nodes[:, 0], bounds[:, 0] = part, self._far(part, x)
        live = np.arange(n)
        while len(live):
            node, bound = nodes[live, top[live]], bounds[live, top[live]]
            top[live] -= 1
            open_ = bound <= best[live]
            at, node = live[open_], node[open_]
            leaf = self.left[node] < 0
            q, own = at[leaf], self.entries[node[leaf]]
            gap = self.books[part[q][:, None], own] - x[q][:, None, :]
            far = np.einsum("ijk,ijk->ij", gap, gap)
            k = far.argmin(1)  # the first of equals, and a leaf's entries are in order
            d, i = far[np.arange(len(q)), k], own[np.arange(len(q)), k]
            better = (d < best[q]) | ((d == best[q]) & (i < index[q]))
            best[q[better]], index[q[better]] = d[better], i[better]
            q, node = at[~leaf], node[~leaf]
            a, b = self.left[node], self.right[node]
            da, db = self._far(a, x[q]), self._far(b, x[q])
            swap = db < da
            first, then = np.where(swap, b, a), np.where(swap, a, b)
            nodes[q, top[q] + 1], bounds[q, top[q] + 1] = then, np.maximum(da, db)
            nodes[q, top[q] + 2], bounds[q, top[q] + 2] = first, np.minimum(da, db)
            top[q] += 2
            live = live[top[live] >= 0]
        return index, best


def integers(vectors: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors can be coded, and their components as integers. None of them is null or holds nulls."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy()
    flat = np.floor(vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64) * scale)
    ends = ends - ends[0]
    fits = np.diff(ends) == dimension
    flat = flat[np.repeat(fits, np.diff(ends))].reshape(-1, dimension)
    small = (np.abs(flat) <= MOST).all(1)
    fits[fits] = small
    return fits, flat[small].astype(np.int64)


def _assign(forest: Forest, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances of all parts of the rows of ``q``, a column for each part."""
    parts, _, width = forest.books.shape
    x, part = q.reshape(-1, width), np.tile(np.arange(parts), len(q))
    index, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for lo in range(0, len(x), QUERIES):
        index[lo : lo + QUERIES], far[lo : lo + QUERIES] = forest.nearest(x[lo : lo + QUERIES], part[lo : lo + QUERIES])
    return index.reshape(len(q), parts), far.reshape(len(q), parts)


def _sums(shared, dimension: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        parts, size, width = forest.books.shape
        n, sums = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), np.int64)
        for b in batches:
            _, q = integers(b["vector"], dimension, scale)
            index, _ = _assign(forest, q)
            own = (index + np.arange(parts) * size).ravel()
            n += np.bincount(own, minlength=len(n))
            np.add.at(sums, own, q.reshape(-1, width))
        used = np.flatnonzero(n)
        place = pa.array(np.tile(np.arange(width), len(used)), pa.int32())
        row = np.repeat(used, width)
        yield pa.RecordBatch.from_arrays([pa.array(row // size, pa.int32()), pa.array(row % size, pa.int32()), place, pa.array(sums[used].ravel()), pa.array(n[row])], ["part", "entry", "place", "total", "n"])

    return run


def _codes(shared, dimension: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for b in batches:
            fits, q = integers(b["vector"], dimension, scale)
            index, far = _assign(forest, q)
            digits = max(2, len(f"{forest.books.shape[1] - 1:x}"))
            code, error = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
            code[fits] = ["".join(f"{i:0{digits}x}" for i in row) for row in index.tolist()]
            error[fits] = far.sum(1)
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array(code, pa.string()), pa.array(error, mask=~fits)], ["id", "label", "code", "error"])

    return run


def _vectors(df: DataFrame, id_: str, vector: str, label: str | None) -> DataFrame:
    """(id, vector as doubles, label) of the vectors that are whole."""
    own = df.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), (F.lit(None).cast("int") if label is None else F.col(f"`{label}`")).alias("label"))
    return own.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def train(df: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """The codebooks as integers: parts x entries x width; empty without vectors. Reads ``df`` once for each round, and once for the first entries."""
    own = _vectors(df, id_, vector, None)
    usable = F.forall("vector", lambda x: F.abs(F.floor(x * scale)) <= MOST)
    head = own.where("id is not null").orderBy("id", "vector").select(F.size("vector").alias("d")).limit(1).collect() or own.select(F.size("vector").alias("d")).orderBy("d").limit(1).collect()
    dimension = head[0]["d"] if head else 0
    if dimension % parts or (head and not dimension):
        raise ValueError(f"{dimension} components can't be cut into {parts} equal parts")
    width = dimension // parts
    first = own.where((F.size("vector") == dimension) & usable & F.col("id").isNotNull()).orderBy("id", "vector").select("vector").limit(entries).collect() if head else []
    if not first:
        return np.zeros((parts, 0, width), np.int64)
    books = np.floor(np.array([r["vector"] for r in first]) * scale).astype(np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast(Forest.of(books))
        sums = own.select("vector").mapInArrow(_sums(shared, dimension, scale), "part int, entry int, place int, total long, n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the codebooks' components in order, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, books: np.ndarray, *, id_: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, code, error, label_error): each vector's code and squared error, and the error summed over its label.

    The errors of labels are summed before the shuffle, written to the shared folder and joined: Spark broadcasts
    them if that table is small, and else splits hot labels.
    """
    own = _vectors(df, id_, vector, label)
    types = dict(zip(own.columns, own.schema, strict=True))
    schema = T.StructType([T.StructField("id", types["id"].dataType), T.StructField("label", types["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.size:
        coded = own.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        coded = own.mapInArrow(_codes(df.sparkSession.sparkContext.broadcast(Forest.of(books)), books.shape[0] * books.shape[2], scale), schema)
    scratch = Scratch(df.sparkSession, "codes")
    coded = scratch.table(coded, "coded")
    labels = scratch.table(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of")), "left").select(F.col("id").alias(id_), F.col("label"), "code", "error", "label_error")
