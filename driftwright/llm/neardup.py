"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (lower-cased; a shorter text is one shingle). A shingle weighs
``(1 + ln tf) * idf``, with a smooth idf from 1 (in every document) to ``1 + IDF_SPAN`` (in one), taken from a
count sketch over the shingles of all documents. Consistent weighted sampling draws ``BANDS * ROWS`` samples
of each text whose agreement between two texts is their weighted Jaccard similarity; texts that agree on a
band are candidates, and links hold if the similarity of the whole texts is at least ``threshold``. Classes are
the connected components of links between distinct texts; exact copies share a text.

Null and empty texts are classes of their own. Other texts without a word are linked with their exact copies
only. Repeated rows are copies. A class is named by
its least doc_id (null if all are null). An empty table has an empty result. Columns other than the id and the
text aren't read. Very long texts are hashed in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Scratch, linked_classes, small_batches

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SKETCH_BITS = 18
IDF_SPAN = 0.1
DRAWS = 1 << 16
#: Buckets of more texts are sorted out by the weights that their texts share.
CROWD = 16
#: Parts of the shingles' hash range for which those weights are kept; a power of two.
PARTS = 64


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of their hash, their documents and their term frequencies."""
    h, doc = tv.shingles(*tv.words(texts), WORDS)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
    return h[first], doc[first], np.diff(np.append(first, len(h)))


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, docs = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for b in batches:
        texts = [t for t in b["text"] if t]
        for lo, hi in tv.chunks(texts):
            h, doc, _ = bags(texts[lo:hi])
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
            docs += len(np.unique(doc))
    has = np.flatnonzero(total)
    yield pd.DataFrame({"bin": np.append(has, -1).astype("int32"), "n": np.append(total[has], docs)})


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Idf weight of each sketch bin, from the shingles of all documents.

    A bin's count less what other shingles put there on average estimates the document frequency of its most
    frequent shingle. The sketch has a fixed size.
    """
    rows = docs.select("text").mapInPandas(_sketch, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(1 << SKETCH_BITS)
    own = rows["bin"] >= 0
    count[rows["bin"][own]] = rows["n"][own]
    n = max(2.0, float(rows["n"][~own].sum()))
    df = np.clip(count - (count.sum() - count) / (len(count) - 1), 1, n)
    return (1 + IDF_SPAN * np.log(n / df) / math.log(n)).astype(np.float32)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(tf)) * idf[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]).astype(np.float32)


class Sampler:
    """Consistent weighted samples; the random draws come from a table, picked by a hash of shingle and sample."""

    def __init__(self, idf: np.ndarray, seed: int = 7):
        g = np.random.Generator(np.random.PCG64(seed))
        self.idf = idf
        self.r = g.gamma(2.0, 1.0, DRAWS).astype(np.float32)
        self.log_c = np.log(g.gamma(2.0, 1.0, DRAWS)).astype(np.float32)
        self.beta = g.random(DRAWS).astype(np.float32)
        self.pick = tv.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def bands(self, texts: list[str]) -> list[list[int]]:
        """A hash for each band of each text; none for a text without a word."""
        h, doc, tf = bags(texts)
        out: list[list[int]] = [[] for _ in texts]
        if not len(h):
            return out
        log_w = np.log(weights(h, tf, self.idf))
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.append(starts, len(doc)))
        own = np.repeat(np.arange(len(starts)), size)
        band = np.zeros((len(starts), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                at = ((h * self.pick[k]) >> np.uint64(48)).astype(np.intp)
                r, beta = self.r[at], self.beta[at]
                t = np.floor(log_w / r + beta)
                value = self.log_c[at] - r * (t - beta + 1)
                least = np.minimum.reduceat(value, starts)
                hit = np.flatnonzero(value == least[own])
                # of equal values the shingle with the least hash
                hit = hit[np.concatenate(([True], own[hit][1:] != own[hit][:-1]))]
                sample = tv.mix(h[hit] ^ (t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                b = k // ROWS
                band[:, b] = tv.mix(band[:, b] * np.uint64(31) + sample + np.uint64(k + 1))
        for d, row in zip(doc[starts].tolist(), band.astype(np.int64).tolist(), strict=True):
            out[d] = row
        return out


def _bands(shared):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sample_bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = Sampler(shared.value)
        for series in batches:
            texts = ["" if t is None else t for t in series]
            yield pd.Series([row for lo, hi in tv.chunks(texts) for row in sampler.bands(texts[lo:hi])], dtype=object)

    return sample_bands


@F.pandas_udf(T.BinaryType())
def pack_bag(texts: pd.Series) -> pd.Series:
    """The shingles of a text as sorted unsigned 32-bit hashes, each as often as it occurs."""
    out, texts = [], ["" if t is None else t for t in texts]
    for lo, hi in tv.chunks(texts):
        h, doc = tv.shingles(*tv.words(texts[lo:hi]), WORDS)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [np.sort((h[a:b] >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pd.Series(out, dtype=object)


def similarity(a: bytes, b: bytes, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two packed bags."""
    (x, n), (y, m) = (np.unique(np.frombuffer(v, "<u4"), return_counts=True) for v in (a, b))
    wx, wy = (((1 + np.log(c)) * idf[s >> np.uint32(32 - SKETCH_BITS)]) for s, c in ((x, n), (y, m)))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = np.minimum(wx[i], wy[j]).sum()
    total = wx.sum() + wy.sum() - low
    return float(low / total) if total else 0.0


def _similarity(shared):
    @F.pandas_udf(T.DoubleType())
    def weighted_jaccard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([similarity(a, b, shared.value) for a, b in zip(left, right, strict=True)], dtype=float)

    return weighted_jaccard


def _weighed(bag: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, n = np.unique(np.frombuffer(bag, "<u4"), return_counts=True)
    return s.astype(np.int32), (1 + np.log(n)) * idf[s >> np.uint32(32 - SKETCH_BITS)]


def _cells(shared):
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(node, *_weighed(bag, shared.value)) for node, bag in zip(b["node"], b["bag"], strict=True)]
            for lo in range(0, len(parts), 64):
                some = parts[lo : lo + 64]
                size = [len(s) for _, s, _ in some]
                yield pd.DataFrame({"node": np.repeat([n for n, _, _ in some], size), "shingle": np.concatenate([s for _, s, _ in some]), "weight": np.concatenate([w for _, _, w in some])})

    return cells


def _totals(shared):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def totals(bags: pd.Series) -> pd.Series:
        own = (_weighed(bag, shared.value) for bag in bags)
        return pd.Series([np.bincount(s & (PARTS - 1), w, PARTS) for s, w in own], dtype=object)

    return totals


def _shared_weights(bags: DataFrame, shared) -> DataFrame:
    """The total weight of each text of ``bags``, and the weight it holds in shingles that another of them has.

    ``held`` has ``PARTS`` parts by the shingles' hash. What two texts share is in each part the lesser weight
    held at most, so no two are more alike than the sum of these over what their union is at least; edited copies
    of one text, of which a large group has all kinds, are kept apart by that without comparing them.
    """
    cells = bags.select("node", "bag").mapInPandas(_cells(shared), "node long, shingle int, weight double")
    alone = cells.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
    loose = alone.groupBy("node", F.col("shingle").bitwiseAND(PARTS - 1).alias("part")).agg(F.sum("weight").alias("weight"))
    loose = loose.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "weight"))).alias("loose"))  # of PARTS entries at most
    held = F.transform("totals", lambda t, k: t - F.coalesce(F.col("loose")[k], F.lit(0.0)))
    add = lambda column: F.aggregate(column, F.lit(0.0), lambda x, y: x + y)
    return bags.select("node", _totals(shared)("bag").alias("totals")).join(loose, "node", "left").select("node", held.alias("held"), add("totals").alias("total")).withColumn("sum", add("held"))


def _resolve(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The key of each row's text, with whether it has characters; and for each text with characters its class."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(document_frequencies(rows))
    kept, work = Scratch(spark, "classes"), Scratch(spark, "neardup")
    keyed = rows.withColumn("node", F.xxhash64("text"))
    signed = kept.table(keyed.select("doc_id", "node", F.coalesce(F.col("text") != "", F.lit(False)).alias("filled"), _bands(shared)("text").alias("bands")), "signed")
    try:
        texts = work.table(signed.where("filled").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")), "texts")

        members = texts.select(F.explode("bands").alias("bucket"), "node")
        # by itself, so that the join can be split where a bucket is hot
        sizes = work.table(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        members = work.table(members.join(sizes, "bucket"), "members")
        # the candidates' texts are shuffled once
        wanted = texts.join(members.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("key"), "rep")
        own = keyed.join(wanted, (F.col("node") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", pack_bag("text").alias("bag"))
        bags = work.table(own.dropDuplicates(["node"]), "bags")
        crowded = bags.join(members.where(F.col("size") > CROWD).select("node").distinct(), "node", "left_semi")
        weight = work.table(_shared_weights(crowded, shared), "weights")
        # a leader holds little that no other text has
        ranked = members.join(weight, "node", "left").select("bucket", "node", F.coalesce(F.col("total") - F.col("sum"), F.lit(0.0)).alias("rank"))
        facts = texts.join(weight, "node", "left").select("node", F.struct(F.col("held").cast("array<float>").alias("held"), "sum", "total").alias("facts"))

        def possible(a: Column, b: Column) -> Column:
            may = lambda most: F.coalesce(most / (a["total"] + b["total"] - most) >= threshold - 1e-4, F.lit(True))
            shared = F.aggregate(F.zip_with(a["held"], b["held"], lambda p, q: F.least(p, q)), F.lit(0.0), lambda x, y: x + y)
            return may(F.least(a["sum"], b["sum"])) & may(shared)

        def verify(pairs: DataFrame) -> DataFrame:
            both = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")
            return both.select("a", "b", _similarity(shared)("x", "y").alias("similarity")).withColumn("holds", F.col("similarity") >= threshold)

        linked = linked_classes(ranked, verify, work, facts=facts, possible=possible, crowd=CROWD, slack=1 - threshold)
        whole = texts.select("node", "rep", "n")
        whole = whole.join(linked[0], "node", "left").withColumn("component", F.coalesce("component", "node")) if linked else whole.withColumn("component", F.col("node"))
        whole = work.table(whole, "whole")
        # a known id leads a class before a null one
        named = whole.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("rep").isNull(), "rep", "node"))["node"].alias("leader"))
        named = work.table(named, "components")  # by itself, so that the join can be split where a class is large
        final = kept.table(whole.join(named, "component").select("node", "rep", "leader", "class_id", "class_size"), "named")
    finally:
        work.drop()
    return signed.select("doc_id", "node", "filled"), final


def classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, class_id and class_size.

    Work tables are below ``spark.checkpoint.dir``; those that the result reads stay there.
    """
    signed, final = _resolve(docs, threshold)
    out = signed.join(final, "node", "left")
    return out.select("doc_id", F.when(F.col("filled"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of its least doc_id; all columns stay as they are.

    Null and empty texts stay. Rows of equal id and text are one document, of which one row stays.
    """
    signed, final = _resolve(docs, threshold)
    stay = final.where("node = leader").select("node", F.col("rep").alias("doc_id")).union(signed.where("not filled").select("node", "doc_id")).distinct()
    named = stay.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("text").alias("_node"), F.col("doc_id").alias("_id"))
    same = keyed.join(named, (keyed["_node"] == named["_node"]) & keyed["_id"].eqNullSafe(named["_id"]), "left_semi")
    return same.dropDuplicates(["_node", "_id"]).select("_row.*")
