"""Benchmark decontamination with spaced seeds.

Fixed masks of ``SPAN`` words ignore some positions. The words that a mask keeps are hashed at each place of
the test items and of the documents; equal hashes are hits, which substitutions at ignored positions don't
prevent. Around a hit, item and document are compared word by word without gaps. An overlap is a stretch with
enough equal words, twelve or four fifths of a shorter item, which are at least four fifths of the stretch. The
masks hit each of these: a stretch of 9 words with one substitution, of 10 to 14 with two or of 15 with three has
a span that some mask fits, and all others hold one of these. Reported is the best stretch, in which a
substitution costs what ``PRICE`` equal words earn, where it has enough equal words, else the widest.

Up to ``words_per_block`` words of items are broadcast as one block to the tasks that read the documents. A larger
benchmark is never broadcast: hashes of documents that a bitmap of fixed size lets through are joined with those of
the items (Spark splits a hash that many documents share), and each hit's stretch of the document meets its item.
Words are lower-cased runs of letters and numerals. Items of
``SHORT`` to ``SPAN - 1`` words match where all their words stand in a row. Items of fewer words hold too little
to tell a leak from chance and match nothing; so do null texts and items. Repeated items and documents give a
row each. Of equal overlaps the first one in the document is reported. Other columns of the documents pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Scratch, small_batches

SPAN, PRICE, ENOUGH, SHORT = 9, 4, 12, 5
#: Kept positions of each mask.
MASKS = ((0, 1, 5, 7, 8), (2, 3, 4, 5, 8), (0, 2, 5, 6, 7), (1, 2, 3, 6, 8))
#: Span and kept positions of all seeds: the masks, then the sizes of short items.
SEEDS = (*((SPAN, m) for m in MASKS), *((n, tuple(range(n))) for n in range(SHORT, SPAN)))
#: Words beyond each end of a document that a span may reach, as two words of an item may lie there.
MARGIN = 2
FIELDS = ("item_id", "doc_start", "item_start", "length", "equal", "item_words")
#: Lines of a document that one row of the join's next step holds.
LINES = 1000
#: Bits of the filter of items' hashes: 16 MB, however large the benchmark is.
BITS = 1 << 27


def seeds(words: np.ndarray, doc: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each span within a text, by the kept positions of one of ``SEEDS``."""
    span, kept = SEEDS[kind]
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[span - 1 :])
    h = np.full(len(at), kind + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in kept:
            h = tv.mix(h * np.uint64(31) + words[at + k])
    return h, at


def match_type(item_id: T.DataType) -> T.ArrayType:
    """Overlaps of a document, with ids of the items' type."""
    return T.ArrayType(T.StructType([T.StructField(n, item_id if n == "item_id" else T.IntegerType()) for n in FIELDS]))


@dataclass(frozen=True)
class Block:
    """Test items with their hashed seeds in order."""

    ids: list
    words: np.ndarray
    first: np.ndarray  # where the words of each item begin
    hashes: list[np.ndarray]
    places: list[np.ndarray]

    @classmethod
    def build(cls, ids: list, texts: list[str]) -> Block:
        words, doc = tv.words(texts)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        size = np.diff(first)
        found = []
        for kind, (span, _) in enumerate(SEEDS):
            h, at = seeds(words, doc, kind)
            own = (size[doc[at]] == span) | (kind < len(MASKS))
            found.append((h[own], at[own]))
        order = [np.argsort(h, kind="stable") for h, _ in found]
        return cls(ids, words, first, [h[o] for (h, _), o in zip(found, order, strict=True)], [p[o] for (_, p), o in zip(found, order, strict=True)])


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Begin, end and number of equal words of the best stretch: equal words earn 1, others cost ``PRICE``."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PRICE))))
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    begin = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return begin, end, int(equal[begin:end].sum())


def widest(equal: np.ndarray) -> tuple[int, int, int]:
    """Begin, end and number of equal words of the stretch with most of them whose other words cost no more than they earn."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PRICE))))
    have = np.concatenate(([0], np.cumsum(equal)))
    begin = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int((have - have[begin]).argmax())
    n = int(have[end] - have[begin[end]])
    return int(begin[end]) + int(equal[begin[end] :].argmax()) if n else end, end, n


def overlap(equal: np.ndarray, size: int, whole: bool) -> tuple[int, int, int] | None:
    """The overlap of an item of ``size`` words on one line with a document, if it has enough equal words."""
    enough = size if size < SPAN else min(ENOUGH, -(-4 * size // 5))
    if equal.sum() < enough or (size < SPAN and not whole):
        return None
    best = stretch(equal)
    if whole and best[2] < enough:
        best = widest(equal)
    return best if best[2] >= enough else None


class Finder:
    def __init__(self, block: Block, whole: bool = False):
        self.block, self.whole = block, whole
        self.doors = []
        for h in block.hashes:
            door = np.zeros(1 << 20, bool)
            door[(h >> np.uint64(44)).astype(np.int64)] = True
            self.doors.append(door)

    def find(self, texts: list[str]) -> list[list[tuple]]:
        """The best overlap of each text with each item that it holds part of."""
        b = self.block
        words, doc = tv.words(texts)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        lines: set[tuple[int, int, int]] = set()  # document, item, shift between them
        # each document between words of no text
        at = np.arange(len(words)) + (2 * doc + 1) * MARGIN
        wide = np.zeros(len(words) + 2 * MARGIN * len(texts), np.uint64)
        wide[at] = words
        begin = first + 2 * MARGIN * np.arange(len(texts) + 1)
        wide_doc = np.repeat(np.arange(len(texts)), np.diff(begin))
        for m in range(len(SEEDS)):
            if not len(b.hashes[m]):
                continue
            h, at = seeds(wide, wide_doc, m)
            near = np.flatnonzero(self.doors[m][(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(b.hashes[m], h[near], "left"), np.searchsorted(b.hashes[m], h[near], "right")
            count = hi - lo
            place = at[np.repeat(near, count)]
            item_place = b.places[m][np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
            item = np.searchsorted(b.first, item_place, "right") - 1
            d = wide_doc[place]
            lines.update(zip(d.tolist(), item.tolist(), ((place - begin[d] - MARGIN) - (item_place - b.first[item])).tolist(), strict=True))
        out: list[list[tuple]] = [[] for _ in texts]
        best: dict[tuple[int, int], tuple] = {}
        for d, i, shift in sorted(lines):
            size = int(b.first[i + 1] - b.first[i])
            lo, hi = max(0, -shift), min(size, int(first[d + 1] - first[d]) - shift)
            equal = words[first[d] + lo + shift : first[d] + hi + shift] == b.words[b.first[i] + lo : b.first[i] + hi]
            found = overlap(equal, size, self.whole)
            if found and found[2] > best.get((d, i), (0,) * 6)[4]:
                start, end, n = found
                best[d, i] = (b.ids[i], lo + shift + start, lo + start, end - start, n, size)
        for (d, _), row in best.items():
            out[d].append(row)
        return out


def _matcher(shared, whole, kind):
    @F.pandas_udf(kind)
    def overlaps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(Block(*shared.value), whole)
        for series in batches:
            texts = ["" if t is None else t for t in series]
            yield pd.Series([[dict(zip(FIELDS, m, strict=True)) for m in row] for lo, hi in tv.chunks(texts) for row in finder.find(texts[lo:hi])], dtype=object)

    return overlaps.asNondeterministic()  # else a filter on its result, or one that Spark adds, runs it twice


def _broadcast(df: DataFrame, items: DataFrame, text: str, whole: bool) -> Column:
    """A column of ``df`` with its overlaps with ``items``, whose number of words has been checked."""
    own = items.orderBy("item_id", "text").collect()
    block = Block.build([r["item_id"] for r in own], [r["text"] for r in own])
    shared = df.sparkSession.sparkContext.broadcast((block.ids, block.words, block.first, block.hashes, block.places))
    return _matcher(shared, whole, match_type(items.schema["item_id"].dataType))(F.col(text))


def _item_seeds():
    @F.pandas_udf("array<struct<hash: long, place: int, words: int>>")
    def run(series: pd.Series) -> pd.Series:
        """All seeds of items, with their numbers of words."""
        out = []
        for text in series:
            words, doc = tv.words([text])
            found = []
            for kind, (span, _) in enumerate(SEEDS):
                if kind < len(MASKS) or len(words) == span:
                    h, at = seeds(words, doc, kind)
                    found += [{"hash": a, "place": b, "words": len(words)} for a, b in zip(h.view(np.int64).tolist(), at.tolist(), strict=True)]
            out.append(found)
        return pd.Series(out, dtype=object)

    return run


def _doc_seeds(bitmap):
    """Seeds of documents that ``bitmap`` lets through; places count from the document's first word."""

    @F.pandas_udf("array<struct<hash: long, place: int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = bitmap.value
        for series in batches:
            out = []
            for text in series:
                words, _ = tv.words(["" if text is None else text])
                wide = np.concatenate((np.zeros(MARGIN, np.uint64), words, np.zeros(MARGIN, np.uint64)))
                own = []
                for kind in range(len(SEEDS)):
                    h, at = seeds(wide, np.zeros(len(wide), np.int64), kind)
                    low = (h & np.uint64(BITS - 1)).astype(np.int64)
                    near = (bits[low >> 5] >> (low & 31).astype(np.uint32)) & np.uint32(1) == 1
                    own += [{"hash": a, "place": b} for a, b in zip(h[near].view(np.int64).tolist(), (at[near] - MARGIN).tolist(), strict=True)]
                out.append(own)
            yield pd.Series(out, dtype=object)

    return found


def _stretches():
    @F.pandas_udf("array<struct<item: long, shift: int, lo: int, words: array<long>>>")
    def run(texts: pd.Series, lines: pd.Series) -> pd.Series:
        """The words of each text that stand beside an item, for each line (item, shift, words)."""
        out = []
        for text, own in zip(texts, lines, strict=True):
            words = tv.words([text])[0].view(np.int64)
            found = []
            for line in own:
                lo, hi = max(0, -line["shift"]), min(line["words"], len(words) - line["shift"])
                found.append({"item": line["item"], "shift": line["shift"], "lo": lo, "words": words[lo + line["shift"] : hi + line["shift"]].tolist()})
            out.append(found)
        return pd.Series(out, dtype=object)

    return run


def _verifier(whole: bool):
    @F.pandas_udf("struct<doc_start: int, item_start: int, length: int, equal: int, item_words: int>")
    def verify(shift: pd.Series, lo: pd.Series, own: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for s, at, part, text in zip(shift, lo, own, texts, strict=True):
            words = tv.words([text])[0].view(np.int64)
            found = overlap(np.asarray(part, np.int64) == words[at : at + len(part)], len(words), whole)
            rows.append((None,) * 5 if found is None else (at + s + found[0], at + found[0], found[1] - found[0], found[2], len(words)))
        return pd.DataFrame(rows, columns=FIELDS[1:]).astype("Int32")

    return verify


def _joined(docs: DataFrame, items: DataFrame, scratch: Scratch, whole: bool) -> DataFrame:
    """(doc, item, m) of all overlaps of ``docs`` (doc, text) with ``items`` (item, item_id, text), by joins."""
    known = scratch.table(items.select("item", F.inline(_item_seeds()("text"))), "seeds")
    low = F.col("hash").bitwiseAND(BITS - 1)
    cells = known.groupBy(F.shiftright(low, 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 31 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(BITS >> 5, np.uint32)
    bitmap[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).astype(np.uint32)
    met = docs.select("doc", F.inline(_doc_seeds(docs.sparkSession.sparkContext.broadcast(bitmap))("text")))
    lines = met.withColumnRenamed("place", "doc_place").join(known, "hash").select("doc", "item", (F.col("doc_place") - F.col("place")).alias("shift"), "words").distinct()
    # a document of many lines is several rows
    chunk = F.floor(F.row_number().over(Window.partitionBy("doc").orderBy("item", "shift")) / LINES)
    lines = scratch.table(lines, "lines").withColumn("chunk", chunk).groupBy("doc", "chunk").agg(F.collect_list(F.struct("item", "shift", "words")).alias("lines"))
    near = docs.join(lines, "doc").select("doc", F.inline(_stretches()("text", "lines")))
    both = near.join(items.withColumnRenamed("text", "item_text"), "item")
    found = both.select("doc", "item", "item_id", "shift", _verifier(whole)("shift", "lo", "words", "item_text").alias("m")).where("m.equal is not null")
    best = found.groupBy("doc", "item").agg(F.max_by(F.struct("item_id", "m.*"), F.struct("m.equal", -F.col("shift"))).alias("m"))
    return best


def matches(df: DataFrame, benchmark: DataFrame, *, text: str = "text", words_per_block: int = 250_000, bytes_per_block: int = 16 << 20, whole: bool = False) -> DataFrame:
    """``df`` as a struct ``row``, with ``found``: the overlaps of its text with the items (item_id, text) of ``benchmark``.

    A benchmark of up to ``words_per_block`` words, as the matcher counts them, and ``bytes_per_block`` bytes of texts
    is broadcast, a larger one joined; ids may be of any type. With ``whole`` an overlap
    counts wherever its substitutions stand and short items are searched; otherwise only the best stretch counts,
    which substitutions near its ends cut short.
    """
    small_batches(df.sparkSession)
    items = benchmark.where("text is not null").select("item_id", "text")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if (total["words"] or 0) <= words_per_block and (total["bytes"] or 0) <= bytes_per_block:
        return rows.withColumn("found", _broadcast(rows, items, f"row.`{text}`", whole))
    scratch = Scratch(df.sparkSession, "decontamination")
    items = scratch.table(items.withColumn("item", F.monotonically_increasing_id()), "items")
    rows = scratch.table(rows.withColumn("doc", F.monotonically_increasing_id()), "documents")
    best = _joined(rows.select("doc", F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("text")), items, scratch, whole)
    per_doc = best.groupBy("doc").agg(F.collect_list("m").alias("found"))
    return rows.join(per_doc, "doc", "left").select("row", F.coalesce("found", F.array().cast(match_type(items.schema["item_id"].dataType))).alias("found"))


def overlaps(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document and item that overlap, with doc_id and where and how far."""
    return matches(df, benchmark, **options).select("row.doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")


def remove(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``df`` without the documents that overlap an item."""
    return matches(df, benchmark, **options).where(F.size("found") == 0).select("row.*")
