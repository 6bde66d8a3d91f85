"""Spelling variants: the words of a corpus that one inserted, deleted or replaced character apart.

Words are maximal runs of ``LETTERS`` with A-Z lower-cased, counted over all texts. Two words are near if one edit
makes one of the other. Then they share a string with one character deleted: both lack a character of the same
place (replacement), or one, whole, is the other without a character (insertion). So each word is keyed by the
hashes of all its deletions and of itself. Prefix and suffix sums of one polynomial, over the characters of a
batch at once, give the hash of every deletion in a few array operations. Keys are dealt out by their leading bits
and sorted in each partition, where equal keys are neighbours; what shares a key is compared as strings, so that
a collision links nothing.

Rows of one deletion and place differ in one character, and rows of one insertion in a character and its place,
so a key has at most ``len(alphabet)`` rows for each of its places, whatever the texts: no group is unbounded, and
pairs within one aren't listed. Each row gets the number of its near words in the group and the one of
the largest count from the two first of the group; these are added up by word.

Words of more than ``LONG`` characters would carry a copy of themselves for each character. They go by a reference
instead; what shares a key with one is a pair to be looked up and compared as strings, with the same result.

``variants`` returns for each word its count n, the number n_near of near words, the form (the near word of largest
count, the first in code-point order of equals, if it has at least ``ratio`` times the word's count; else null) and
form_n, and the root, which is the end of the chain of forms. A form is ``ratio`` times as frequent, so chains end;
they are halved in each step.

Null and empty texts have no words, a null id is the empty text where ids are hashed. Repeated rows count each.
Very long texts and words are worked on whole; a task's counters are sent on when they hold 100,000 words. Other
columns are ignored. An empty table has an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Scratch, small_batches

LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LONG = 64
#: Characters of the words whose keys are made at once, and leading bits of keys that name a radix.
CHUNK, RADIX_BITS = 20_000, 12
KEYS = "key long, radix int, place int, word string, ref long, n long"
FOUND = "word string, ref long, n_near long, best_n long, best string, other long, other_n long"


def thinned(doc_id: object, run: str, every: int) -> str:
    """``run`` without one character, chosen by a hash of it and the document, if ``every`` divides the hash."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(least: int, every: int | None):
    own = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()

        def partial() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(total), "n": list(total.values())})
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b["id"], b["text"], strict=True):
                for word, n in Counter(own.findall(text.translate(_LOWER))).items():
                    w = word if every is None else thinned(doc_id, word, every)
                    if len(w) >= least:
                        total[w] += n
                    if len(total) >= 100_000:
                        yield partial()
        if total:
            yield partial()

    return run


def words(df: DataFrame, *, id_: str = "doc_id", text: str = "text", least: int = 6, count: int = 5, every: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``least`` characters that occur at least ``count`` times.

    With ``every`` a run whose hash it divides loses a character first, as in ``thinned``.
    """
    small_batches(df.sparkSession)
    own = df.select(F.col(f"`{id_}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return own.mapInPandas(_counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, word and place of each deletion of each word, and of the words themselves (place -1)."""
    flat, offsets = tv.code_points(words)
    start, end = offsets[:-1], offsets[1:]
    of = np.repeat(np.arange(len(words)), end - start)
    at = np.arange(len(flat))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * tv.powers(tv.BASE, len(flat)), out=sums[1:])
        back = tv.powers(tv.INVERSE, len(flat) + 2)
        prefix = (sums[at] - sums[start[of]]) * back[start[of]]
        suffix = (sums[end[of]] - sums[at + 1]) * back[start[of] + 1]  # moved up by the character that is gone
        whole = (sums[end] - sums[start]) * back[start]
        key = tv.mix(np.concatenate((prefix + suffix, whole)))
    return key, np.concatenate((of, np.arange(len(words)))), np.concatenate((at - start[of], np.full(len(words), -1)))


def _keyed(long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_words, refs, counts = b["word"].to_pylist(), b["ref"].to_numpy(), b["n"].to_numpy()
            for lo, hi in tv.chunks(all_words, CHUNK):
                key, of, place = deletions(all_words[lo:hi])
                own = np.array([w if len(w) <= long else None for w in all_words[lo:hi]], object)
                for a in range(0, len(key), 10 * CHUNK):  # one very long word has as many rows as characters
                    k, w, p = (x[a : a + 10 * CHUNK] for x in (key, of, place))
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array((k >> np.uint64(64 - RADIX_BITS)).astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(own[w], pa.string()), pa.array(refs[lo + w]), pa.array(counts[lo + w])], ["key", "radix", "place", "word", "ref", "n"])

    return run


def _linked(word: list, place: list[int], ref: list[int], n: list[int]) -> Iterator[tuple]:
    """Rows of FOUND of the rows of one key. Short words are compared; a long one makes pairs with all it may be near to."""
    by: dict[str, dict[int, dict[str, int]]] = {}
    for w, p, m in zip(word, place, n, strict=True):
        if w is not None:
            by.setdefault(w if p < 0 else w[:p] + w[p + 1 :], {}).setdefault(p, {})[w] = m
    for places in by.values():
        for p, own in places.items():
            if p >= 0 and len(own) > 1:
                first, second = sorted(own.items(), key=lambda x: (-x[1], x[0]))[:2]
                for w in own:
                    best = second if w == first[0] else first
                    yield w, None, len(own) - 1, best[1], best[0], None, None
        if -1 in places and len(places) > 1:
            ((whole, m),) = places[-1].items()
            longer = {w: k for p, own in places.items() if p >= 0 for w, k in own.items()}
            best = min(longer.items(), key=lambda x: (-x[1], x[0]))
            yield whole, None, len(longer), best[1], best[0], None, None
            for w in longer:
                yield w, None, 1, m, whole, None, None
    if None in word:
        for i, w in enumerate(word):
            if w is None:
                for j in range(len(word)):
                    if ref[i] != ref[j] and (place[i] == place[j] or place[i] < 0 or place[j] < 0):
                        yield None, ref[i], None, n[i], None, ref[j], n[j]
                        if word[j] is not None:
                            yield None, ref[j], None, n[j], None, ref[i], n[i]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: what shares a key. The last key of a batch waits for the next."""
    names = ["key", "place", "word", "ref", "n"]
    types = dict(zip(("word", "ref", "n_near", "best_n", "best", "other", "other_n"), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True))
    rest: pa.Table | None = None

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = t["key"].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        several = np.flatnonzero(np.diff(edge) > 1)
        keep = np.zeros(t.num_rows, bool)
        for a, b in zip(edge[several].tolist(), edge[several + 1].tolist(), strict=True):
            keep[a:b] = True
        t = t.filter(pa.array(keep))
        ends = np.concatenate(([0], np.cumsum(np.diff(edge)[several]))).tolist()
        word, place, ref, n = (t[c].to_pylist() for c in ("word", "place", "ref", "n"))
        out: list[tuple] = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out.extend(_linked(word[a:b], place[a:b], ref[a:b], n[a:b]))
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))

    for b in batches:
        t = pa.Table.from_batches([b]).select(names)
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        key = t["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        yield from found(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None:
        yield from found(rest)


def _near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


@F.pandas_udf(T.BooleanType())
def _is_near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_near(x, y) for x, y in zip(a, b, strict=True)], dtype="boolean")


def near(counted: DataFrame, scratch: Scratch, *, long: int = LONG) -> DataFrame:
    """(word, n_near, best_n, best) of the words of the table ``counted`` (word, n) that have near words."""
    refs = counted.withColumn("ref", F.xxhash64("word"))
    keys = refs.mapInArrow(_keyed(long), KEYS)
    sorted_ = keys.repartition(_partitions(keys), "radix").sortWithinPartitions("key", "place", "ref")
    found = scratch.table(sorted_.mapInArrow(_compared, FOUND), "shared")
    short = found.where("word is not null").select("word", "n_near", F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")).alias("best"))
    pairs = found.where("word is null").select("ref", "other").distinct()
    by = refs.select("ref", F.col("word").alias("w"))
    met = pairs.join(by, "ref").join(refs.select(F.col("ref").alias("other"), F.col("word").alias("best"), F.col("n").alias("best_n")), "other")
    far = met.where(_is_near("w", "best")).select(F.col("w").alias("word"), F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")).alias("best"))
    out = short.union(far).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.w").alias("best"))


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the table ``forms`` (word, form), whose chains end. Each step doubles the links that are taken."""
    at, step, moving = forms.select("word", F.col("form").alias("root")), 0, True
    while moving:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        at = scratch.table(at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), f"roots-{step}")
        moving, step = not at.where("moved").isEmpty(), step + 1
        at = at.drop("moved")
    return at


def variants(counted: DataFrame, *, ratio: int = 5, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``counted`` (word, n); words are distinct and not null."""
    scratch = Scratch(counted.sparkSession, "spelling")
    counted = scratch.table(counted, "words")
    forms = counted.join(near(counted, scratch, long=long), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("best_n") >= ratio * F.col("n"), F.struct(F.col("best").alias("form"), F.col("best_n").alias("n"))).alias("f"))
    forms = scratch.table(forms.select("word", F.col("f.form").alias("form"), "n", "n_near", F.col("f.n").alias("form_n")), "forms")
    ends = roots(forms.where("form is not null").select("word", "form"), scratch)
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
