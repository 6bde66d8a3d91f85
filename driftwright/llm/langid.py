"""Language identification by mixtures: which languages a text holds, and in which proportions.

Each language has a smoothed distribution over hashed character trigrams. A document's words are draws from
an unknown mixture of the languages. Expectation-maximisation finds the proportions; the set of languages is
the one of highest likelihood after a penalty for each language beyond the first; sets grow until a bound on the
likelihood of all languages rules larger ones out.

Nulls, empty texts and texts without a letter: language ``und``, score 0, no proportions. With nothing to
learn from, every text is ``und``. Very long texts are worked on in full, one at a time. Repeated rows get
equal results. Ties between languages go to the first in alphabetical order. Columns of the input pass
through; those named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import small_batches, spare, unit_hash

BUCKETS = 1 << 15
UNKNOWN = "und"
RESULT = "lang_pred string, score double, languages array<string>, proportions array<double>"


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, the starts of words among them, and the words' documents."""
    flat, offsets = tv.code_points([t.lower() for t in texts])
    start, end, doc = tv.word_spans(flat, offsets, tv.letters())
    if not len(start):
        return np.zeros(0, np.int64), start, doc
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first - start, size)
    c = flat.astype(np.uint64)
    left, right = c[np.maximum(at - 1, 0)], c[np.minimum(at + 1, len(c) - 1)]
    left[first], right[first + size - 1] = 32, 32
    with np.errstate(over="ignore"):
        h = (left * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + right * np.uint64(0x165667B19E3779F9)) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(64 - 15)).astype(np.int64), first, doc


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # bucket x language


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, own in b.groupby("lang")["text"]:
            texts = own.tolist()
            for lo, hi in tv.chunks(texts):
                grams, _, _ = trigrams(texts[lo:hi])
                total[lang] = total.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
    for lang, n in total.items():
        has = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": has.astype("int32"), "n": n[has].astype("int64")})


def train(labelled: DataFrame, *, max_rows_per_language: int = 3000, smoothing: float = 0.2) -> LanguageModel:
    """Learn from ``labelled`` (text, lang).

    The classifier is fitted on a bounded sample: at most ``max_rows_per_language`` distinct texts of each language,
    those of least hash, each once, however often it is repeated. So every language is learned, and copies of one
    text neither crowd out others nor raise the bound. The model holds 128 kB for each language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"))
    # a fifth more than is wanted, as the numbers are estimates; the exact limit is taken from what is left
    rates = sizes.select("lang", (F.lit(1.2 * max_rows_per_language + 100) / F.col("texts")).alias("rate"))
    near = rows.join(F.broadcast(rates), "lang").where(unit_hash("text") < F.col("rate")).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(unit_hash("text"), "h"))
    sample = near.withColumn("place", first).where(F.col("place") <= max_rows_per_language).select("lang", "text")
    counts = sample.mapInPandas(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(names)), np.float32)
    table[counts["bucket"], np.searchsorted(names, counts["lang"])] = counts["n"]
    total = table.sum(0, dtype=np.float64) + smoothing * BUCKETS
    table += np.float32(smoothing)
    np.log(table, out=table)
    table -= np.log(total).astype(np.float32)
    return LanguageModel(names, table)


def _mixture(like: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document's words under the languages that it is allowed."""
    pi = allowed / allowed.sum(1, keepdims=True)
    own = np.repeat(np.arange(len(size)), size)
    for _ in range(rounds):
        r = like * pi[own]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        pi = np.add.reduceat(r, first) / size[:, None]
    return pi, np.add.reduceat(np.log(np.maximum((like * pi[own]).sum(1), 1e-300)), first)


def _refined(words: np.ndarray, chosen: np.ndarray, value: float, price: float, most: int, rounds: int) -> np.ndarray:
    """Proportions of one text after single languages are added, dropped or exchanged, as long as that raises its value.

    A language is tried only where the slope of the likelihood leaves room for what it must add.
    """
    start, size = np.zeros(1, np.int64), np.array([len(words)])

    def fit(members: list[int]) -> tuple[np.ndarray, float]:
        allowed = np.zeros((1, words.shape[1]))
        allowed[0, members] = 1.0
        pi, ll = _mixture(words, start, size, allowed, rounds)
        return pi[0], float(ll[0])

    best = np.flatnonzero(chosen).tolist()
    here: list[int] = []
    while best != here:
        here = best
        for base in [here, *([m for m in here if m != gone] for gone in here if len(here) > 1)]:
            pi, ll = fit(base)
            tried = [] if base is here else [(base, pi, ll)]
            if len(base) < most:
                slope = (words / np.maximum(words @ pi, 1e-300)[:, None]).mean(0)
                room = len(words) * np.log(np.maximum(np.maximum(slope, slope[base].max()), 1.0))
                for j in np.flatnonzero(ll + room - price * len(base) > value):
                    if j not in here:
                        tried.append(([*base, int(j)], *fit([*base, int(j)])))
            for members, own, total in tried:
                if total - price * (len(members) - 1) > value + 1e-6:
                    best, chosen, value = members, own, total - price * (len(members) - 1)
    return chosen


def infer(texts: list[str], model: LanguageModel, *, max_set: int | None = None, penalty: float = 4.0, rounds: int = 12) -> tuple[list[np.ndarray | None], int]:
    """Proportions of each text over the model's languages, or None without a letter.

    ``penalty`` times the logarithm of the number of words is what a language beyond the first must add to
    the log-likelihood. Sets have at most ``max_set`` languages if it is given. They grow along one order of the
    languages first, and are then changed by one language at a time.
    """
    n = len(model.languages)
    out: list[np.ndarray | None] = [None] * len(texts)
    grams, first, doc = trigrams(texts)
    if not len(first) or not n:
        return out, 0
    word = np.empty((len(first), n))
    ends = np.append(first, len(grams))
    step = max(1, 40_000 // n)  # words at once, as each has several trigrams of all languages
    for lo in range(0, len(first), step):
        hi = min(lo + step, len(first))
        word[lo:hi] = np.add.reduceat(model.log_p[grams[ends[lo] : ends[hi]]], first[lo:hi] - ends[lo])
    top = word.max(1)
    like = np.exp(np.maximum(word - top[:, None], -60))
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(starts, len(doc)))
    everything = np.ones((len(size), n))
    pi, most = _mixture(like, starts, size, everything, rounds)
    own = np.repeat(np.arange(len(size)), size)
    if n > 2:
        # no mixture is likelier than this one by more than its steepest slope tells
        slope = np.add.reduceat(like / np.maximum((like * pi[own]).sum(1, keepdims=True), 1e-300), starts) / size[:, None]
        most = np.minimum(0.0, most + size * np.log(np.maximum(slope.max(1), 1.0)))
    # the total likelihood leads the order for the first language, the proportions for the others
    alone = np.add.reduceat(np.log(like), starts)
    best = alone.argmax(1)
    order = np.argsort(np.where(np.arange(n) == best[:, None], -2.0, -pi), axis=1, kind="stable")
    chosen = np.eye(n)[best]
    value = alone[np.arange(len(size)), best]
    for k in range(2, min(max_set or n, n) + 1):
        price = penalty * (k - 1) * np.log(size + 1.0)
        left = np.flatnonzero(most + 1e-3 - price > value) if n > 2 else np.arange(len(size))
        if not len(left):
            break
        allowed = np.zeros((len(left), n))
        np.put_along_axis(allowed, order[left, :k], 1.0, 1)
        words = like if len(left) == len(size) else like[np.isin(own, left)]
        p, ll = _mixture(words, np.cumsum(size[left]) - size[left], size[left], allowed, rounds)
        ll = ll - price[left]
        better = ll > value[left]
        chosen[left[better]], value[left] = p[better], np.maximum(value[left], ll)
    if n > 2 and max_set != 1:
        # sets that the order doesn't lead to; texts whose bound rules out a second language are settled
        ends = starts + size
        for i in np.flatnonzero(most + 1e-3 - penalty * np.log(size + 1.0) > value):
            chosen[i] = _refined(like[starts[i] : ends[i]], chosen[i], value[i], penalty * np.log(size[i] + 1.0), min(max_set or n, n), rounds)
    for i, d in enumerate(doc[starts]):
        out[d] = chosen[i]
    return out, len(starts)


def _identifier(shared, **options):
    @F.pandas_udf(RESULT)
    def identify_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = LanguageModel(*shared.value)
        names = np.array(model.languages, dtype=object)
        for series in batches:
            texts = ["" if t is None else t for t in series]
            rows = []
            for lo, hi in tv.chunks(texts, max(2000, tv.CHUNK * 4 // max(4, len(names)))):
                for p in infer(texts[lo:hi], model, **options)[0]:
                    if p is None:
                        rows.append((UNKNOWN, 0.0, [], []))
                        continue
                    order = [i for i in np.argsort(-p, kind="stable") if p[i] > 0]
                    rows.append((names[order[0]], float(min(1.0, p[order[0]])), names[order].tolist(), p[order].tolist()))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "languages", "proportions"])

    return identify_text


def identify_column(df: DataFrame, model: LanguageModel, *, text: str = "text", **options) -> Column:
    """A struct of lang_pred, score, languages and proportions of each text of ``df``."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_p))
    return _identifier(shared, **options)(F.col(text))


def identify(df: DataFrame, model: LanguageModel, *, text: str = "text", **options) -> DataFrame:
    """``df`` with lang_pred, score (the share of that language), languages and proportions."""
    own = spare(df, "found")
    found = df.withColumn(own, identify_column(df, model, text=text, **options))
    return found.withColumns({c: F.col(f"{own}.{c}") for c in ("lang_pred", "score", "languages", "proportions")}).drop(own)
