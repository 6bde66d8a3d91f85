"""Quality of documents: histogram gradient-boosted trees over their statistics.

A document's statistics are shares and lengths that don't depend on its language: kinds of characters, capitals,
signs beside words, repeated words, lines and passages, lengths of words, lines and sentences. They are counted
for a batch of texts at once in arrays of code points, over whole texts.

The trees are fitted on a bounded sample of labelled rows (the ``max_rows`` of least hash). Statistics are cut
into bins at quantiles of the sample; each level of a tree adds up gradients and curvatures by node, statistic
and bin, and each node takes the cut of the greatest gain. Trees are complete and lie in flat arrays: node i has
the children 2i+1 and 2i+2. All documents of a batch go down all trees together, a level in each step.

Null and empty texts have the statistics of a text without characters. A document with several labels counts as
poor if one says so; repeated rows get equal scores; rows without an id or a label teach nothing. If the labelled
rows have one label only, it is everybody's; without any, scores are 0.5. Very long texts are scored in full.
Columns of the input pass through; score and predicted are replaced. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Scratch, small_batches, unit_hash

STATISTICS = (
    "characters", "words", "word length", "word length spread", "longest word", "letters", "capitals", "digits", "white space", "line breaks", "signs", "punctuation", "other signs", "sign runs",
    "capital words", "words before signs", "signs alone", "equal neighbours", "longest run of a word", "distinct words", "distinct triples", "line length", "repeated lines", "short lines", "sentence length",
)
THRESHOLD = 0.5
_PUNCTUATION = ".,;:'\"()?-"
_STOPS = ".!?"


def _flags(own: str) -> np.ndarray:
    out = np.zeros(128, bool)
    out[[ord(c) for c in own]] = True
    return out


_IS_PUNCTUATION, _IS_STOP, _IS_SPACE = _flags(_PUNCTUATION), _flags(_STOPS), _flags(" \t\n\r\x0b\x0c")


def _ascii(table: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return table[np.minimum(flat, 127)] & (flat < 127)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each document."""
    if not len(doc):
        return np.zeros(n)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    return np.bincount(d[np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])))], minlength=n).astype(float)


def _longest_run(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    if len(doc):
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))))
        np.maximum.at(out, doc[first], np.diff(np.append(first, len(doc))))
    return out


def statistics(texts: list[str]) -> np.ndarray:
    """Documents x ``STATISTICS``."""
    n = len(texts)
    flat, offsets = tv.code_points(texts)
    lower, low_offsets = tv.code_points([t.lower() for t in texts])
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    chars = np.diff(offsets).astype(float)
    count = lambda mask: np.bincount(doc_of[mask], minlength=n).astype(float)
    letter, word = tv.letters()[flat], tv.word_chars()[flat]
    space, line = _ascii(_IS_SPACE, flat), flat == 10
    upper = letter & ((flat >= 65) & (flat <= 90) | (flat >= 0xC0) & (flat <= 0xDE) & (flat != 0xD7))
    sign = ~word & ~space
    plain = _ascii(_IS_PUNCTUATION, flat)
    start, end, doc = tv.word_spans(flat, offsets)
    size, words = (end - start).astype(float), np.bincount(doc, minlength=n).astype(float)
    per = lambda x, total: x / np.maximum(total, 1)
    mean = per(np.bincount(doc, size, n), words)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    uppers = np.concatenate(([0], np.cumsum(upper)))
    shout = (size > 1) & (uppers[end] - uppers[start] == end - start)
    # a sign of no ordinary punctuation right after a word, or between two spaces; equal neighbouring signs
    odd = sign & ~plain
    padded = np.concatenate((flat, [32]))
    follows = np.concatenate((odd, [False]))[end] & (np.append(doc_of, n)[np.minimum(end, len(doc_of))] == doc) if len(end) else np.zeros(0, bool)
    before = np.concatenate(([True], space[:-1])) if len(flat) else np.zeros(0, bool)
    after = np.concatenate((space[1:], [True])) if len(flat) else np.zeros(0, bool)
    alone = odd & before & after
    doubled = sign & (flat == padded[1:])
    # words and lines as hashes of lower-cased text
    ls, le, ld = tv.word_spans(lower, low_offsets)
    h = tv.span_hashes(lower, ls, le)
    equal = (h[1:] == h[:-1]) & (ld[1:] == ld[:-1]) if len(h) else np.zeros(0, bool)
    low_words = np.bincount(ld, minlength=n).astype(float)
    triples, td = tv.shingles(h, ld, 3)
    inside = np.ones(0x110000, bool)
    inside[10] = False
    rs, re_, rd = tv.word_spans(lower, low_offsets, inside)
    lines = np.bincount(rd, minlength=n).astype(float)
    short = np.bincount(rd[re_ - rs < 20], minlength=n).astype(float)
    stops = count(_ascii(_IS_STOP, flat) & ~np.concatenate((_ascii(_IS_STOP, flat)[1:], [False]))) if len(flat) else np.zeros(n)
    letters = count(letter)
    return np.stack(
        [
            np.log1p(chars), np.log1p(words), mean, np.sqrt(np.maximum(per(np.bincount(doc, size * size, n), words) - mean * mean, 0)), np.log1p(longest), per(letters, chars), per(count(upper), letters), per(count(word & ~letter), chars),
            per(count(space), chars), per(count(line), chars), per(count(sign), chars), per(count(plain), chars), per(count(odd), chars), per(count(doubled), chars),
            per(np.bincount(doc[shout], minlength=n), words), per(np.bincount(doc[follows], minlength=n), words), per(count(alone), words), per(np.bincount(ld[1:][equal], minlength=n) if len(h) else np.zeros(n), low_words),
            np.log1p(_longest_run(ld, h, n)), per(_distinct(ld, h, n), low_words), per(_distinct(td, triples, n), np.bincount(td, minlength=n)), np.log1p(per(chars, lines)), 1 - per(_distinct(rd, tv.span_hashes(lower, rs, re_), n), lines), per(short, lines), np.log1p(per(words, stops)),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class QualityModel:
    """Complete trees: rows are trees, columns nodes; a node sends to the right what exceeds its cut."""

    statistic: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of ``x``."""
        out = np.full(len(x), self.start)
        if not len(self.leaf):
            return out
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        trees, rows = np.arange(len(self.leaf)), np.arange(len(x))[:, None]
        inner = self.cut.shape[1]
        while (node < inner).all() and node.size:  # the trees are complete, so all rows are at one level
            node = 2 * node + 1 + (x[rows, self.statistic[trees, node]] > self.cut[trees, node])
        return out + self.leaf[trees, node - inner].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> QualityModel:
    """Boosted trees on the rows of ``x`` with labels ``y`` (0 or 1), by second-order gains of the logistic loss.

    ``least`` is the curvature that both sides of a cut have at least. Equal gains go to the first statistic and cut.
    """
    inner = (1 << depth) - 1
    none = QualityModel(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return none
    if y.min() == y.max():
        return QualityModel(none.statistic, none.cut, none.leaf, 5.0 if y[0] else -5.0)
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin b: above cut b - 1, up to cut b
    places = binned + np.arange(width) * bins
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, made = np.full(len(y), start), []
    real = np.array([[b < len(c) for b in range(bins)] for c in cuts])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node, statistic, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * bins) + places).ravel()
            sums = [np.bincount(at, np.repeat(v, width), n * width * bins).reshape(n, width, bins).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, [s[:, :, -1:] for s in sums]
            gain = gl * gl / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt * gt / (ht + penalty)
            gain = np.where(real & (hl >= least) & (ht - hl >= least), gain, 0.0).reshape(n, -1)
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(n), best] > 1e-9):
                j, b = divmod(int(best[k]), bins)
                statistic[first + k], cut[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), statistic[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        margin += value[leaf]
        made.append((statistic, cut, value))
    return QualityModel(*(np.stack(m) for m in zip(*made, strict=True)), start)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = ["" if t is None else t for t in b["text"]]
        for lo, hi in tv.chunks(texts):
            yield pd.DataFrame({"doc_id": b["doc_id"][lo:hi].to_numpy(), "quality": b["quality"][lo:hi].to_numpy(), "x": list(statistics(texts[lo:hi]))})


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, quality), at most ``max_rows`` labels, chosen by a hash of the id.

    Texts become rows of statistics in the tasks; only these, of the bounded sample, reach the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    total = known.count()
    # the first test leaves about twice the rows, so that no task orders many
    chosen = known.where(unit_hash("doc_id") < (2 * max_rows / total if total else 0)).orderBy(unit_hash("doc_id"), "doc_id").limit(max_rows)
    scratch = Scratch(spark, "quality")
    try:
        # ids and labels of a bounded number of rows; repeated rows of a document teach once
        sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
        kind = dict(docs.dtypes)["doc_id"]
        rows = scratch.table(sample.mapInPandas(_rows, f"doc_id {kind}, quality int, x array<double>"), "sample").orderBy("doc_id").toPandas()
    finally:
        scratch.drop()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(STATISTICS)))
    return fit(x, rows["quality"].to_numpy(float))


def _scorer(shared):
    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for series in batches:
            texts = ["" if t is None else t for t in series]
            out = np.zeros(len(texts))
            for lo, hi in tv.chunks(texts):
                out[lo:hi] = model.scores(statistics(texts[lo:hi]))
            yield pd.Series(out)

    return quality


def score_column(df: DataFrame, model: QualityModel, *, text: str = "text") -> Column:
    """The score of each text of ``df`` as a column: 0 to 1, higher for better."""
    small_batches(df.sparkSession)
    return _scorer(df.sparkSession.sparkContext.broadcast(model))(F.col(f"`{text}`"))


def score(df: DataFrame, model: QualityModel, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score and predicted (1 from ``threshold`` on)."""
    return df.withColumn("score", score_column(df, model, text=text)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
