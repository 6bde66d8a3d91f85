"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

Voters either fire or abstain on a text: three fixed word lists, learned words that aren't in them, learned word
beginnings, repeated, neighbouring, shouted and disguised hits. A generative model with a hidden label estimates how accurate the
voters are and how they depend on each other: within each class the votes form a tree of pairwise
dependencies (the strongest by conditional mutual information), fitted by expectation-maximisation in which
the given label is one more, fallible, voter. A logistic regression on the lists' entries and the votes is
then trained on the posterior labels and scores every whole text.

The classifier is fitted on a bounded sample of labelled rows (the ``max_rows`` of least hash); near copies in
the sample count once. An entry is learned if the log-likelihood ratio of its counts exceeds what chance reaches
in one sample of ``1 / risk``, given how many entries occur often enough to reach it; so the bar follows the
size of the sample, and every entry above it is learned. Null and empty texts get the score of a text without any hit. Several labels of one document count as
toxic if one does. Without labelled rows the fixed lists alone decide. Repeated rows get equal scores, very
long texts are scored in full. Columns of the input pass through; score and predicted are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Scratch, small_batches, unit_hash

#: Fixed lists, one voter each.
LISTS = (
    ("stupid", "idiot", "idiots", "idiotic", "moron", "morons", "imbecile", "dumb", "dumbass", "fool", "brainless"),
    ("worthless", "pathetic", "loser", "losers", "useless", "failure", "nobody", "coward", "liar", "fraud"),
    ("trash", "scum", "disgusting", "garbage", "filth", "vermin", "clown", "parasite", "pig", "creep", "freak"),
)
PREFIXES = (4, 5, 6, 7, 8)
VOTERS = ("insults", "contempt", "disgust", "new words", "short beginnings", "long beginnings", "repeated", "neighbours", "shouted", "disguised")
#: Signs that stand for letters in disguised words.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
THRESHOLD = 0.3
_WORD = np.uint64(0x5BD1E995)


def _key(feature: str) -> np.uint64:
    """Hash of a list entry: ``word`` or ``begin*``."""
    stem = feature.rstrip("*")
    flat, offsets = tv.code_points([stem])
    h = tv.span_hashes(flat, offsets[:1], offsets[1:])
    return h[0] if feature.endswith("*") else tv.mix(h ^ _WORD)[0]


@dataclass(frozen=True)
class ToxicityModel:
    features: list[str]
    weights: np.ndarray  # of the features, then of the voters
    intercept: float


class Scanner:
    """Finds list entries in texts and lets the voters vote."""

    def __init__(self, features: list[str]):
        self.n = len(features)
        fixed = [w for words in LISTS for w in words]
        names = list(dict.fromkeys([*features, *fixed]))
        keys = np.array([_key(f) for f in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.place = keys[order], order
        self.door = np.zeros(1 << 16, bool)
        self.door[(keys >> np.uint64(48)).astype(np.int64)] = True
        kinds = np.zeros((len(names), len(VOTERS)), bool)
        for i, f in enumerate(names):
            for k, words in enumerate(LISTS):
                kinds[i, k] = f in words
            if i < self.n:
                stem = f.rstrip("*")
                if f not in fixed:
                    kinds[i, (4 + (len(stem) >= 6)) if f.endswith("*") else 3] = True
        self.kinds = kinds
        self.fold = np.arange(0x110000, dtype=np.uint32)
        for sign, letter in SIGNS.items():
            self.fold[ord(sign)] = ord(letter)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(self.door[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        good = self.keys[at] == h[near]
        return near[good], self.place[at[good]]

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents and features of the hits (each once), and the votes as documents x voters."""
        flat, offsets = tv.code_points([t.lower() for t in texts])
        start, end, doc = tv.word_spans(flat, offsets)
        votes = np.zeros((len(texts), len(VOTERS)), bool)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), votes
        word, entry = self._find(tv.mix(tv.span_hashes(flat, start, end) ^ _WORD))
        found = [(word, entry)]
        for n in PREFIXES:
            longer = np.flatnonzero(end - start > n)
            w, e = self._find(tv.span_hashes(flat, start[longer], start[longer] + n))
            found.append((longer[w], e))
        word, entry = (np.concatenate(x) for x in zip(*found, strict=True))
        np.logical_or.at(votes, doc[word], self.kinds[entry])
        # hits by word, in order
        at = np.unique(word)
        per_doc = np.bincount(doc[at], minlength=len(texts))
        votes[:, 6] = per_doc >= 3
        close = (np.diff(at) <= 12) & (doc[at[1:]] == doc[at[:-1]])
        votes[doc[at[1:]][close], 7] = True
        for i in at.tolist():
            d = doc[i]
            lower = texts[d].lower()
            if len(lower) == len(texts[d]):
                own = texts[d][start[i] - offsets[d] : end[i] - offsets[d]]
                votes[d, 8] |= len(own) > 2 and own.isupper()
        folded = self.fold[flat]
        fs, fe, fd = tv.word_spans(folded, offsets)
        changed = np.concatenate(([0], np.cumsum(folded != flat)))
        odd = np.flatnonzero((changed[fe] > changed[fs]) & (fe - fs <= 16))
        w, _ = self._find(tv.mix(tv.span_hashes(folded, fs[odd], fe[odd]) ^ _WORD))
        votes[fd[odd[w]], 9] = True
        own = np.unique(doc[word] * np.int64(1 << 20) + entry)
        own = own[(own & ((1 << 20) - 1)) < self.n]
        return own >> 20, own & ((1 << 20) - 1), votes


def _features(text: str) -> set[str]:
    words = {w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if 3 <= len(w) <= 24 and not w.isdigit()}
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()

    def partial() -> pd.DataFrame:
        names = list(toxic.keys() | clean.keys())
        out = pd.DataFrame({"feature": names, "toxic": [toxic[f] for f in names], "clean": [clean[f] for f in names]})
        toxic.clear()
        clean.clear()
        return out

    for b in batches:
        for text, label in zip(b["text"], b["toxic"], strict=True):
            (toxic if label else clean).update(_features(text))
            if len(toxic) + len(clean) > 100_000:  # a worker's memory doesn't grow with its rows
                yield partial()
    yield partial()


@F.pandas_udf(T.LongType())
def _kin(texts: pd.Series) -> pd.Series:
    """The least hash of a text's runs of three words, which near copies mostly share."""
    out = []
    for t in texts:
        h, doc = tv.shingles(*tv.words([t]), 3)
        out.append(int(h.min().astype(np.int64)) if len(h) else 0)
    return pd.Series(out, dtype="int64")


def _longest(support: dict[str, int]) -> list[str]:
    """The entries without beginnings that one longer entry explains: those of the word ``x`` go, as it is learned itself."""
    most = {}
    for f, a in support.items():
        stem = f.rstrip("*")
        for n in range(1, len(stem) + (not f.endswith("*"))):
            most[stem[:n]] = max(most.get(stem[:n], 0), a)
    return [f for f, a in support.items() if not (f.endswith("*") and most.get(f[:-1], 0) >= 0.9 * a)]


def _scan_rows(features: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(features)
        for b in batches:
            doc, entry, votes = scanner.scan(b["text"].tolist())
            hits: list[list[int]] = [[] for _ in range(len(b))]
            for d, e in zip(doc.tolist(), entry.tolist(), strict=True):
                hits[d].append(e)
            yield pd.DataFrame({"toxic": b["toxic"].astype("int32"), "votes": votes @ (1 << np.arange(len(VOTERS))), "hits": hits})

    return run


class LabelModel:
    """Hidden-label model of the votes: a tree of dependencies in each class, and a fallible given label."""

    def fit(self, votes: np.ndarray, label: np.ndarray, rounds: int = 25) -> LabelModel:
        y = np.where(label == 1, 0.9, 0.05)
        trust = 1.0
        for _ in range(rounds):
            self._tables(votes, y)
            # how often the given label agrees with the hidden one
            hit, miss = ((y * label).sum() + trust) / (y.sum() + 2 * trust), (((1 - y) * label).sum() + trust) / ((1 - y).sum() + 20 * trust)
            odds = self.log_odds(votes) + np.where(label == 1, np.log(hit / miss), np.log((1 - hit) / (1 - miss)))
            y = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        self.posterior = y
        return self

    def _tables(self, votes: np.ndarray, y: np.ndarray) -> None:
        n, v = votes.shape
        weights = (1 - y, y)
        self.prior = (y.sum() + 1) / (n + 2)
        joint = np.zeros((2, v, v, 2, 2))
        for c, w in enumerate(weights):
            x = np.stack([1.0 - votes, votes]) * 1.0
            joint[c] = np.einsum("n,ani,bnj->ijab", w, x, x, optimize=True) + 0.25
            joint[c] /= joint[c].sum((2, 3), keepdims=True)
        single = joint.sum(4).mean(2)  # class, voter, value
        self.accuracy = single[:, :, 1]
        own = np.stack([1 - self.prior, self.prior])[:, None, None]
        info = np.zeros((v, v))
        for c in range(2):
            info += own[c] * (joint[c] * np.log(joint[c] / (single[c][:, None, :, None] * single[c][None, :, None, :]))).sum((2, 3))
        self.dependence = info
        # greatest spanning tree over the dependencies, grown from the first voter
        self.parent, inside = [-1] * v, [0]
        while len(inside) < v:
            i, j = max(((i, j) for i in inside for j in range(v) if j not in inside), key=lambda e: info[e])
            self.parent[j] = i
            inside.append(j)
        self.log = np.zeros((2, v, 2, 2))  # class, voter, parent's value, own value
        for c in range(2):
            for j, i in enumerate(self.parent):
                self.log[c, j] = np.log(single[c, j])[None, :] if i < 0 else np.log(joint[c, i, j] / joint[c, i, j].sum(1, keepdims=True))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        x = votes.astype(int)
        out = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for j, i in enumerate(self.parent):
            above = x[:, i] if i >= 0 else np.zeros(len(x), int)
            out += self.log[1, j, above, x[:, j]] - self.log[0, j, above, x[:, j]]
        return out


def _least_gain(seen: dict[int, int], t: int, n: int, risk: float) -> float:
    """The log-likelihood ratio that any entry without bearing on the label exceeds with a probability of about ``risk``.

    ``seen`` has the number of entries by the number of rows that they are in. Entries of too few rows to reach the
    bar at best don't count among those that chance has to try.
    """
    tried = sum(seen.values())
    for k in sorted(seen):
        bar = 2 * np.log(max(tried, 1) / risk)
        if 2 * k * np.log(n / t) > bar:
            return bar
        tried -= seen[k]
    return np.inf


def _regression(doc: np.ndarray, entry: np.ndarray, width: int, y: np.ndarray, ridge: float = 0.25, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: Newton's method, steps by conjugate gradients; the intercept isn't penalised.

    Rows are given by their set entries (``doc``, ``entry``), so that memory doesn't grow with rows times entries.
    """
    n = len(y)
    doc, entry = np.concatenate((doc, np.arange(n))), np.concatenate((entry, np.full(n, width)))
    penalty = np.append(np.full(width, ridge), 1e-6)

    def rows(w: np.ndarray) -> np.ndarray:
        return np.bincount(doc, w[entry], n)

    def columns(r: np.ndarray) -> np.ndarray:
        return np.bincount(entry, r[doc], width + 1)

    w = np.zeros(width + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows(w), -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        scale = columns(curve) + penalty
        step, left = np.zeros(width + 1), columns(y - p) - penalty * w
        enough = 1e-12 * (left @ left)
        z = left / scale
        along, size = z, left @ z
        for _ in range(200):
            if left @ left <= enough:
                break
            bent = columns(curve * rows(along)) + penalty * along
            far = size / (along @ bent)
            step, left = step + far * along, left - far * bent
            z = left / scale
            along, size = z + (left @ z) / size * along, left @ z
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, risk: float = 0.05) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic), at most ``max_rows`` of them, chosen by a hash of the id."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    # the first test leaves about twice the rows, so that no task orders many
    chosen = known.where(unit_hash("doc_id") < (2 * max_rows / total if total else 0)).orderBy(unit_hash("doc_id"), "doc_id").limit(max_rows)
    scratch = Scratch(spark, "toxicity")
    try:
        # ids and labels of a bounded number of rows; without a hot key, as an id has one row
        sample = scratch.table(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("kin", _kin("text")).dropDuplicates(["kin"]).select("text", "toxic"), "sample")
        sizes = sample.groupBy().agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
        t, n = sizes["t"] or 0, sizes["n"]
        if not t or t == n:
            return ToxicityModel([], np.array([6.0, 6.0, 6.0] + [0.0] * (len(VOTERS) - 4) + [6.0]), -4.0)
        counts = sample.mapInPandas(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        counts = scratch.table(counts, "counts")
        bar = _least_gain({r[0]: r[1] for r in counts.groupBy((F.col("a") + F.col("b")).alias("seen")).count().collect()}, t, n, risk)
        seen = F.col("a") + F.col("b")
        gain = 2 * (F.col("a") * F.log(F.col("a") / (seen * (t / n))) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (seen * (1 - t / n)))).otherwise(0.0))
        best = counts.where(F.col("a") > 0).withColumn("gain", gain).where((F.col("gain") > bar) & (F.col("a") / t > 2 * F.col("b") / (n - t))).orderBy(F.desc("gain"), "feature")
        features = _longest({r["feature"]: r["a"] for r in best.collect()})
        rows = sample.mapInPandas(_scan_rows(features), "toxic int, votes long, hits array<int>").toPandas()
    finally:
        scratch.drop()
    votes = (rows["votes"].to_numpy()[:, None] >> np.arange(len(VOTERS))) & 1
    model = LabelModel().fit(votes, rows["toxic"].to_numpy())
    doc, voter = np.nonzero(votes)
    doc = np.concatenate((np.repeat(np.arange(len(rows)), rows["hits"].map(len)), doc))
    entry = np.concatenate((*rows["hits"].map(lambda h: np.asarray(h, np.int64)), voter + len(features)))
    return ToxicityModel(features, *_regression(doc, entry, len(features) + len(VOTERS), model.posterior))


def _scorer(shared):
    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, weights, intercept = shared.value
        scanner = Scanner(features)
        for series in batches:
            texts = ["" if t is None else t for t in series]
            out = np.zeros(len(texts))
            for lo, hi in tv.chunks(texts):
                doc, entry, votes = scanner.scan(texts[lo:hi])
                z = intercept + votes @ weights[len(features) :]
                np.add.at(z, doc, weights[entry])
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.Series(out)

    return toxicity


def score_column(df: DataFrame, model: ToxicityModel, *, text: str = "text") -> Column:
    """The score of each text of ``df`` as a column."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))
    return _scorer(shared)(F.col(text))


def score(df: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    return df.withColumn("score", score_column(df, model, text=text)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
