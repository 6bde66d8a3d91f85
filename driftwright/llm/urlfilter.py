"""URL filters: host names cut into words by a unigram Viterbi search, judged by multinomial naive Bayes.

Explicit rules come first: a rule is a host with a path beginning (``example.net/en/``), fits the host and
its subdomains where the url's path starts with the rule's, and the longest one that fits decides. Other urls
are judged by the words of their host and path. Both classes are learned from the corpus, where each distinct
host counts once, so that a host with a third of all rows weighs no more than another: a host that fixed lists of
words mark is unwanted, the others are ordinary, and each word's counts in both speak for or against it. A word
that the corpus and the lists don't know says nothing.

The words that names are cut into are learned too: what stands by itself between other characters in hosts and
paths of at least ``least_hosts`` hosts is a word, unless the lists cut it into several. Half of the
probabilities is from the corpus, half from the lists.

A null url or one without ``://`` has an empty host and path, no rule and the verdict ``allow``. Equal urls
get equal results; each row stays. Very long urls are read in full. Ties between cuts go to the one with the
longest first word, ties between rules of one length to the first in alphabetical order. An empty table has an
empty result. Columns of the input pass through; the output columns replace columns of their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare

#: Words of unwanted sites, strong by themselves and weak ones that need company.
STRONG = (
    "adult", "bet", "bets", "betting", "bingo", "casino", "casinos", "cialis", "cracked", "escort", "escorts", "erotic", "fetish", "gambling", "hentai",
    "hookup", "jackpot", "keygen", "malware", "nude", "nudes", "pharma", "phish", "phishing", "pills", "poker", "porn", "porno", "roulette", "scam",
    "sex", "sexy", "slots", "spam", "spammer", "steroids", "viagra", "warez", "xxx",
)
WEAK = (
    "ads", "bonus", "bucks", "buy", "cam", "cams", "cash", "cheap", "chips", "clicks", "coin", "coins", "credit", "crypto", "dating", "deal", "deals", "diet",
    "discount", "earn", "farm", "fast", "forex", "free", "girls", "hot", "instant", "live", "loan", "loans", "lottery", "lucky", "meds", "mega", "money", "offer", "offers", "online",
    "payday", "prize", "promo", "replica", "rich", "sale", "spin", "torrent", "torrents", "track", "tracker", "tracking", "traffic", "vip", "virus", "weed", "win", "winner", "wins", "x",
)
#: Ordinary words that names are often put together from.
ORDINARY = (
    "about", "academy", "api", "archive", "art", "auto", "blog", "book", "books", "business", "car", "center", "city", "cloud", "club", "code", "company", "data",
    "design", "docs", "edu", "farmers", "food", "forum", "garden", "global", "green", "group", "guide", "health", "help", "home", "house", "info", "journal", "kids",
    "lab", "learn", "library", "life", "mail", "map", "market", "media", "music", "my", "net", "network", "news", "page", "paper", "park", "photo", "press", "project",
    "radio", "school", "science", "shop", "site", "soft", "sport", "store", "studio", "team", "tech", "the", "times", "today", "town", "travel", "tree", "university",
    "video", "water", "web", "wiki", "wood", "work", "world",
)
#: Labels of hosts that say nothing about the site.
PLAIN = ("www", "m", "com", "net", "org", "co", "io", "de", "en", "fr", "es", "html", "htm", "php", "index", "example")
BINS = 1 << 16
RESULT = "host string, path string, rule string, verdict string, words array<string>, log_odds double"
_TOKEN = re.compile(r"[a-z]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url, both empty where it is null or has no ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


@lru_cache(1)
def _masses() -> dict[str, float]:
    known = dict.fromkeys((*ORDINARY, *WEAK, *STRONG), 2.0)
    mass = {w: n * min(1.0, len(w) / 4) ** 2 for w, n in known.items()}
    total = sum(mass.values())
    return {w: n / total for w, n in mass.items()}


@lru_cache(1)
def lexicon() -> dict[str, float]:
    """Log-probability of each known word without a corpus: the lists stand in for counts, short words are less likely."""
    return {w: math.log(p) for w, p in _masses().items()}


def learned_lexicon(seen: np.ndarray, learned: dict[str, int] | None = None) -> dict[str, float]:
    """Log-probability of each known word, half of it from the lists and half from how many hosts hold it.

    ``seen`` counts hosts of the listed words, ``learned`` those of others."""
    learned = learned or {}
    total = int(seen.sum()) + sum(learned.values())
    if not total:
        return lexicon()
    listed = {w: math.log((p + n / total) / 2) for (w, p), n in zip(_masses().items(), seen.tolist(), strict=True)}
    return listed | {w: math.log(n / total / 2) for w, n in learned.items()}


def learned_words(df: DataFrame, *, url: str = "url", least_hosts: int = 3, most_words: int = 100_000) -> dict[str, int]:
    """Words of four to twelve letters that stand by themselves in urls of ``least_hosts`` hosts, and of how many.

    The model holds the ``most_words`` most frequent ones, the first in alphabetical order of equals."""
    host, path = host_and_path(F.col(url))
    words = F.split(F.concat_ws("/", F.col("host"), F.lower("path")), "[^a-z]+")
    own = df.select(host.alias("host"), path.alias("path")).where("host <> ''").select("host", F.explode(F.array_distinct(words)).alias("word"))
    known = own.where(F.length("word").between(4, 12) & ~F.col("word").isin(*PLAIN, *_masses())).distinct().groupBy("word").agg(F.count("*").alias("n"))
    found = known.where(F.col("n") >= least_hosts).orderBy(F.desc("n"), "word").limit(most_words).toPandas()
    return {w: n for w, n in zip(found["word"], found["n"].tolist(), strict=True) if pieces(w) == [w]}


def segment(name: str, known: dict[str, float] | None = None) -> list[str]:
    """The likeliest cut of ``name`` into known words and unknown runs, by a Viterbi search.

    An unknown run costs a start and a charge for each letter, so a known word must be worth more than its
    letters; a run that no known word fits well stays whole.
    """
    known, n, longest = lexicon() if known is None else known, len(name), 12
    best, cut, odd = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            p = known.get(name[start:end])
            if p is not None and best[start] + p > best[end]:
                best[end], cut[end], odd[end] = best[start] + p, start, False
        # one more letter of an unknown run, or the start of one
        start = cut[end - 1] if odd[end - 1] else end - 1
        value = best[end - 1] - 2.6 - (0 if odd[end - 1] else 6.0)
        if value > best[end]:
            best[end], cut[end], odd[end] = value, start, True
    words = []
    while n:
        words.append(name[cut[n] : n])
        n = cut[n]
    return words[::-1]


def pieces(name: str, known: dict[str, float] | None = None) -> list[str]:
    """The cut of ``name``, where a known word of under four letters that touches an unknown run is part of it.

    So few letters stand in other words by chance (``essex``, ``alphabet``)."""
    listed, out, odd = lexicon() if known is None else known, [], False
    words = segment(name, known)
    for i, w in enumerate(words):
        loose = w not in listed or (len(w) < 4 and (odd or (i + 1 < len(words) and words[i + 1] not in listed)))
        out[len(out) - (loose and odd) :] = ["".join(out[len(out) - (loose and odd) :]) + w]
        odd = loose
    return out


def tokens(host: str, path: str, known: dict[str, float] | None = None) -> list[str]:
    """Words of a host's labels and a path's parts, without those that are plain."""
    return [w for t in _TOKEN.findall(host) + _TOKEN.findall(path.lower()) if t not in PLAIN for w in pieces(t, known)]


@lru_cache(1)
def _places() -> dict[str, int]:
    return {w: BINS + i for i, w in enumerate(_masses())}


@lru_cache(1 << 16)
def _bin(word: str) -> int:
    """Where a word is counted: known words have a place of their own, others a hashed bin."""
    at = _places().get(word)
    return at if at is not None else int(np.uint64(sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, c in enumerate(word)) % (1 << 64)) >> np.uint64(48))


class Model(NamedTuple):
    """The log-probabilities of known words, and in how many ordinary and unwanted hosts (rows) each bin's words are."""

    known: dict[str, float]
    counts: np.ndarray


def _counter(known: dict[str, float] | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seeds = np.zeros((2, BINS + len(_places())), np.int64), Judge()
        for b in batches:
            for host in b["host"]:
                words = set(tokens(host, "", known))
                total[int(seeds.log_odds(sorted(words)) > 0), [_bin(w) for w in words]] += 1
        unwanted, has = np.nonzero(total)
        yield pd.DataFrame({"unwanted": unwanted.astype("int32"), "bin": has.astype("int32"), "n": total[unwanted, has]})

    return count


def _counts(hosts: DataFrame, known: dict[str, float] | None) -> np.ndarray:
    found = hosts.mapInPandas(_counter(known), "unwanted int, bin int, n long").groupBy("unwanted", "bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, BINS + len(_places())), np.int64)
    out[found["unwanted"], found["bin"]] = found["n"]
    return out


def train(df: DataFrame, *, url: str = "url") -> Model:
    """What the distinct hosts of ``df`` say: the words of names first, then both classes' counts of them.

    Counts are of a fixed size whatever the corpus; hosts that the lists alone judge unwanted teach that class."""
    hosts = df.select(host_and_path(F.col(url))[0].alias("host")).where("host <> ''").distinct()
    known = learned_lexicon(_counts(hosts, None)[:, BINS:].sum(axis=0), learned_words(df, url=url))
    return Model(known, _counts(hosts, known))


class Judge:
    """Naive Bayes over words, with the counts of ordinary and unwanted hosts smoothed by the lists.

    In each class a word's count stands against what it would be if the classes didn't differ, both with
    ``smooth`` more hosts, so that a word without counts speaks for neither. Of unwanted sites' words ``mixed``
    are not of the lists."""

    def __init__(self, counts: np.ndarray | None = None, prior: float = 0.001, mixed: float = 0.3, smooth: float = 4.0):
        self.counts = np.zeros((2, BINS + len(_places())), np.int64) if counts is None else counts
        self.size, self.mixed, self.smooth = self.counts.sum(axis=1).tolist(), mixed, smooth
        self.prior = math.log(prior / (1 - prior))
        # a strong word counts as many weak ones
        self.bad = {**dict.fromkeys(WEAK, 1.0), **dict.fromkeys(STRONG, 8.0)}
        self.bad_total = sum(self.bad.values())
        self.rare = 0.01 / (4.0 * len(ORDINARY) + 1000 + 0.01 * 20_000)

    @lru_cache(1 << 16)  # noqa: B019
    def word(self, w: str) -> float:
        """Log-odds that a word speaks for an unwanted site."""
        listed = self.bad.get(w, 0.0)
        start = (1 - self.mixed) * listed / self.bad_total / self.rare + self.mixed if listed else 1.0
        good, bad = self.counts[:, _bin(w)].tolist()
        share = (good + bad) / max(1, sum(self.size))
        # how much oftener than by its share of all hosts the word is in either class
        more = [(n + self.smooth * s) / (share * size + self.smooth) for n, size, s in zip((good, bad), self.size, (1.0, start), strict=True)]
        return math.log(more[1] / more[0])

    def log_odds(self, words: list[str]) -> float:
        return self.prior + sum(map(self.word, words))


def _rule(host: str, path: str, rules: list[tuple[str, str, str, str]]) -> tuple[str, str] | None:
    for text, rule_host, rule_path, verdict in rules:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            return text, verdict
    return None


def _judge(shared, rules):
    @F.pandas_udf(T.StructType.fromDDL("rule string, verdict string, words array<string>, log_odds double"))
    def judge_parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        judge = Judge(counts)
        for hosts, paths in batches:
            rows = []
            for host, path in zip(hosts, paths, strict=True):
                words = tokens(host, path, known)
                odds = judge.log_odds(words)
                rule, verdict = _rule(host, path, rules) or (None, "block" if odds > 0 else "allow")
                rows.append((rule, verdict, words, odds))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "words", "log_odds"])

    return judge_parts


def apply(df: DataFrame, model: Model, *, block: tuple[str, ...] = (), allow: tuple[str, ...] = (), url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict, words and log_odds (above 0: unwanted)."""
    rules = [(r, *r.partition("/")[::2], v) for v, own in (("block", block), ("allow", allow)) for r in own]
    rules = sorted(((r, h, "/" + p, v) for r, h, p, v in rules), key=lambda x: (-len(x[0]), x[0]))
    shared = df.sparkSession.sparkContext.broadcast(tuple(model))
    host, path = host_and_path(F.col(url))
    at, own = spare(df, "found"), spare(df, "judged")
    found = df.withColumn(at, F.struct(host.alias("host"), path.alias("path"))).withColumn(own, _judge(shared, rules)(F.col(f"{at}.host"), F.col(f"{at}.path")))
    out = {"host": f"{at}.host", "path": f"{at}.path"} | {c: f"{own}.{c}" for c in ("rule", "verdict", "words", "log_odds")}
    return found.withColumns({k: F.col(v) for k, v in out.items()}).drop(at, own)
