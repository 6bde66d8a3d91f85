"""Main text of web pages: structure first, and a suffix array of each host for what structure leaves open.

A page is cut into blocks. Blocks of menus, headers, footers, sidebars, notices, adverts, forms and comments
are chrome; where a page has an article (or else a main) element, the other blocks inside it are its text and
blocks outside are chrome. What is left - blocks of pages without such an element, and bare ``div`` blocks
inside one - is open. The token streams of a host's chrome and open blocks are concatenated; a suffix array
finds the substrings of at least ``least_run`` tokens that occur on ``LEAST_PAGES`` or more of its pages, at least
``LEAST_SHARE`` of them and not all the same page, and open blocks that they cover are boilerplate. So a passage
that two pages share, or a second version of a page, stays. A page none of whose text would stay keeps its open blocks, as it is a copy.

The suffix array is built by Spark tasks: each sorts the suffixes of its pages, cut to ``least_run`` tokens,
and folds equal ones into a row with their number of pages, the least and the greatest, so a line that a host repeats on all pages
is one row for each task; the rows are merged by an aggregation over (host, suffix). Paragraphs of articles
are never removed: with articles that quote each other or are copied, the suffix array alone would drop them.

Null and empty pages have an empty text; a null url is a host of its own. Rows with equal html and url get
equal results and stay separate rows. Broken or cut markup is read as far as it goes. Other columns pass.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Scratch, small_batches

#: Elements whose content isn't text, and elements that are chrome.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "canvas", "math", "select", "button", "audio", "video")
CHROME = ("nav", "footer", "header", "aside", "form", "menu", "dialog", "head")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Words of class, id and role attributes that mark chrome.
MARKS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "dialog", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menubar",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "promotion", "recommended",
    "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "toolbar", "widget",
)
#: Words that name an article's body, and marks that then say nothing.
_CONTENT, _FEATURES = frozenset(("content", "body", "text")), frozenset(("form", "header", "search", "share", "sharing", "social", "widget"))
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MARKS, _BLOCKS, _CHROME, _VOID, _RAW = map(frozenset, (MARKS, BLOCKS, CHROME, VOID, RAW))
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
#: Elements that end an open one of the same group when they start.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
KEEP, OPEN, DROP = 0, 1, 2


def _chrome(name: str, attributes: str) -> str:
    """Why an element is chrome: ``element``, ``header`` (its headings may be an article's), ``marked``; else nothing."""
    if name in _CHROME:
        return "header" if name == "header" else "element"
    if not attributes or name in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return ""
    words = {w for _, v in _ATTRIBUTE.findall(attributes) for w in re.split(r"[^a-z0-9]+", v.lower())}
    marks = words & _MARKS
    if words & _CONTENT:  # an article's body may be named for what it can do
        marks -= _FEATURES
    if marks:
        return "header" if marks == {"header"} else "marked"
    plain = re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: m[0] if "display" in m[0].lower() else '""', attributes)
    return "element" if _HIDDEN.search(plain) else ""


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(element, text, KEEP or OPEN or DROP) of each block of ``page`` that has text, in order."""
    found: list[list] = []  # element, text, chrome, in article, in main, in an article whose surroundings are marked
    stack: list[tuple[str, str]] = []  # element, why chrome begins with it
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                names = [n for n, _ in stack]
                element = next((n for n in reversed(names) if n in _BLOCKS), "body")
                article = next((i for i, n in enumerate(names) if n == "article"), None)
                marks = [i for i, (_, c) in enumerate(stack) if c]
                # the headings in an article's own header are part of it
                if article is not None and element in HEADINGS:
                    marks = [i for i in marks if i < article or stack[i][1] != "header"]
                around = article is not None and all(i < article and stack[i][1] in ("marked", "header") and stack[i][0] != "header" for i in marks)
                found.append([element, text, bool(marks), article is not None and not marks, "main" in names and not marks, around])

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name in _RAW:
            if not closing and not m[3].endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        block = name in _BLOCKS
        if name == "br":
            pieces.append(" ")
            continue
        if block:
            flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # an unclosed inline element doesn't outlive its block; an inline end doesn't close blocks
            if depth is not None and (block or not any(n in _BLOCKS for n, _ in stack[depth + 1 :])):
                del stack[depth:]
        elif name not in _VOID and not m[3].endswith("/"):
            if name in _ENDS:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCKS), None)
                if depth is not None and stack[depth][0] in _ENDS[name]:
                    del stack[depth:]
            elif block and (p := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCKS), None)) is not None and stack[p][0] == "p":
                del stack[p:]
            stack.append((name, _chrome(name, m[3])))
    flush()
    article, main = any(b[3] for b in found), any(b[4] for b in found)
    if not article and any(b[5] for b in found):  # the only article stands in a marked wrapper: its name says nothing
        found = [[*b[:2], b[2] and not b[5], b[5], *b[4:]] for b in found]
        article = True
    out = []
    for element, text, chrome, in_article, in_main, _ in found:
        inside = in_article if article else in_main
        if chrome or (article or main) and not inside:
            out.append((element, text, DROP))
        else:
            out.append((element, text, KEEP if (article or main) and element not in ("div", "section") else OPEN))
    return out


#: A run is boilerplate if so many pages of its host have it, and such a share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.3


def host_of(url: str | None) -> str:
    if not url or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower()


def stream(parts: list[tuple[str, str, int]]) -> tuple[list[str], list[int]]:
    """Tokens of the blocks that aren't kept, each block led by its element, and the block of each token.

    A kept block breaks the stream (an empty token)."""
    tokens: list[str] = []
    owner: list[int] = []
    for i, (element, text, state) in enumerate(parts):
        own = [""] if state == KEEP else [f"<{element}>", *text.split(" ")]
        tokens += own
        owner += [i] * len(own)
    return tokens, owner


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``tokens`` by their first ``depth`` tokens, and each suffix's rank.

    Ranks are found by prefix doubling; suffixes of equal rank share at least ``depth`` tokens. Only the
    suffixes that are that long are ranked.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        n = len(tokens) - known - step + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.unique(rank[:n] * (rank.max() + 1) + rank[step : step + n], return_inverse=True)[1]
        known += step
    return np.argsort(rank, kind="stable"), rank


def _hash64(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _parse(least_run: int):
    fields = (
        "page long", "host long", "open int", "kept string", "states binary", "texts array<string>", "suffix array<long>", "least array<long>",
        "greatest array<long>", "seen array<long>", "own array<long>", "owner array<int>", "covers array<int>",
    )

    def rows_of(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        parsed = [blocks(p or "") for p in pages]
        me, host = [_hash64(p) for p in pages], [_hash64(host_of(u)) for u in urls]
        # one token stream of all pages; a break, unlike any other token, ends each page
        streams = [stream(parts) for parts in parsed]
        tokens = [t for own, _ in streams for t in [*own, ""]]
        row = np.repeat(np.arange(len(parsed)), [len(own) + 1 for own, _ in streams])
        place = np.concatenate([np.arange(len(own) + 1) for own, _ in streams])
        flat, offsets = tv.code_points(tokens)
        words = tv.span_hashes(flat, offsets[:-1], offsets[1:])
        broken = np.array([t == "" for t in tokens])
        hosts, pages_at = np.array(host, np.int64), np.array(me, np.int64)
        with np.errstate(over="ignore"):
            words = tv.mix(words ^ hosts[row].astype(np.uint64))
            words[broken] = np.arange(broken.sum(), dtype=np.uint64)
            order, rank = suffix_array(words, least_run)
            n = len(rank)
            name = np.zeros(n, np.uint64)
            for k in range(least_run):
                name = tv.mix(name * np.uint64(31) + words[k : k + n])
        name = name.astype(np.int64)
        breaks = np.concatenate(([0], np.cumsum(broken)))
        whole = breaks[least_run : least_run + n] == breaks[:n]
        order = order[whole[order]]
        # neighbours in the suffix array of equal rank are one row, with the least and greatest page
        order = order[np.lexsort((row[order], pages_at[row[order]], rank[order]))]
        first = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1]))) if len(order) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(order)) - 1 if len(first) else first
        # pages of each, as rows of the batch
        new = np.concatenate(([True], (rank[order][1:] != rank[order][:-1]) | (row[order][1:] != row[order][:-1]))) if len(order) else np.zeros(0, bool)
        seen = np.add.reduceat(new.astype(np.int64), first) if len(first) else first
        carrier = row[order[first]]
        by_row = np.argsort(carrier, kind="stable")
        cut = np.searchsorted(carrier[by_row], np.arange(len(parsed) + 1))
        bounds = np.searchsorted(row, np.arange(len(parsed) + 1))
        out = []
        for i, (parts, (_, owner)) in enumerate(zip(parsed, streams, strict=True)):
            own = by_row[cut[i] : cut[i + 1]]
            heads, tails = order[first[own]], order[last[own]]
            n_open = sum(s == OPEN for _, _, s in parts)
            at = np.arange(bounds[i], min(bounds[i + 1], n)) if n_open else np.zeros(0, np.int64)
            at = at[whole[at]]
            out.append((
                me[i], host[i], n_open, "\n".join(t for _, t, s in parts if s == KEEP),
                bytes(s for _, _, s in parts) if n_open else b"", [t for _, t, _ in parts] if n_open else [],
                name[heads], pages_at[row[heads]], pages_at[row[tails]], seen[own],
                name[at], owner if n_open else [], place[at].astype(np.int32),
            ))
        return pd.DataFrame(out, columns=[f.split()[0] for f in fields])

    @F.pandas_udf(T.StructType.fromDDL(", ".join(fields)))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, urls in batches:
            parts = [rows_of(pages.iloc[lo:hi], urls.iloc[lo:hi]) for lo, hi in tv.chunks([p or "" for p in pages], 8 * tv.CHUNK)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[f.split()[0] for f in fields])

    return run


def _decide(least_run: int):
    def run(states: pd.Series, texts: pd.Series, owner: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for s, t, own, at in zip(states, texts, owner, starts, strict=True):
            own = np.asarray(own, np.int64)
            covered = np.zeros(len(own) + 1, np.int64)
            for i in [] if at is None else at:
                covered[i] += 1
                covered[min(i + least_run, len(own))] -= 1
            on = np.cumsum(covered)[:-1] > 0
            share = np.bincount(own, on, len(s)) / np.maximum(np.bincount(own, minlength=len(s)), 1)
            gone = np.array([x == OPEN for x in s]) & (share >= 0.9)
            stay = [x for x, k, g in zip(t, s, gone, strict=True) if k != DROP and not g]
            out.append("\n".join(stay or [x for x, k in zip(t, s, strict=True) if k != DROP]))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.StringType())


def extract(df: DataFrame, *, page: str = "html", url: str = "url", least_run: int = 12) -> DataFrame:
    """``df`` without ``page``, with text (the main text) and n_chars (its code points).

    A scratch table below ``spark.checkpoint.dir`` holds the parsed pages that the result reads.
    """
    small_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "pages")
    rest = [c for c in df.columns if c not in (page, "text", "n_chars")]
    both = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), _parse(least_run)(F.col(page), F.col(url)).alias("_p"))
    parsed = scratch.table(both.select("_row", "_p.*"), "parsed")
    # suffixes that are on distinct pages of a host
    runs = parsed.where(F.size("suffix") > 0).select("host", F.explode(F.arrays_zip("suffix", "least", "greatest", "seen")).alias("s")).select("host", "s.*")
    repeated = runs.groupBy("host", "suffix").agg(F.min("least").alias("lo"), F.max("greatest").alias("hi"), F.sum("seen").alias("seen")).where(f"lo < hi and seen >= {LEAST_PAGES}")
    repeated = repeated.join(parsed.groupBy("host").agg(F.count("*").alias("pages")), "host").where(F.col("seen") >= LEAST_SHARE * F.col("pages")).select("host", "suffix")
    unsure = parsed.where("open > 0")
    at = unsure.select("page", "host", F.explode(F.arrays_zip("own", "covers")).alias("s")).select("page", "host", F.col("s.own").alias("suffix"), F.col("s.covers").alias("start")).distinct()
    covers = at.join(repeated, ["host", "suffix"], "left_semi").groupBy("page", "host").agg(F.collect_list("start").alias("starts"))
    decided = unsure.join(covers, ["page", "host"], "left").select("_row", _decide(least_run)("states", "texts", "owner", "starts").alias("text"))
    out = parsed.where("open = 0").select("_row", F.col("kept").alias("text")).union(decided)
    return out.select("_row.*", "text").withColumn("n_chars", F.length("text").cast("long"))
