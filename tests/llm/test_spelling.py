"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwright.llm import spelling
from driftwright.llm.common import Scratch

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def distance_is_one(a, b):
    """By the full table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1] == 1


def plain(counted, ratio=5):
    form, out = {}, []
    near = {w: [v for v in counted if abs(len(v) - len(w)) < 2 and distance_is_one(w, v)] for w in counted}
    for w, n in counted.items():
        best = min(near[w], key=lambda v: (-counted[v], v), default=None)
        form[w] = best if best is not None and counted[best] >= ratio * n else None
    for w, n in counted.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counted.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def found(spark, counted, **settings_):
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    return sorted((tuple(r[c] for c in COLUMNS) for r in spelling.variants(df, **settings_).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("long", [64, 7, 0])
def test_variants_equal_all_pairs(spark, long):
    r = random.Random(3)
    counted = {}
    for _ in range(300):
        w = "".join(r.choice("abé") for _ in range(r.randint(6, 9)))
        counted[w] = r.choice([5, 6, 25, 26, 125, 700])
    # a chain of forms, ties, and two strings of one deletion that aren't near
    counted |= {"zzzzzz": 5, "zzzzzzz": 25, "zzzzzzzz": 125, "zzzzzzzzz": 625, "abcdefg": 5, "abcdegf": 5}
    assert found(spark, counted, long=long) == plain(counted)


def test_very_long_words(spark):
    base = "acgt" * 2000
    counted = {base: 100, base + "a": 5, base[:900] + base[901:]: 7, base[:50] + "cc" + base[52:]: 6, "x" * 64: 50, "x" * 65: 5, "x" * 66: 5}
    got = {r[0]: r[1:] for r in found(spark, counted)}
    assert got[base + "a"] == (base, base, 5, 1, 100) and got[base][3] == 2 and got[base[:50] + "cc" + base[52:]][3] == 0
    assert got["x" * 65] == ("x" * 64, "x" * 64, 5, 2, 50) and got["x" * 66] == (None, "x" * 66, 5, 1, None)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aàb", min_size=1, max_size=6), min_size=1, max_size=12))
def test_keys_are_equal_where_deletions_are(words):
    key, of, place = spelling.deletions(words)
    text = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(of.tolist(), place.tolist(), strict=True)]
    assert len(set(key.tolist())) == len(set(text)) == len(set(zip(key.tolist(), text, strict=True)))


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_near_is_distance_one(a, b):
    assert spelling._near(a, b) == distance_is_one(a, b)


def test_words_of_texts(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["Straßen", "ÉTUDES", "études", "theorem", "short", "garden7gardens", "a" * 5000]) for _ in range(40)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (None, texts[0], "x"), (3, texts[3], "x")]
    expected = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            expected[low if h % 7 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    df = spark.createDataFrame(rows, "`doc.id` long, text string, n string").repartition(5)
    got = {x["word"]: x["n"] for x in spelling.words(df, id_="doc.id", every=7).collect()}
    assert got == {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5} and any(w.startswith("étud") and "é" != w[-1] for w in got)


def test_empty_tables_and_collisions(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.words(empty)).collect() == []
    # rows of one key that don't share a string link nothing; rows that do are counted once for each word
    rows = list(spelling._linked(["abcdef", "xyzxyz", "abcdeg", "aabbcc", "aabbcc"], [5, 5, 5, 0, 1], [1, 2, 3, 4, 4], [5, 50, 7, 9, 9]))
    assert sorted(r[:5] for r in rows) == [("abcdef", None, 1, 7, "abcdeg"), ("abcdeg", None, 1, 5, "abcdef")]


def test_roots_follow_whole_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(21)]
    forms = Scratch(spark, "chain").table(spark.createDataFrame(chain, "word string, form string"), "forms")
    assert {r["root"] for r in spelling.roots(forms, Scratch(spark, "roots")).collect()} == {"w21"}
