"""Vector codes against a plain search of all entries."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwright.llm import veccode

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds):
    """The contract, by loops."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p in range(parts):
                own[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(c) for c in zip(*own[p][k], strict=True)] if own[p][k] else e for k, e in enumerate(b)] for p, b in enumerate(books)]
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), label) for i, v, label in kept]
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, sums[label]) for i, c, e, label in out), sha


def found(spark, rows, parts=4, entries=6, rounds=2):
    df = spark.createDataFrame(rows, SCHEMA)
    books = veccode.train(df, parts=parts, entries=entries, rounds=rounds)
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in veccode.encode(df, books).collect()), veccode.digest(books)


def test_codes_equal_plain_loops(spark):
    rng = np.random.default_rng(1)
    # coarse values make many equal distances; a third of the rows is one vector
    rows = [(i, [0.5] * 8 if i % 3 == 0 else (rng.integers(-3, 4, 8) / 128).tolist(), [None, 1, 2][i % 3]) for i in range(200)]
    rows += [(300, None, 1), (301, [None] + [0.0] * 7, 1), (302, [math.inf] + [0.0] * 7, 1), (303, [math.nan] * 8, None)]
    assert found(spark, rows) == plain(rows, 4, 6, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=90), st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=40))
def test_trees_find_the_first_of_the_nearest(entries, queries):
    books, x = np.array([entries, entries[::-1]]), np.array(queries)
    forest = veccode.Forest.of(books)
    for part in (0, 1):
        index, far = forest.nearest(x, np.full(len(x), part))
        all_ = ((books[part][None] - x[:, None]) ** 2).sum(2)
        assert (index == all_.argmin(1)).all() and (far == all_.min(1)).all()


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    books = veccode.train(empty)
    assert veccode.encode(empty, books).collect() == [] and veccode.digest(books) == hashlib.sha256(b"").hexdigest()
    none = spark.createDataFrame([(1, None, 1), (2, [None, 1.0], None)], SCHEMA)
    assert veccode.encode(none, veccode.train(none, parts=2)).collect() == []
    # fewer vectors than entries, repeated rows, another dimension, a huge component, a null id
    rows = [(1, [0.1, 0.2], 1), (1, [0.1, 0.2], 1), (2, [0.1], 1), (3, [1e9, 0.0], 2), (None, [0.3, 0.2], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in veccode.encode(df, veccode.train(df, parts=2)).collect()}
    # the first round moves entry 0 between all parts, so that the equal entry 1 is nearer to the repeated row
    assert got == {(1, "0100", 0, 0), (2, None, None, 0), (3, None, None, None), (None, "0000", 0, 0)}
    with pytest.raises(ValueError, match="equal parts"):
        veccode.train(spark.createDataFrame([(1, [0.1] * 3, 1)], SCHEMA), parts=2)


def test_names_with_dots_and_clashes(spark):
    df = spark.createDataFrame([(i, [i / 10, 0.5], 1, "x") for i in range(5)], "`v.id` long, `e.m` array<float>, `l.b` int, code string")
    books = veccode.train(df, id_="v.id", vector="e.m", parts=2)
    out = veccode.encode(df, books, id_="v.id", vector="e.m", label="l.b")
    assert out.columns == ["v.id", "label", "code", "error", "label_error"] and out.count() == 5
