"""Quality: statistics and trees against plain loops, held-out accuracy, odd rows."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwright.llm import queries, quality
from driftwright.llm.common import held_out, learnable

from .. import sqlcheck

TEXTS = [
    "", "One two, three. Four two!", "THE SIGN!! THE SIGN!! END", "a | b | c", "word word word word other\n\nshort\nshort", "Straße ÉTÉ x9 × *** done$$$ it's", "\n", "漢字 \U0001f600 ok",
    "no stop " * 400, "x" * 5000,
]


def plain(text):
    """Some of the statistics, by loops over characters and words."""
    words, word = [], ""
    for c in text + " ":
        if c.isalnum():
            word += c
        elif word:
            words, word = [*words, word], ""
    low = [w.lower() for w in words]
    lines = [x for x in text.lower().split("\n") if x]
    triples = [tuple(low[i : i + 3]) for i in range(max(1, len(low) - 2))] if low else []
    run = best = 0
    for i, w in enumerate(low):
        run = run + 1 if i and low[i - 1] == w else 1
        best = max(best, run)
    share = lambda a, b: a / max(b, 1)
    return {
        "characters": math.log1p(len(text)), "words": math.log1p(len(words)), "word length": share(sum(map(len, words)), len(words)), "longest word": math.log1p(max(map(len, words), default=0)),
        "letters": share(sum(c.isalpha() for c in text), len(text)), "line breaks": share(text.count("\n"), len(text)), "sign runs": share(sum(a == b and not a.isalnum() and a not in " \t\n\r" for a, b in zip(text, text[1:], strict=False)), len(text)),
        "capital words": share(sum(len(w) > 1 and w.isalpha() and w.isupper() for w in words), len(words)), "equal neighbours": share(sum(a == b for a, b in zip(low, low[1:], strict=False)), len(low)), "longest run of a word": math.log1p(best),
        "distinct words": share(len(set(low)), len(low)), "distinct triples": share(len(set(triples)), len(triples)), "repeated lines": 1 - share(len(set(lines)), len(lines)), "short lines": share(sum(len(x) < 20 for x in lines), len(lines)),
    }


def test_statistics_equal_plain_loops():
    got = quality.statistics(TEXTS)
    assert got.shape == (len(TEXTS), len(quality.STATISTICS)) and np.isfinite(got).all()
    for row, text in zip(got, TEXTS, strict=True):
        for name, value in plain(text).items():
            assert row[quality.STATISTICS.index(name)] == pytest.approx(value, abs=1e-9), (name, text[:20])
    alone = np.concatenate([quality.statistics([t]) for t in TEXTS])
    assert np.allclose(got, alone, atol=1e-12)  # a text's neighbours don't matter


def test_flat_trees_equal_a_walk_and_learn():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(3000, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    walked = []
    for row in x[:200]:
        m = model.start
        for statistic, cut, leaf in zip(model.statistic, model.cut, model.leaf, strict=True):
            i = 0
            while i < len(cut):
                i = 2 * i + 1 + (row[statistic[i]] > cut[i])
            m += leaf[i - len(cut)]
        walked.append(m)
    assert np.allclose(model.margins(x[:200]), walked)
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.98


def test_first_tree_takes_the_best_cut():
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=(400, 3)), 1), rng.integers(0, 2, 400).astype(float)
    model = quality.fit(x, y, trees=1, depth=1, rate=1.0, bins=512)
    g, h = y.mean() - y, np.full(400, y.mean() * (1 - y.mean()))
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {(j, c): value(x[:, j] <= c) + value(x[:, j] > c) for j in range(3) for c in np.unique(x[:, j]) if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 2}
    assert gains[int(model.statistic[0, 0]), model.cut[0, 0]] == pytest.approx(max(gains.values()))


def labelled(spark, n=400):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(n):
        good = i % 3 > 0
        words = [word() for _ in range(r.randint(20, 200))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + r.choice(["***", "$$$"]) for w in words), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_rows(spark):
    df = labelled(spark)
    model = quality.train(df, df.where(learnable("doc_id", 1, 3)))
    out = quality.score(df.withColumn("score", F.lit("old")), model).where(held_out("doc_id", 1, 3)).collect()
    assert len(out) > 80 and all(r["predicted"] == r["quality"] and 0 <= r["score"] <= 1 for r in out)
    again = quality.train(df.repartition(7), df.where(learnable("doc_id", 1, 3)).repartition(3))
    assert (again.cut == model.cut).all() and (again.leaf == model.leaf).all()  # partitions don't matter


def test_odd_rows(spark):
    df = labelled(spark, 90)
    odd = spark.createDataFrame([(None, "text", 1), (1000, None, None), (1001, "", 0), (1001, "", 1), (1002, "w " * 200_000, 1)], df.schema)
    model = quality.train(df.union(odd), df.union(odd).select("doc_id", "quality"))
    out = quality.score(df.union(odd).withColumn("x.y", F.lit(1)), model)
    rows = {(r["doc_id"], r["text"] is None): r["score"] for r in out.where("doc_id is null or doc_id >= 1000").collect()}
    assert len(rows) == 4 and all(0 <= s <= 1 for s in rows.values()) and rows[1000, True] == rows[1001, False] and "x.y" in out.columns
    assert quality.score(df.limit(0), model).count() == 0
    none = quality.train(df.limit(0), df.limit(0))
    assert quality.score(df.limit(1), none).first()["score"] == 0.5
    assert quality.score(df.limit(1), quality.train(df, df.where("quality = 1"))).first()["predicted"] == 1


@pytest.mark.skipif(not os.path.isdir(sqlcheck.SF), reason="the test tables aren't here")
def test_query_on_the_test_table(spark):
    sf = sqlcheck.SF.replace("0.001", "0.01")
    rows = queries.op13_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97
