"""Moments of many columns, positional ranks and split concordance against plain computations."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwright.operators import correlate, moments, ranks
from driftwright.scratch import Scratch


def plain_r(x, y):
    own = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[own], y[own]
    if len(x) < 2 or (x == x[0]).all() or (y == y[0]).all() or np.isinf(x).any() or np.isinf(y).any():
        return None
    x, y = x - x.mean(), y - y.mean()
    return float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y))


def table(spark, values, partitions):
    names = [f"c{i}" for i in range(values.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in values]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(partitions), names


def same(found, values):
    got = {(r["position_1"], r["position_2"]): r["r"] for r in found}
    k = values.shape[1]
    assert set(got) == {(i, j) for i in range(k) for j in range(i + 1, k)}
    for (i, j), r in got.items():
        expected = plain_r(values[:, i], values[:, j])
        assert (r is None) == (expected is None) and (r is None or math.isclose(r, expected, abs_tol=1e-9)), (i, j, r, expected)


def test_wide_moments_equal_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(moments, "FAN_IN", 2)  # several levels of merges
    rng = np.random.default_rng(1)
    values = rng.normal(size=(400, 150))
    values[:, 1:] += 0.5 * values[:, :1]
    values[rng.random(values.shape) < 0.2] = np.nan
    values[:, 3] = 7.0  # constant
    values[:, 4] = np.where(np.isnan(values[:, 5]), values[:, 4], 0.1)  # constant where c5 is present
    values[:, 6] += 1e9  # far from zero
    values[5, 8] = np.inf
    values[:, 9] = np.nan  # empty
    df, names = table(spark, values, 7)
    assert len(names) > moments.TILE
    same(moments.pearson(df, names).collect(), values)


def test_wide_and_narrow_plans_agree_by_group(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=(300, 5)), 1)
    values[rng.random(values.shape) < 0.1] = np.nan
    df, names = table(spark, values, 3)
    df = df.withColumn("k.ey", F.when(F.col("c0") > 0, "a").when(F.col("c0") > -1, None).otherwise("b"))
    get = lambda rows: sorted(((r["k.ey"] or "", r["position_1"], r["position_2"], None if r["r"] is None else round(r["r"], 9)) for r in rows))
    narrow = correlate.pearson(df.withColumnRenamed("k.ey", "key"), names, ["key"]).withColumnRenamed("key", "k.ey").collect()
    monkeypatch.setattr(moments, "HELD", 1)  # blocks of groups are sent on again and again
    assert get(moments.pearson(df, names, ["k.ey"]).collect()) == get(narrow)
    assert moments.pearson(df.limit(0), names).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([math.nan, 0.0, 1.0, 1e6 + 1, 1e6 + 2]), st.sampled_from([math.nan, -1.0, 0.1, 0.3])), min_size=2, max_size=40), st.integers(1, 39))
def test_merged_blocks_are_the_block_of_all(rows, cut):
    x, y = (np.array([[r[i]] for r in rows]) for i in (0, 1))
    parts = [moments.batch(x[a:b], y[a:b])[:, 0, 0] for a, b in ((0, cut), (cut, len(x))) if len(x[a:b])]
    whole = moments.merged(*(p.reshape(8, 1) for p in parts))[:, 0] if len(parts) > 1 else parts[0]
    own = ~np.isnan(x[:, 0]) & ~np.isnan(y[:, 0])
    u, v = x[own, 0], y[own, 0]
    assert whole[0] == len(u)
    if len(u):
        got = (whole[1] + whole[2], whole[3] + whole[4], *whole[5:])
        assert np.allclose(got, (u.mean(), v.mean(), ((u - u.mean()) ** 2).sum(), ((v - v.mean()) ** 2).sum(), ((u - u.mean()) * (v - v.mean())).sum()), rtol=1e-9, atol=1e-6)
        assert (whole[5] == 0) == (u == u[0]).all() and (whole[6] == 0) == (v == v[0]).all()


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_positional_ranks_equal_plain_ranks(spark, partitions):
    r = random.Random(4)
    rows, pos = [], 0
    for grp in ("", "{}"):
        for g in (0, 1):
            for _ in range(120):
                # a third of the cells are one value, so that it lies in many partitions
                rows.append((pos, grp, g, 5.0 if r.random() < 0.34 else float(r.randrange(-3, 20)) or -0.0))
                pos += 1
    df = spark.createDataFrame(rows, "pos long, grp string, g int, value double").repartition(5)
    found = {x["pos"]: x["rank"] for x in ranks.average(df, Scratch(spark, "ranks"), partitions=partitions).collect()}
    for pos, grp, g, value in rows:
        own = [v for _, a, b, v in rows if (a, b) == (grp, g)]
        assert found[pos] == sum(v < value for v in own) + (sum(v == value for v in own) + 1) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.integers(1, 7))
def test_runs_do_not_depend_on_batches(values, size):
    cells = sorted((v // 3, float(v)) for v in values)
    columns = [pa.array(range(len(cells))), pa.array([""] * len(cells)), pa.array([g for g, _ in cells], pa.int32()), pa.array([v for _, v in cells])]
    whole = pa.RecordBatch.from_arrays(columns, ["pos", "grp", "g", "value"])

    class Task:
        partitionId = staticmethod(lambda: 3)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ranks.TaskContext, "get", lambda: Task)
        rows = [row for b in ranks.numbered(iter([whole.slice(i, size) for i in range(0, len(cells), size)])) for row in b.to_pylist()]
    assert [r["pos"] for r in rows] == list(range(len(cells)))
    for r in rows:
        assert r["run"] == cells.count((r["g"], r["value"])) and r["before"] == sum(g == r["g"] and v < r["value"] for g, v in cells)
        assert r["edge"] == ((r["g"], r["value"]) == cells[0]) + 2 * ((r["g"], r["value"]) == cells[-1])


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_spearman_by_position_or_by_broadcast_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(correlate, "BROADCAST_VALUES", few)
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=(240, 3)), 1)
    values[:, 2] = np.where(rng.random(240) < 0.34, 1.0, values[:, 0] + values[:, 2])
    df, names = table(spark, values, 4)
    key = np.where(values[:, 0] > 0, "x", None)
    df = df.withColumn("key", F.when(F.col("c0") > 0, F.lit("x")))

    def rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for own, keys in ((values, ()), (values, ("key",))):
        found = correlate.spearman(df, names, keys).collect()
        for k in (None, "x") if keys else (None,):
            part = own[np.array([x == k for x in key])] if keys else own
            same([r for r in found if not keys or r["key"] == k], np.stack([rank(part[:, i]) for i in range(3)], axis=1))


def test_spearman_of_few_values_sorts_no_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "average", lambda *_, **__: pytest.fail("cells were sorted"))
    rng = np.random.default_rng(6)
    values = np.stack([rng.integers(0, 7, 300), rng.integers(-3, 3, 300), rng.integers(0, 2, 300)], axis=1).astype(float)
    values[:, 1] += values[:, 0]
    values[rng.random(values.shape) < 0.2] = np.nan
    values[5, 1], values[7, 1] = np.inf, -0.0
    whole = np.concatenate((values, np.full((300, 1), np.nan), np.full((300, 1), 4.0)), axis=1)  # one without values, one constant
    df, names = table(spark, whole, 4)
    df = df.withColumn("key", F.when(F.col("c0") > 3, F.lit("x")).when(F.col("c0").isNull(), F.lit("none")))  # "none": c0 has no complete rows

    def expected(v, w):
        own = ~np.isnan(v) & ~np.isnan(w)
        rank = lambda u: np.array([(u < x).sum() + ((u == x).sum() + 1) / 2 for x in u])
        return plain_r(rank(v[own]), rank(w[own]))

    for keys in ((), ("key",)):
        found = correlate.spearman(df, names, keys).collect()
        for k in ("x", "none", None) if keys else (None,):
            rows = whole[{"x": whole[:, 0] > 3, "none": np.isnan(whole[:, 0]), None: whole[:, 0] <= 3}[k]] if keys else whole
            got = {(r["position_1"], r["position_2"]): r["r"] for r in found if not keys or r["key"] == k}
            assert len(got) == 10
            for (i, j), r in got.items():
                e = expected(rows[:, i], rows[:, j])
                assert (r is None) == (e is None) and (r is None or math.isclose(r, e, abs_tol=1e-9)), (k, i, j, r, e)


def tau(x, y):
    s = sum(np.sign(a - c) * np.sign(b - d) for k, (a, b) in enumerate(zip(x, y, strict=True)) for c, d in zip(x[:k], y[:k], strict=True))
    n0 = len(x) * (len(x) - 1) / 2
    ties = [sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1]) for v in (x, y)]
    return s / math.sqrt((n0 - ties[0]) * (n0 - ties[1]))


def test_kendall_splits_until_groups_are_small(spark, monkeypatch):
    monkeypatch.setattr(correlate, "ONE_GROUP", 30)
    biggest = []
    plain = correlate._split
    monkeypatch.setattr(correlate, "_split", lambda *a: biggest.append(plain(*a)) or biggest[-1])
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=260), 2)
    y = np.where(rng.random(260) < 0.34, 0.5, np.round(x + rng.normal(size=260), 2))  # a third of the rows are one value
    x[rng.random(260) < 0.34] = -1.0
    df, _ = table(spark, np.stack([x, y], axis=1), 4)
    df = df.withColumn("key", F.when(F.col("c0") > 0, F.lit("x")))
    assert math.isclose(correlate.kendall(df).first()["r"], tau(x, y), abs_tol=1e-9)
    sizes = [r["count"] for r in biggest[0].groupBy("gid", "path").count().collect()]
    assert max(sizes) <= 30 and len(sizes) > 20
    by = {r["key"]: r["r"] for r in correlate.kendall(df, keys=["key"]).collect()}
    for k, own in (("x", x > 0), (None, x <= 0)):
        assert math.isclose(by[k], tau(x[own], y[own]), abs_tol=1e-9)
