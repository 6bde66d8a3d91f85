"""Radix selection against sorting, and the density against the direct sum."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwright.operators import drift, radix, trends
from driftwright.operators import frequency as fq

PROBABILITIES = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
INF = float("inf")


def plain(values, q):
    """Linear between order statistics; infinite ends as ``numbers.between``."""
    v = sorted(values)
    at = q * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    if lo == hi:
        return lo
    if math.isinf(lo) or math.isinf(hi):
        return math.nan if math.isinf(lo) and math.isinf(hi) else lo if lo == -INF else INF
    return lo + (hi - lo) * (at - math.floor(at))


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=50))
def test_bits_are_in_the_order_of_values(values):
    x = np.array(values)
    keys = radix.ordered(x)
    for a, b, p, q in zip(x, x[1:], keys, keys[1:], strict=False):
        assert (p < q) == (a < b) and (p == q) == (a == b)


@pytest.mark.parametrize("held", [1 << 20, 4])
def test_quantiles_equal_sorting(spark, monkeypatch, held):
    monkeypatch.setattr(radix, "HELD", held)
    rng = np.random.default_rng(1)
    wild = np.where(rng.random(500) < 0.34, 0.1, rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500))  # a third are one value
    near = 1.0 + rng.integers(0, 50, 500) * 2.0**-52  # equal in all bits but the last ones
    few = rng.integers(-3, 4, 500).astype(float)
    few[:5] = [INF, -INF, -INF, -0.0, 0.0]
    key = [None if i % 5 == 0 else "ab"[i % 2] for i in range(500)]
    gap = [None if i % 3 == 0 else float(i) for i in range(500)]
    rows = [(k, float(a), float(b), float(c), d, None) for k, a, b, c, d in zip(key, wild, near, few, gap, strict=True)]
    df = spark.createDataFrame(rows, "`k.ey` string, wild double, near double, few double, gap double, none double").repartition(5)
    columns = ["wild", "near", "few", "gap", "none"]
    found = {(r["k.ey"], r["feature"]): r for r in radix.quantiles(df, columns, PROBABILITIES, ["k.ey"]).collect()}
    assert {f for _, f in found} == set(columns[:4])
    for k in (None, "a", "b"):
        for j, c in enumerate(columns[:4], 1):
            own = [r[j] for r in rows if r[0] == k and r[j] is not None]
            got = found[k, c]
            assert got["total"] == len(own)
            for q, v in zip(PROBABILITIES, got["quantiles"], strict=True):
                expected = plain(own, q)
                assert v == pytest.approx(expected, rel=1e-12, nan_ok=True), (k, c, q)
    finite = radix.quantiles(df, ["few"], (0.0, 1.0), only_finite=True).first()
    assert list(finite["quantiles"]) == [-3.0, 3.0] and finite["total"] == 497


def test_digits_and_frequencies_agree(spark):
    df = spark.createDataFrame([(float(i * i % 37), i % 2 == 0) for i in range(300)], "x double, even boolean").where("x <> 3")
    both = [sorted(map(str, fq.quantiles_of(df, ["x"], (0.2, 0.5), ("a", "b"), ["even"], digits=d).select("even", "feature", "total", "a", "b").collect())) for d in (True, False)]
    assert both[0] == both[1]
    for d in (True, False):
        assert fq.quantiles_of(df.limit(0), ["x"], (0.5,), digits=d).collect() == []


def test_what_is_counted_does_not_grow_with_values():
    rng = np.random.default_rng(2)

    def counts(n, step, wanted=None):
        class Known:
            value = wanted

        rows = pa.RecordBatch.from_arrays([pa.array([""] * n), pa.array(rng.random(n))], ["grp", "_0"])
        return sum(b.num_rows for b in radix._digits(1, step, Known)(iter([rows])))

    assert counts(200_000, 0) < 800  # of 200,000 distinct values; 16 bits are the sign, the exponent and four more
    head = {("", 0): radix.ordered(np.array([0.3])) >> np.uint64(48)}
    assert counts(200_000, 1, head) <= 1 << 16


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.integers(1, 39))
def test_counts_do_not_depend_on_batches(values, cut):
    def run(parts):
        out = []
        for b in radix._digits(1, 0, None)(iter([pa.RecordBatch.from_arrays([pa.array(["g"] * len(p)), pa.array(p, pa.float64())], ["grp", "_0"]) for p in parts])):
            out += b.to_pylist()
        return out

    assert run([values]) == run([values[:cut], values[cut:]])


def direct(values, points, margin, span):
    """The kernel density by all values at all points."""
    v = np.asarray(values)
    h = v.std(ddof=1) * len(v) ** -0.2
    low, high = span
    grid = low - margin * (high - low) + np.arange(points) * (high - low) * (1 + 2 * margin) / (points - 1)
    return grid, np.exp(-(((grid[:, None] - v) / h) ** 2) / 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))


def test_density_equals_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    own = {drift.BASELINE: rng.beta(2, 5, 900), "far": np.concatenate((rng.normal(40, 0.01, 300), [-5.0])), "hot": np.where(rng.random(400) < 0.5, 0.25, rng.random(400)), "one": np.array([1.0]), "same": np.full(9, 2.0)}
    rows = [(p, float(v)) for p, values in own.items() for v in values] + [(drift.BASELINE, None), ("far", INF)]
    df = spark.createDataFrame(rows, "population string, score double").repartition(4)
    found = trends.score_density(df, "score", points=101).collect()
    usable = [p for p in own if p not in ("one", "same")]
    span = min(own[p].min() for p in usable), max(own[p].max() for p in usable)
    assert {r["population"] for r in found} == set(usable) and len(found) == 3 * 101
    for p in usable:
        grid, expected = direct(own[p], 101, trends.MARGIN, span)
        got = sorted((r["point"], r["score"], r["density"]) for r in found if r["population"] == p)
        assert np.allclose([g[1] for g in got], grid) and np.allclose([g[2] for g in got], expected, rtol=0, atol=1e-9 * max(1.0, expected.max()))
    assert trends.score_density(df.where(F.lit(False)), "score").collect() == []
