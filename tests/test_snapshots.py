"""Distances of many snapshots in one plan, against plain computations."""

import numpy as np
import pytest

from driftwright.operators import drift


def steps(base, own):
    """KS, Wasserstein and energy distance, by the step functions."""
    at = np.unique(np.concatenate((base, own)))
    gap = np.abs(np.searchsorted(np.sort(base), at, "right") / len(base) - np.searchsorted(np.sort(own), at, "right") / len(own))
    width = np.append(np.diff(at), 0.0)
    return gap.max(), (gap * width).sum(), np.sqrt(2 * (gap * gap * width).sum())


def chi(base, own):
    levels = sorted(set(base) | set(own))
    if len(levels) == 1:
        return 0.0
    table = np.array([[list(x).count(v) for v in levels] for x in (base, own)], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    return ((table - expected) ** 2 / expected).sum()


@pytest.mark.parametrize("ranges", [None, 3])
def test_a_thousand_snapshots_have_a_plan_of_fixed_width(spark, ranges):
    rng = np.random.default_rng(1)
    names = [f"day {i:04d}" for i in range(1000)]
    base = np.round(rng.normal(size=60), 1)
    own = {n: np.round(rng.normal(i / 500, 1, 3), 1) for i, n in enumerate(names)}
    rows = [(drift.BASELINE, float(v), "abc"[int(v * 10) % 3]) for v in base] + [(n, float(v), "abcd"[int(v * 10) % 4]) for n, values in own.items() for v in values]
    rows += [("not asked for", 99.0, "z"), (names[0], None, None)]
    df = spark.createDataFrame(rows, "population string, v double, level string")
    found = drift.cdf_distances(df, ["v"], names, ranges=ranges)
    assert len(found.columns) == 7
    got = {r["snapshot"]: r for r in found.collect()}
    assert set(got) == set(names)
    for n in names[::50] + names[-1:]:
        assert (got[n]["n_baseline"], got[n]["n"]) == (60, 3)
        assert np.allclose((got[n]["ks"], got[n]["wasserstein"], got[n]["energy"]), steps(base, own[n]))
    if ranges is None:
        text = {p: [x for q, _, x in rows if q == p and x] for p in (drift.BASELINE, *names)}
        chis = {r["snapshot"]: r["value"] for r in drift.chi_square(df, ["level"], names).collect()}
        psis = {r["snapshot"]: r["value"] for r in drift.psi(df, ["level"], names).collect()}
        for n in names[::50]:
            assert np.isclose(chis[n], chi(text[drift.BASELINE], text[n]))
            share = lambda p, x: max(text[p].count(x) / len(text[p]), drift.EPSILON)  # noqa: E731, B023
            levels = set(text[drift.BASELINE]) | set(text[n])
            assert np.isclose(psis[n], sum((share(n, x) - share(drift.BASELINE, x)) * np.log(share(n, x) / share(drift.BASELINE, x)) for x in levels))


def test_populations_without_values(spark):
    rows = [(drift.BASELINE, 1.0, "a"), (drift.BASELINE, 2.0, "b"), ("empty", None, None), ("full", 1.0, "a")]
    df = spark.createDataFrame(rows, "population string, v double, level string")
    got = {r["snapshot"]: r for r in drift.cdf_distances(df, ["v"], ["empty", "full"]).collect()}
    assert got["empty"]["ks"] is None and got["empty"]["n"] == 0 and got["full"]["ks"] == 0.5
    assert {r["snapshot"]: r["value"] for r in drift.chi_square(df, ["level"], ["empty", "full"]).collect()}["empty"] is None
    table = drift.psi_table(df, ["v", "level"], ["empty", "full"], n_buckets=4).collect()
    assert {(r["snapshot"], r["bin"]) for r in table if r["kind"] == "numeric"} == {(s, b) for s in ("empty", "full") for b in range(4)}
    assert all(r["psi"] is None for r in table if r["snapshot"] == "empty")
