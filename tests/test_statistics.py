"""Statistics on tables small enough to work out by hand or by numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwright import kinds
from driftwright.operators import correlate, describe, distribute, drift, segment, trends
from driftwright.operators import frequency as fq


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_kinds_follow_the_schema(spark):
    df = spark.sql("select 1 as a, 'x' as b, true as c, date'2020-01-01' as d, array(1) as e")
    assert kinds.columns_of(df, kinds.NUMERIC) == ["a"]
    assert kinds.columns_of(df, kinds.CATEGORICAL) == ["b", "c"]
    assert kinds.columns_of(df, kinds.OTHER) == ["d", "e"]


def test_duplicate_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="duplicate"):
        kinds.unique_columns(spark.sql("select 1 as a, 2 as a"))


def test_describe_by_hand(spark):
    df = numbers(spark, [0, 1, 1, 4, None, float("nan")])
    row = describe.describe(df).first()
    assert (row["n_unique"], row["n_missing"], row["n_zeros"], row["mode"]) == (3, 2, 1, 1.0)
    assert (row["perc_missing"], row["min"], row["q50"], row["max"]) == (33.333, 0.0, 1.0, 4.0)


def test_nulls_are_the_mode_only_if_strictly_more_frequent(spark):
    assert describe.describe(numbers(spark, [2, 2, None, None])).first()["mode"] == 2.0
    row = describe.describe(numbers(spark, [2, 3, None, None])).first()
    assert row["mode"] is None and row["perc_mode"] == 50.0


def test_equal_modes_go_to_the_least(spark):
    assert describe.describe(numbers(spark, [5, 5, 3, 3, 9])).first()["mode"] == 3.0


def test_large_integers_stay_apart(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 2,)], "x long")
    assert describe.describe(df).first()["n_unique"] == 3


def test_infinite_quantiles(spark):
    inf = float("inf")
    row = fq.quantiles(fq.frequencies(fq.long_numbers(numbers(spark, [-inf, inf]), ["x"])), ["feature"], (0.0, 0.5, 1.0)).first()
    assert row["quantiles"][0] == -inf and math.isnan(row["quantiles"][1]) and row["quantiles"][2] == inf


@pytest.mark.parametrize("ranges", [1, 5])
def test_quantiles_equal_numpy(spark, ranges):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=500), 2)
    q = [0, 0.01, 0.25, 0.5, 0.9, 1]
    found = fq.quantiles(fq.frequencies(fq.long_numbers(numbers(spark, values), ["x"])), ["feature"], q, ranges=ranges).first()["quantiles"]
    assert np.allclose(found, np.quantile(values, q))


def test_missing_counts_are_filtered_or_not(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), "a")], "x double, y string")
    rows = {r["feature"]: r for r in describe.missing_counts(df).collect()}
    assert rows["x"]["number_of_missing"] == 2 and rows["y"]["percentage_of_missing"] == 66.6667
    assert describe.missing_counts(df.select(F.lit(1).alias("z"))).count() == 0
    assert describe.missing_counts(df.select(F.lit(1).alias("z")), only_missing=False).count() == 1


def test_empty_table(spark):
    df = numbers(spark, []).withColumn("y", F.lit("a"))
    row = describe.describe(df).first()
    assert row["n_unique"] == 0 and row["q50"] is None and row["perc_missing"] == 0.0
    assert describe.describe_discrete(df).first()["n_unique"] == 0
    (only,) = distribute.histogram(df, labels=True).collect()  # an empty column has one bin that says so
    assert only["bin_label"] == "no data" and only["count"] == 0 and distribute.category_counts(df).count() == 0


def pairs_frame(spark, seed=3, n=200, gaps=True):
    rng = np.random.default_rng(seed)
    x, y = np.round(rng.normal(size=n), 1), np.round(rng.normal(size=n), 1)
    z = np.round(x + rng.normal(size=n) / 2, 1)
    rows = [(float(a), None if gaps and i % 7 == 0 else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))]
    return rows, spark.createDataFrame(rows, "x double, y double, z double")


def test_pearson_equals_numpy(spark):
    rows, df = pairs_frame(spark)
    for r in correlate.pearson(df).collect():
        a, b = (np.array([row["xyz".index(r[f"feature_{k}"])] for row in rows if None not in row or "y" not in (r["feature_1"], r["feature_2"])], float) for k in (1, 2))
        assert math.isclose(r["r"], np.corrcoef(a, b)[0, 1], abs_tol=1e-9)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, y double")
    for m in correlate.METHODS:
        assert correlate.correlate(df, m).first()["r"] is None


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_spearman_equals_ranks_of_complete_rows(spark):
    rows, df = pairs_frame(spark)
    found = {(r["feature_1"], r["feature_2"]): r["r"] for r in correlate.spearman(df).collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        own = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        assert math.isclose(found["xyz"[i], "xyz"[j]], np.corrcoef(ranks([a for a, _ in own]), ranks([b for _, b in own]))[0, 1], abs_tol=1e-9)


def tau(own):
    s = sum(np.sign(a - c) * np.sign(b - d) for k, (a, b) in enumerate(own) for c, d in own[:k])
    n0 = len(own) * (len(own) - 1) / 2
    ties = [sum(c * (c - 1) / 2 for c in np.unique([p[k] for p in own], return_counts=True)[1]) for k in (0, 1)]
    return s / math.sqrt((n0 - ties[0]) * (n0 - ties[1]))


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_kendall_equals_all_pairs_for_any_blocks(spark, blocks):
    rows, df = pairs_frame(spark, n=80)
    for r in correlate.kendall(df, blocks=blocks).collect():
        i, j = "xyz".index(r["feature_1"]), "xyz".index(r["feature_2"])
        own = [(row[i], row[j]) for row in rows if row[i] is not None and row[j] is not None]
        assert math.isclose(r["r"], tau(own), abs_tol=1e-9)


def test_kendall_of_hot_values_in_blocks(spark, monkeypatch):
    r = random.Random(12)
    rows = [(7.0 if r.random() < 0.5 else float(r.randrange(30)), 3.0 if r.random() < 0.4 else float(r.randrange(40))) for _ in range(150)]
    monkeypatch.setattr(correlate, "ONE_GROUP", 100)
    df = spark.createDataFrame(rows, "x double, y double")
    for own in (df, df.where("x = 7").union(df.where("x <> 7 and y = 3"))):
        have = [tuple(row) for row in own.collect()]
        found = [correlate.kendall(own, blocks=b).first()["r"] for b in (None, 2)]
        assert all(math.isclose(f, tau(have), abs_tol=1e-9) for f in found), (found, tau(have))


def test_top_pairs_are_strict_and_defined(spark):
    pairs = spark.createDataFrame([("a", "b", 0, 1, 0.65), ("a", "c", 0, 2, -0.9), ("b", "c", 1, 2, None)], "feature_1 string, feature_2 string, position_1 int, position_2 int, r double")
    assert [(r["feature_1"], r["feature_2"]) for r in correlate.top_pairs(pairs, 0.65).collect()] == [("a", "c")]
    with pytest.raises(ValueError):
        correlate.top_pairs(pairs, 1.5)


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="unknown"):
        correlate.correlate(numbers(spark, [1, 2]), "cosine")


def test_equal_width_bins_equal_numpy(spark):
    values = np.round(np.random.default_rng(5).normal(size=300), 3)
    rows = sorted(distribute.histogram(numbers(spark, values), n_bins=7).collect(), key=lambda r: r["bin"])
    pad = 0.001 * (values.max() - values.min())
    counts, edges = np.histogram(values, bins=7, range=(values.min() - pad, values.max() + pad))
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r["bin_lower"] for r in rows] + [rows[-1]["bin_upper"]], edges)


def test_constant_column_is_one_filled_bin(spark):
    rows = distribute.histogram(numbers(spark, [4, 4, 4]), n_bins=4).collect()
    assert sum(r["count"] for r in rows) == 3 and max(r["count"] for r in rows) == 3


def test_few_values_are_bins_of_their_own_in_quantile_mode_alone(spark):
    df = numbers(spark, [1, 1, 2, 5])
    own = sorted(distribute.histogram(df, binning="quantile", n_bins=3).collect(), key=lambda r: r["bin"])
    assert [(r["bin_lower"], r["bin_upper"], r["count"]) for r in own] == [(0.5, 1.5, 2), (1.5, 4.5, 1), (4.5, 5.5, 1)]
    assert distribute.histogram(df, n_bins=3).count() == 3


def test_infinite_values_go_to_the_outer_bins(spark):
    inf = float("inf")
    rows = sorted(distribute.histogram(numbers(spark, [-inf, 0, 1, 2, inf, inf, None]), n_bins=2).collect(), key=lambda r: r["bin"])
    assert [r["count"] for r in rows] == [2, 4] and rows[0]["n_non_finite"] == 3 and rows[0]["n_missing"] == 1


def test_labels(spark):
    rows = distribute.labelled(distribute.histogram(numbers(spark, [0, 10]), n_bins=2)).orderBy("bin").collect()
    assert rows[0]["bin_label"] == "[-0.01, 5]" and rows[1]["bin_label"].startswith("(5, ")


def test_rare_categories_fold(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbcd"], "v string")
    rows = sorted(distribute.category_counts(df, max_categories=2).collect(), key=lambda r: r["bin"])
    assert [(r["bin_label"], r["count"]) for r in rows] == [("a", 3), ("b", 2), ("Other (2 categories)", 2)]


def test_exact_outliers_and_their_thinned_points(spark):
    df = numbers(spark, [0.0] * 1000 + list(range(100, 200)))
    row = distribute.box_summary(df).first()
    assert (row["n_outliers"], row["n_outliers_low"], row["upper_fence"]) == (100, 0, 0.0)
    points = [r["value"] for r in distribute.outlier_points(df, max_points=7).orderBy("place").collect()]
    assert points == [100.0 + math.floor(k * 99 / 6) for k in range(7)]


def test_boxes_of_infinite_values(spark):
    inf = float("inf")
    row = distribute.box_summary(numbers(spark, [inf, -inf])).first()
    assert row["q1"] is None and (row["n_outliers_low"], row["n_outliers_high"], row["min"], row["max"]) == (1, 1, -inf, inf)


def test_segments(spark):
    df = numbers(spark, [1, 2, 3, 10, None])
    assert segment.make_grouping(df, "x", n_bins=2).edges == (0.991, 5.5, 10.0)
    sizes = {r["segment"]: r["n_rows"] for r in segment.make_grouping(df, "x", bins=[(0, 2), (5, 10)]).sizes().collect()}
    assert sizes == {"(0, 2]": 2, "(5, 10]": 1, None: 2}
    assert segment.make_grouping(numbers(spark, [1, 1, 1]), "x", n_quantiles=4).assigned.count() == 0
    assert segment.make_grouping(df).sizes().first()["segment"] == "All"
    with pytest.raises(ValueError, match="overlap"):
        segment.make_grouping(df, "x", bins=[(0, 2), (1, 3)])
    with pytest.raises(TypeError):
        segment.make_grouping(df, "x", n_bins=True)
    with pytest.raises(ValueError):
        segment.make_grouping(df, "x", n_bins=2, n_quantiles=2)


def drift_frame(spark, base, later, name="v", kind="double"):
    return spark.createDataFrame([(drift.BASELINE, v) for v in base] + [("later", v) for v in later], f"population string, {name} {kind}")


def test_a_population_against_itself_has_no_drift(spark):
    values = [float(v) for v in np.random.default_rng(0).normal(size=100)]
    found = drift.distances(drift_frame(spark, values, values), ["v"], ["psi", "ks", "ws", "cm"])
    assert {r["value"] for r in found.collect()} == {0.0}


def test_constant_and_disjoint_psi_are_finite_and_positive(spark):
    assert drift.psi(drift_frame(spark, [1.0] * 3, [2.0] * 3), ["v"], ["later"]).first()["value"] > 1
    assert drift.psi(drift_frame(spark, ["A", "A"], ["B", "B"], kind="string"), ["v"], ["later"]).first()["value"] > 1


def test_cdf_distances_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=70), 1), np.round(rng.normal(0.5, 2, size=50), 1)
    for ranges in (1, 4):
        row = drift.cdf_distances(drift_frame(spark, a.tolist(), b.tolist()), ["v"], ["later"], ranges=ranges).first()
        u = np.unique(np.concatenate((a, b)))
        fa, fb = (np.searchsorted(np.sort(s), u, "right") / len(s) for s in (a, b))
        gap, width = np.abs(fa - fb), np.append(np.diff(u), 0)
        assert np.allclose([row["ks"], row["wasserstein"], row["energy"]], [gap.max(), (gap * width).sum(), math.sqrt(2 * (gap**2 * width).sum())])


def test_empty_snapshot_and_wrong_kind_are_noted(spark):
    df = drift_frame(spark, [1.0, 2.0], [None])
    assert {(r["method"], r["value"], r["note"]) for r in drift.distances(df, ["v"], ["psi", "chi2"]).collect()} == {("psi", None, "a population has no usable value"), ("chi_square", None, "chi-square needs a categorical feature")}


def test_chi_square_by_hand_and_of_one_level(spark):
    df = drift_frame(spark, list("aab"), list("abb"), kind="string")
    assert math.isclose(drift.chi_square(df, ["v"], ["later"]).first()["value"], 2 / 3, abs_tol=1e-12)
    assert drift.chi_square(drift_frame(spark, ["a"], ["a"], kind="string"), ["v"], ["later"]).first()["value"] == 0.0


def test_severity_on_the_thresholds(spark):
    df = spark.createDataFrame([(0.0999,), (0.10,), (0.25,), (None,)], "v double")
    assert [r[0] for r in df.select(drift.severity(F.col("v"))).collect()] == ["stable", "moderate", "substantial", None]
    assert spark.range(1).select(drift.severity(F.lit(0.05), 0.1, 0.05, higher_is_worse=False)).first()[0] == "substantial"


def test_bad_names():
    with pytest.raises(ValueError):
        drift.bucket_type("thirds")
    assert drift.bucket_type("Equal-Width") == "bins"


def test_score_tables(spark):
    rng = np.random.default_rng(4)
    df = drift_frame(spark, rng.beta(2, 5, 400).tolist(), rng.beta(4, 5, 400).tolist(), "score")
    bands = trends.score_bands(df, "score", ["later"]).groupBy("population").agg(F.round(F.sum("share"), 1).alias("s")).collect()
    assert {r["s"] for r in bands} == {100.0}
    rows = {r["population"]: r for r in trends.score_summary(df, "score", ["later"]).collect()}
    assert rows[drift.BASELINE]["psi_vs_baseline"] == 0 and rows["later"]["psi_vs_baseline"] > 0.25
    assert trends.score_verdict(trends.score_summary(df, "score", ["later"])).first()["severity"] == "substantial"


def test_density_equals_numpy(spark):
    values = [1.0, 2.0, 2.0, 5.0, 7.0]
    rows = trends.score_density(drift_frame(spark, values, [3.0, 3.0], "score"), "score", points=16).orderBy("point").collect()
    h = np.std(values, ddof=1) * len(values) ** -0.2
    for r in rows:
        expected = np.exp(-(((r["score"] - np.array(values)) / h) ** 2) / 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert math.isclose(r["density"], expected, rel_tol=1e-9)
    assert {r["population"] for r in rows} == {drift.BASELINE}  # a constant score has no density


def test_diagonals_of_constant_columns(spark):
    pairs = correlate.pearson(spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, 1.0, 5.0)], "x double, y double, z double"))
    plain = {r["feature"]: r for r in correlate.matrix(pairs).collect()}
    assert plain["x"]["x"] == plain["x"]["z"] == 1.0 and plain["y"]["y"] is None
    assert {r["feature"]: r["y"] for r in correlate.matrix(pairs, constant_diagonal=True).collect()}["y"] == 1.0


def test_types_can_be_reported_as_they_were(spark):
    assert describe.describe(numbers(spark, [1]), type_labels={"x": "bigint"}).first()["data_type"] == "bigint"


def test_formatted_numbers(spark):
    assert describe.formatted(numbers(spark, [12345.678]), {"x": 1}).first()["x"] == "12,345.7"


def test_levels_beyond_the_driver_are_tables(spark):
    from driftwright.plans.assessment import DriftAssessment

    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    a = DriftAssessment(df, ["k", "v"], reference=df)
    assert sorted(r["value"] for r in a.levels().collect()) == ["a", "b"] and a.snapshots == ["Current data"]
    assert a.complete()["descriptives"].count() == 6
