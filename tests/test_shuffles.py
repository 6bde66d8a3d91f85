"""Cells of a feature meet limits, edges and totals in the tasks that have them, not in one task by a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from driftwright.operators import distribute, drift
from driftwright.operators import frequency as fq


@pytest.fixture
def measured(spark):
    """Nothing but tables of less than 32 kB is broadcast without being told."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 32 << 10)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_joins(df, *small):
    """Joins in the plan whose sides are shuffled, but for those by a key of ``small`` results."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if re.search("SortMergeJoin|ShuffledHashJoin", line)]
    return [line for line in found if not any(k in line for k in small)]


def most_shuffled(df):
    """Rows that the largest exchange of a plan that has run wrote."""

    def rows(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return rows(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return rows(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        parts = node.children()
        return max([own.get().value() if own.isDefined() else 0, *(rows(parts.apply(i)) for i in range(parts.size()))])

    return rows(df._jdf.queryExecution().executedPlan())


def two_populations(spark):
    population = F.when(F.col("id") % 2 == 0, drift.BASELINE).otherwise("later")
    return spark.range(20000).select(population.alias("population"), (F.col("id") % 1000).cast("double").alias("v"))


@pytest.mark.parametrize("buckets", ["bins", "quantiles"])
def test_psi_does_not_bring_a_feature_to_one_task(measured, buckets):
    found = drift.psi(two_populations(measured), ["v"], ["later"], buckets=buckets)
    assert shuffled_joins(found, "snapshot") == []  # buckets and their totals
    assert found.first()["value"] < 0.01


def test_ranges_of_a_key_do_not_meet_again(measured):
    df = two_populations(measured)
    freq = fq.frequencies(fq.long_numbers(df, ["v"], ["population"]), ["population"])
    found = fq.quantiles(freq, ["population", "feature"], (0.0, 0.5, 1.0), ranges=5)
    assert shuffled_joins(found, "_range") == []
    assert {(r["population"], r["total"], *r["quantiles"]) for r in found.collect()} == {(drift.BASELINE, 10000, 0.0, 499.0, 998.0), ("later", 10000, 1.0, 500.0, 999.0)}
    distances = drift.cdf_distances(df, ["v"], ["later"], ranges=5)
    assert shuffled_joins(distances, "_range") == []
    r = distances.first()
    assert (r["n_baseline"], r["n"], round(r["ks"], 9), round(r["wasserstein"], 9)) == (10000, 10000, 0.002, 1.0)


def test_a_column_against_another_is_not_brought_to_one_task(measured):
    df = measured.range(20000).select((F.col("id") % 1000).cast("double").alias("a"), (F.col("id") % 1000).cast("double").alias("b"))
    found = drift.psi_of_columns(df, "a", "b")
    assert shuffled_joins(found, "snapshot") == []
    assert found.first()["value"] == 0


@pytest.mark.parametrize("keys", [(), ("population",)])
def test_bins_and_boxes_meet_their_limits_where_values_are(measured, keys):
    df = two_populations(measured)
    found = distribute.histogram(df, ["v"], n_bins=4, keys=keys)
    bins = found.collect()
    assert most_shuffled(found) < 10000
    assert sum(r["count"] for r in bins) == 20000 and len(bins) == (8 if keys else 4)
    found = distribute.box_summary(df, ["v"], keys=keys)
    boxes = found.collect()
    assert most_shuffled(found) < 10000
    assert sorted((r["median"], r["n_outliers"]) for r in boxes) == ([(499.0, 0), (500.0, 0)] if keys else [(499.5, 0)])
