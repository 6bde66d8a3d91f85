"""Means, modes, spread, missing values and model scores of populations over time."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kinds
from ..functions.numbers import as_double, finite, present, share
from . import drift as dr
from . import frequency as fq

GRID, MARGIN = 256, 0.05
#: Powers of a cell's expansion, and scales beyond which a kernel is nothing.
TERMS, REACH = 18, 7.0


def descriptives(df: DataFrame, columns: Sequence[str], measures: Sequence[str] = ("mean", "std")) -> DataFrame:
    """(measure, feature, population, number, text): means of numbers and modes of others, and deviations of numbers.

    Equal modes go to the least text. Four decimals.
    """
    bad = [m for m in measures if m not in ("mean", "std")]
    if bad:
        raise ValueError(f"unknown measures {bad}")
    numeric, other = dr.split_kinds(df, columns)
    parts = []
    if numeric:
        sums = [x for i, c in enumerate(numeric) for v in [as_double(F.col(f"`{c}`"))] for x in (F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"))]
        cells = [F.struct(F.lit(m).alias("measure"), F.lit(c).alias("feature"), F.bround(f"{k}{i}", 4).alias("number"), F.lit(None).cast("string").alias("text")) for m, k in (("mean", "a"), ("std", "s")) if m in measures for i, c in enumerate(numeric)]
        parts.append(df.groupBy("population").agg(*sums).select("population", F.inline(F.array(*cells))))
    if other and "mean" in measures:
        best = fq.modes(fq.frequencies(fq.long_texts(df, other, ["population"]), ["population"]), ["population", "feature"])
        parts.append(best.select("population", F.lit("mean").alias("measure"), "feature", F.lit(None).cast("double").alias("number"), F.col("mode").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("measure", "feature", "population", "number", "text")


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of each feature and population, in numbers and percent (three decimals)."""
    types = {f.name: f.dataType for f in df.schema}
    sums = [F.count_if(~present(F.col(f"`{c}`"), types[c])).alias(f"m{i}") for i, c in enumerate(columns)]
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(columns)]
    wide = df.groupBy("population").agg(F.count("*").alias("n_rows"), *sums)
    return wide.select("population", "n_rows", F.inline(F.array(*cells))).withColumn("perc_missing", share(F.col("n_missing"), F.col("n_rows"), 3))


def rows_compared(df: DataFrame) -> DataFrame:
    """Rows of each population and their share of its side: the baseline's, or all snapshots'."""
    rows = df.groupBy("population").agg(F.count("*").alias("n_rows")).withColumn("side", F.when(F.col("population") == dr.BASELINE, "baseline").otherwise("current"))
    return rows.join(rows.groupBy("side").agg(F.sum("n_rows").alias("total")), "side").select("side", "population", "n_rows", share(F.col("n_rows"), F.col("total"), 4).alias("share_of_rows"))


def score_bands(df: DataFrame, score: str, snapshots: Sequence[str], *, n_bins: int = 10, buckets: str = "bins") -> DataFrame:
    """Share of each population's scores in the bands of the baseline, in percent (four decimals)."""
    table = dr.psi_table(df, [score], snapshots, n_buckets=n_bins, buckets=buckets)
    own = table.select(F.col("snapshot").alias("population"), "bin", "lower", "upper", "level", "share")
    base = table.where(F.col("snapshot") == snapshots[0]).select(F.lit(dr.BASELINE).alias("population"), "bin", "lower", "upper", "level", F.col("share_baseline").alias("share"))
    return base.union(own).withColumn("share", F.bround(F.col("share") * 100, 4))


def score_summary(df: DataFrame, score: str, snapshots: Sequence[str], *, n_bins: int = 10, buckets: str = "bins") -> DataFrame:
    """Rows, missing values, moments, quartiles and PSI against the baseline of each population's scores."""
    numeric = kinds.drift_kind(df.schema[score].dataType) == kinds.NUMERIC
    c = F.col(f"`{score}`")
    x = finite(c) if numeric else F.lit(None).cast("double")
    sums = df.groupBy("population").agg(F.count("*").alias("n_rows"), F.count_if(~present(c, df.schema[score].dataType)).alias("n_missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    if numeric:
        q = fq.quantiles_of(df, [score], (0.25, 0.5, 0.75), ("p25", "median", "p75"), ["population"], only_finite=True).drop("feature", "total")
        sums = sums.join(q, "population", "left")
    else:
        sums = sums.withColumns({k: F.lit(None).cast("double") for k in ("p25", "median", "p75")})
    psi = dr.psi(df, [score], snapshots, n_buckets=n_bins, buckets=buckets).select(F.col("snapshot").alias("population"), F.col("value").alias("psi_vs_baseline"))
    out = sums.join(psi, "population", "left").withColumn("psi_vs_baseline", F.when(F.col("population") == dr.BASELINE, 0.0).otherwise(F.col("psi_vs_baseline")))
    return out.select("population", "n_rows", "n_missing", "mean", "std", "min", "p25", "median", "p75", "max", F.bround("psi_vs_baseline", 4).alias("psi_vs_baseline"))


def score_verdict(summary: DataFrame) -> DataFrame:
    """The worst snapshot by PSI and how bad it is."""
    worst = summary.where(F.col("population") != dr.BASELINE).agg(F.max("psi_vs_baseline").alias("psi"), F.expr("max_by(population, struct(psi_vs_baseline, population))").alias("snapshot"))
    return worst.select("snapshot", "psi", dr.severity(F.col("psi")).alias("severity"))


def score_density(df: DataFrame, score: str, *, points: int = GRID) -> DataFrame:
    """Gaussian kernel density of each population's scores on one grid, with Scott's bandwidth.

    The grid spans all populations and a margin. The sum over all values is a fast Gauss transform: values are sorted
    into cells as wide as the kernel's scale, sqrt(2) bandwidths; a cell's values are summed up as the first ``TERMS`` powers
    of their distance to its middle, and a grid point reads a cell by its Hermite expansion. Distances are at most half a scale, so the terms
    left out add less than 1e-13 of the highest kernel, and grid points more than ``REACH`` scales away less than 1e-18.
    Sums of cells merge before they are shuffled: a task sends a row for each cell, of which there are range / scale at
    most, whatever the number of values. A row for each population passes the driver.
    """
    cells = fq.long_numbers(df, [score], ["population"], only_finite=True)
    stats = cells.groupBy("population").agg(F.count("*").alias("total"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    rows = [(r["population"], r["total"], r["low"], r["high"], r["sd"] * r["total"] ** -0.2) for r in stats.where("total >= 2 and low < high").collect()]
    low, high = min((r[2] for r in rows), default=0.0), max((r[3] for r in rows), default=0.0)
    start, step = low - MARGIN * (high - low), (high - low + 2 * (MARGIN * (high - low))) / (points - 1)
    usable = df.sparkSession.createDataFrame([(p, n, first, h, h * math.sqrt(2)) for p, n, first, _, h in rows], "population string, total long, low double, h double, scale double")
    away = (F.col("value") - F.col("low")) / F.col("scale")
    own = cells.join(F.broadcast(usable), "population").withColumn("cell", F.floor(away)).withColumn("u", away - F.col("cell") - 0.5)  # a row for each population that the caller named
    powers, u = [], F.lit(1.0)
    for k in range(TERMS):
        powers.append((F.sum(u) / float(math.factorial(k))).alias(f"a{k}"))
        u = u * F.col("u")
    sums = own.groupBy("population", "cell").agg(*powers)
    middle = F.col("low") + (F.col("cell") + 0.5) * F.col("scale")
    reach = REACH * F.col("scale")
    ends = [F.least(F.greatest(x, F.lit(-1.0)), F.lit(float(points))).cast("int") for x in (F.ceil((middle - reach - start) / step).cast("double"), F.floor((middle + reach - start) / step).cast("double"))]
    near = sums.join(F.broadcast(usable), "population").withColumn("middle", middle).withColumns({"lo": F.greatest(ends[0], F.lit(0)), "hi": F.least(ends[1], F.lit(points - 1))}).where("lo <= hi")
    at = near.withColumn("point", F.explode(F.sequence("lo", "hi"))).withColumn("score", F.lit(start) + F.col("point") * F.lit(step))
    at = at.withColumn("t", (F.col("score") - F.col("middle")) / F.col("scale"))
    hermite = [F.exp(-F.col("t") * F.col("t"))]
    at = at.withColumn("h0", hermite[0]).withColumn("h1", 2 * F.col("t") * F.col("h0"))
    for k in range(2, TERMS):
        at = at.withColumn(f"h{k}", 2 * F.col("t") * F.col(f"h{k - 1}") - 2.0 * (k - 1) * F.col(f"h{k - 2}"))
    kernel = reduce(lambda p, q: p + q, [F.col(f"a{k}") * F.col(f"h{k}") for k in range(TERMS)])
    grid = usable.select("population", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    summed = at.groupBy("population", "point").agg(F.sum(kernel).alias("k"))
    out = grid.join(summed, ["population", "point"], "left").join(F.broadcast(usable), "population")
    density = F.greatest(F.coalesce("k", F.lit(0.0)), F.lit(0.0)) / (F.col("total") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return out.select("population", "point", (F.lit(start) + F.col("point") * F.lit(step)).alias("score"), density.alias("density"))
