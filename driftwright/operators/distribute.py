"""Histograms, category counts and box statistics.

Bin edges are small tables that join the values where they are (``frequency.beside``). Every bin says how it is
closed, as the two kinds differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kinds
from ..functions.numbers import INF, as_double, finite, interval_text, linspace, share
from . import frequency as fq

EQUAL_WIDTH, QUANTILE = "equal-width", "quantile"
PADDING = 0.001
LABEL_OTHER = "Other"


def _extent(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Counts and finite range of each column, in one pass."""
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        x, f = as_double(F.col(f"`{c}`")), finite(F.col(f"`{c}`"))
        sums += [F.count(x).alias(f"v{i}"), F.count_if(x == INF).alias(f"p{i}"), F.count_if(x == -INF).alias(f"m{i}"), F.min(f).alias(f"l{i}"), F.max(f).alias(f"h{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"v{i}").alias("n_valid"), F.col(f"p{i}").alias("n_positive"), F.col(f"m{i}").alias("n_negative"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"a{i}").alias("minimum"), F.col(f"b{i}").alias("maximum")) for i, c in enumerate(columns)]
    return df.groupBy(*keys).agg(*sums).select(*keys, "n_rows", F.inline(F.array(*cells)))


def _inside(edges: Column, value: Column, closed: str) -> Column:
    """The bin of a value: how many inner edges are at most (``left``) or below (``right``) it."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, (lambda e: e <= value) if closed == "left" else (lambda e: e < value)))


def _finish(counts: DataFrame, edges: DataFrame, extent: DataFrame, keys: Sequence[str], binning: str) -> DataFrame:
    """All bins, empty ones too, with infinite values added to the outer bins."""
    group = [*keys, "feature"]
    bins = edges.select(*group, F.size("edges").alias("n_edges"), F.posexplode(F.slice("edges", F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1))))).select(*group, "n_edges", F.col("pos").alias("bin"), F.col("col").alias("bin_lower"))
    uppers = edges.select(*group, "closed", "edges")
    bins = bins.join(uppers, group).withColumn("bin_upper", F.expr("try_element_at(edges, bin + 2)"))
    out = bins.join(counts, [*group, "bin"], "left").join(extent, group)
    last = F.col("bin") == F.col("n_edges") - 2
    n = F.coalesce("n", F.lit(0)) + F.when(F.col("bin") == 0, F.col("n_negative")).otherwise(0) + F.when(last, F.col("n_positive")).otherwise(0)
    return out.select(
        *group, "position", F.lit("numeric").alias("type"), F.lit(binning).alias("binning"), "bin", "bin_lower", "bin_upper", "closed", n.cast("long").alias("count"), share(n, F.col("n_valid"), 6).alias("percentage"),
        (F.col("n_rows") - F.col("n_valid")).alias("n_missing"), (F.col("n_positive") + F.col("n_negative")).alias("n_non_finite"),
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, *, binning: str = EQUAL_WIDTH, n_bins: int = 8, keys: Sequence[str] = (), labels: bool = False) -> DataFrame:
    """Bins of each numeric column.

    Equal-width bins span the finite range and a thousandth of it on each side, and are closed on the left (the
    last one on both sides). Quantile bins are closed on the right; with at most ``n_bins`` distinct values each
    value is a bin of its own. Infinite values count in the outer bins. A column without a finite value has one bin
    from 0 to 1, which holds its infinite values. ``labels`` adds a printable ``bin_label``, which says where infinite
    values were added.
    """
    if binning not in (EQUAL_WIDTH, QUANTILE):
        raise ValueError(f"unknown binning {binning!r}")
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    names = kinds.columns_of(df, kinds.NUMERIC, [c for c in (columns or df.columns) if c not in keys])
    group = [*keys, "feature"]
    whole = _extent(df, names, keys)
    extent = whole.where("low is not null")
    cells = fq.long_numbers(df, names, keys, only_finite=True)
    if binning == EQUAL_WIDTH:
        span = F.col("high") - F.col("low")
        pad = F.when(span > 0, span * PADDING).otherwise(F.greatest(F.abs("low") * PADDING, F.lit(0.5)))
        edges = extent.select(*group, linspace(F.col("low") - pad, F.col("high") + pad, n_bins).alias("edges"), F.lit("left").alias("closed"))
    else:
        freq = fq.frequencies(cells, keys)
        few = freq.groupBy(*group).agg(F.count("*").alias("n_distinct"))
        values = fq.beside(freq, few.where(F.col("n_distinct") <= n_bins), keys).groupBy(*group).agg(F.sort_array(F.collect_list("value")).alias("v"))
        gap = F.coalesce(F.array_min(F.zip_with(F.slice("v", F.lit(2), F.size("v")), F.slice("v", F.lit(1), F.size("v") - 1), lambda b, a: b - a)), F.lit(1.0)) / 2
        own = values.select(*group, F.concat(F.transform("v", lambda x: x - gap), F.array(F.element_at("v", -1) + gap)).alias("edges"), F.lit("left").alias("closed"))
        cut = fq.quantiles(freq, group, [i / n_bins for i in range(n_bins + 1)]).join(few.where(F.col("n_distinct") > n_bins), group)
        cut = cut.select(*group, F.array_distinct("quantiles").alias("edges"), F.lit("right").alias("closed"))
        edges = own.union(cut)
    counted = fq.beside(cells, edges, keys).groupBy(*group, F.when(F.col("closed") == "left", _inside(F.col("edges"), F.col("value"), "left")).otherwise(_inside(F.col("edges"), F.col("value"), "right")).alias("bin")).agg(F.count("*").alias("n"))
    edges = edges.union(whole.where("low is null").select(*group, F.array(F.lit(0.0), F.lit(1.0)), F.lit("left")))
    out = _finish(counted, edges, whole, keys, binning)
    if not labels:
        return out
    ends = whole.select(*group, "n_valid", "n_positive", "n_negative", F.col("low").isNull().alias("unbounded"))
    out = labelled(out).join(ends, group)
    last = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("bin"))) == 1
    text = F.concat(F.when((F.col("bin") == 0) & (F.col("n_negative") > 0), F.lit("-∞ + ")).otherwise(F.lit("")), "bin_label", F.when(last & (F.col("n_positive") > 0), F.lit(" + ∞")).otherwise(F.lit("")))
    label = F.when(F.col("unbounded"), F.when(F.col("n_valid") > 0, F.lit("non-finite values")).otherwise(F.lit("no data"))).otherwise(text)
    return out.withColumn("bin_label", label).drop("n_valid", "n_positive", "n_negative", "unbounded")


def labelled(bins: DataFrame) -> DataFrame:
    """Bins with a printable interval; the table of bins is small, whatever it was made from."""
    return bins.withColumn("bin_label", interval_text("bin_lower", "bin_upper", F.col("bin") == 0))


def category_counts(df: DataFrame, columns: Sequence[str] | None = None, *, max_categories: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent values of each categorical column; the others are one row, ``Other (k categories)``.

    Equal counts go to the lesser text. Ranks are limited before they are shuffled.
    """
    if max_categories < 1:
        raise ValueError("max_categories must be at least 1")
    names = kinds.columns_of(df, kinds.CATEGORICAL, [c for c in (columns or df.columns) if c not in keys])
    group = [*keys, "feature"]
    freq = fq.frequencies(fq.long_texts(df, names, keys), keys)
    totals = freq.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("levels"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "value"))
    top = freq.withColumn("bin", rank).where(F.col("bin") <= max_categories)
    rest = top.groupBy(*group).agg(F.sum("n").alias("shown")).join(totals, group).where(F.col("levels") > max_categories)
    other = rest.select(*group, F.format_string(f"{LABEL_OTHER} (%d categories)", F.col("levels") - max_categories).alias("value"), (F.col("total") - F.col("shown")).alias("n"), F.lit(max_categories + 1).alias("bin"))
    out = top.select(*group, "value", "n", "bin").union(other).join(totals, group)
    return out.select(*group, F.lit("categorical").alias("type"), (F.col("bin") - 1).alias("bin"), F.col("value").alias("bin_label"), F.col("n").alias("count"), share(F.col("n"), F.col("total"), 6).alias("percentage"))


def _limits(df: DataFrame, names: Sequence[str], keys: Sequence[str], ranges: int | None) -> tuple[DataFrame, DataFrame]:
    cells = fq.long_numbers(df, names, keys, only_finite=True)
    quartiles, own = (0.25, 0.5, 0.75), ("q1", "median", "q3")
    if ranges is None:
        q = fq.quantiles_of(df, names, quartiles, own, keys, only_finite=True)
    else:
        q = fq.quantiles(fq.frequencies(cells, keys), [*keys, "feature"], quartiles, own, ranges=ranges)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return cells, q.withColumn("lower_limit", F.col("q1") - reach).withColumn("upper_limit", F.col("q3") + reach)


def box_summary(df: DataFrame, columns: Sequence[str] | None = None, *, keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Quartiles, Tukey fences and exact numbers of outliers of each numeric column.

    Quartiles, mean and standard deviation are of finite values; infinite ones count as outliers and in min and
    max. Fences are the outermost values within 1.5 interquartile ranges of the quartiles.
    """
    names = kinds.columns_of(df, kinds.NUMERIC, [c for c in (columns or df.columns) if c not in keys])
    group = [*keys, "feature"]
    cells, limits = _limits(df, names, keys, ranges)
    v, low, high = F.col("value"), F.col("lower_limit"), F.col("upper_limit")
    inner = fq.beside(cells, limits, keys).groupBy(*group).agg(
        F.min(F.when(v >= low, v)).alias("lower_fence"), F.max(F.when(v <= high, v)).alias("upper_fence"), F.count_if(v < low).alias("below"), F.count_if(v > high).alias("above"),
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("_min"), F.max("value").alias("_max"),
    )
    out = _extent(df, names, keys).where("n_valid > 0").join(limits, group, "left").join(inner, group, "left")
    below, above = (F.coalesce(a, F.lit(0)) + F.col(b) for a, b in (("below", "n_negative"), ("above", "n_positive")))
    return out.select(
        *group, "position", "n_valid", (F.col("n_rows") - F.col("n_valid")).alias("n_missing"), (F.col("n_positive") + F.col("n_negative")).alias("n_non_finite"), F.col("minimum").alias("min"),
        F.coalesce("lower_fence", "_min").alias("lower_fence"), "q1", "median", "q3", F.coalesce("upper_fence", "_max").alias("upper_fence"), F.col("maximum").alias("max"), "mean", "std", (F.col("q3") - F.col("q1")).alias("iqr"),
        below.alias("n_outliers_low"), above.alias("n_outliers_high"), (below + above).alias("n_outliers"), share(below + above, F.col("n_valid"), 4).alias("perc_outliers"),
    )


def outlier_points(df: DataFrame, columns: Sequence[str] | None = None, *, max_points: int = 1500, keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """The outliers of each column; of more than ``max_points``, those at evenly spaced places of their order.

    Places come from running counts of distinct values, so repeated values aren't listed to be thinned out.
    """
    names = kinds.columns_of(df, kinds.NUMERIC, [c for c in (columns or df.columns) if c not in keys])
    group = [*keys, "feature"]
    cells, limits = _limits(df, names, keys, ranges)
    tails = fq.beside(fq.frequencies(cells, keys), limits.select(*group, "lower_limit", "upper_limit"), keys).where("value < lower_limit or value > upper_limit").select(*group, "value", "n")
    run = fq.running(tails, group, ["n"], ranges=ranges).withColumnRenamed("total_n", "outliers")
    kept = F.least(F.col("outliers"), F.lit(max_points))
    # the point at place k of kept points stands at floor(k * (outliers - 1) / (kept - 1))
    step = F.when(kept > 1, (F.col("outliers") - 1) / (kept - 1)).otherwise(F.lit(1.0))
    first, last = F.ceil((F.col("cum_n") - F.col("n")) / step), F.ceil(F.col("cum_n") / step) - 1
    places = F.when(F.least(last, kept - 1) >= first, F.sequence(first, F.least(last, kept - 1)))
    return run.select(*group, F.explode(places).alias("place"), "value")
