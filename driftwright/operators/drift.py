"""Distances between a baseline and snapshots: PSI, Kolmogorov-Smirnov, Wasserstein, energy and chi-square.

All populations are rows of one long table with a ``population`` column; the baseline's rows have
``BASELINE``. Each numeric distance is one running sum over the distinct values of a feature with a count for
every population; each categorical one is an aggregate over levels. Only the names of the populations are
known to the driver. Missing values never count; infinite ones don't either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kinds
from ..functions.numbers import INF, linspace
from ..functions.pvalues import ks_p_values
from . import frequency as fq

BASELINE = "\u0000baseline"
EPSILON = 1e-4
#: Estimated input size from which the running sums of distances are split: a value of the baseline is a row for each snapshot.
SPLIT_BYTES = 64 << 20
#: Names of each method.
METHODS = {"psi": "psi", "ks": "ks", "ks2": "ks", "ws": "wasserstein", "wasserstein": "wasserstein", "cm": "energy", "energy": "energy", "chi2": "chi_square", "chi_square": "chi_square", "chisquare": "chi_square"}
BUCKETS = {"bin": "bins", "bins": "bins", "equal": "bins", "equal_width": "bins", "quantile": "quantiles", "quantiles": "quantiles", "qcut": "quantiles"}


def bucket_type(name: str) -> str:
    found = BUCKETS.get(str(name).strip().lower().replace("-", "_"))
    if found is None:
        raise ValueError(f"unknown bucket type {name!r}; known: {sorted(BUCKETS)}")
    return found


def split_kinds(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and other features, as the types of the baseline say."""
    numeric = [c for c in columns if kinds.drift_kind(df.schema[c].dataType) == kinds.NUMERIC]
    return numeric, [c for c in columns if c not in numeric]


def populations(df: DataFrame) -> list[str]:
    """The snapshots of a long table, in order."""
    return sorted(r[0] for r in df.select("population").where(F.col("population") != BASELINE).distinct().collect())


def breakpoints(baseline: DataFrame, columns: Sequence[str], *, n_buckets: int = 10, buckets: str = "bins") -> DataFrame:
    """Edges of each numeric feature from its baseline: (feature, edges, constant).

    The outer edges are infinite. A constant baseline has three buckets: below, equal and above.
    """
    if n_buckets < 1:
        raise ValueError("at least one bucket is needed")
    kind = bucket_type(buckets)
    cells = fq.long_numbers(baseline, columns, only_finite=True)
    ends = [F.array(F.lit(-INF)), F.array(F.lit(INF))]
    if kind == "bins":
        r = cells.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        inner = F.slice(linspace(F.col("low"), F.col("high"), n_buckets), F.lit(2), F.lit(n_buckets - 1))
    else:
        q = fq.quantiles_of(baseline, columns, [i / n_buckets for i in range(n_buckets + 1)], only_finite=True)
        r = q.withColumn("low", F.col("quantiles")[0]).withColumn("high", F.element_at("quantiles", -1))
        inner = F.array_distinct(F.slice("quantiles", F.lit(2), F.lit(n_buckets - 1)))
    constant = F.col("low") == F.col("high")
    return r.select("feature", constant.alias("constant"), F.when(constant, F.array(F.lit(-INF), F.col("low"), F.col("low"), F.lit(INF))).otherwise(F.concat(ends[0], inner, ends[1])).alias("edges"))


def bucket(value: Column) -> Column:
    """The bucket of a value: closed on the left, or below, at and above a constant."""
    inner = F.slice("edges", F.lit(2), F.size("edges") - 2)
    at = F.size(F.filter(inner, lambda e: e <= value))
    return F.when(F.col("constant"), F.when(value < F.col("edges")[1], 0).when(value == F.col("edges")[1], 1).otherwise(2)).otherwise(at)


def _psi(expected: Column, actual: Column) -> Column:
    a, e = F.greatest(actual, F.lit(EPSILON)), F.greatest(expected, F.lit(EPSILON))
    return F.when(expected.isNotNull() & actual.isNotNull(), (a - e) * F.ln(a / e))


def paired(counts: DataFrame, snapshots: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(feature, snapshot, by, n_baseline, n) of counts (feature, population, by, n): the baseline's beside each snapshot's.

    A row is a count that one of the two has, so the plan has the same width for any number of snapshots, and a value
    costs a row for each snapshot that has it, or for all of them if the baseline does.
    """
    base = F.col("population") == BASELINE
    to = F.when(base, F.array(*[F.lit(s) for s in snapshots])).otherwise(F.when(F.col("population").isin(list(snapshots)), F.array("population")).otherwise(F.array().cast("array<string>")))
    both = counts.select("feature", *by, F.explode(to).alias("snapshot"), F.when(base, F.col("n")).otherwise(0).alias("n_baseline"), F.when(base, 0).otherwise(F.col("n")).alias("n"))
    return both.groupBy("feature", "snapshot", *by).agg(F.sum("n_baseline").alias("n_baseline"), F.sum("n").alias("n"))


def psi_table(df: DataFrame, columns: Sequence[str], snapshots: Sequence[str], *, n_buckets: int = 10, buckets: str = "bins") -> DataFrame:
    """Counts, shares and PSI of each bucket (numeric) or level (others) of each feature and snapshot."""
    numeric, other = split_kinds(df, columns)
    parts = []
    if numeric:
        edges = breakpoints(df.where(F.col("population") == BASELINE), numeric, n_buckets=n_buckets, buckets=buckets)
        cells = fq.long_numbers(df, numeric, ["population"], only_finite=True)
        counts = fq.beside(cells, edges).groupBy("feature", "population", bucket(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))
        # every bucket of a feature has a row for each snapshot
        every = edges.select("feature", F.lit(BASELINE).alias("population"), F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"), F.lit(0).cast("long").alias("n"))
        own = paired(counts.union(every), snapshots, ["bin"]).join(F.broadcast(edges), "feature")
        parts.append(own.select("feature", "snapshot", F.lit("numeric").alias("kind"), "bin", F.col("edges")[F.col("bin")].alias("lower"), F.col("edges")[F.col("bin") + 1].alias("upper"), F.lit(None).cast("string").alias("level"), "n_baseline", "n"))
    if other:
        freq = fq.frequencies(fq.long_texts(df, other, ["population"]), ["population"])
        parts.append(paired(freq, snapshots, ["value"]).select("feature", "snapshot", F.lit("categorical").alias("kind"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.col("value").alias("level"), "n_baseline", "n"))
    table = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    totals = table.groupBy("feature", "snapshot").agg(F.nullif(F.sum("n_baseline"), F.lit(0)).alias("total_baseline"), F.nullif(F.sum("n"), F.lit(0)).alias("total"))
    both = table.join(totals, ["feature", "snapshot"])
    e, a = F.col("n_baseline") / F.col("total_baseline"), F.col("n") / F.col("total")
    return both.select("feature", "snapshot", "kind", "bin", "lower", "upper", "level", "n_baseline", "n", e.alias("share_baseline"), a.alias("share"), _psi(e, a).alias("psi"))


def psi(df: DataFrame, columns: Sequence[str], snapshots: Sequence[str], *, n_buckets: int = 10, buckets: str = "bins") -> DataFrame:
    """PSI of each feature and snapshot; null where a population has no value."""
    table = psi_table(df, columns, snapshots, n_buckets=n_buckets, buckets=buckets)
    whole = F.count_if(F.col("psi").isNull()) == 0
    return table.groupBy("feature", "snapshot").agg(F.when(whole, F.sum("psi")).alias("value"))


def cdf_distances(df: DataFrame, columns: Sequence[str], snapshots: Sequence[str], *, ranges: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov, Wasserstein and energy distance of numeric features, with the populations' sizes.

    One scan of running sums, in segments of a feature and a snapshot, over the values that the snapshot or the
    baseline has; between these neither distribution changes.
    """
    freq = fq.frequencies(fq.long_numbers(df, columns, ["population"], only_finite=True), ["population"])
    both, group = paired(freq, snapshots, ["value"]), ["feature", "snapshot"]
    if ranges is None and fq.is_large(df, SPLIT_BYTES):
        ranges = fq.RANGES
    run = fq.running(both, group, ["n_baseline", "n"], ranges=ranges)
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    gap = F.abs(F.col("cum_n_baseline") / F.nullif("total_n_baseline", F.lit(0)) - F.col("cum_n") / F.nullif("total_n", F.lit(0)))
    stats = [F.max(gap).alias("ks"), F.sum(gap * width).alias("wasserstein"), F.sqrt(2 * F.sum(gap * gap * width)).alias("energy"), F.first("total_n").alias("n")]
    return run.groupBy(*group).agg(F.first("total_n_baseline").alias("n_baseline"), *stats).select("feature", "n_baseline", "snapshot", "ks", "wasserstein", "energy", "n")


def chi_square(df: DataFrame, columns: Sequence[str], snapshots: Sequence[str]) -> DataFrame:
    """Pearson's chi-square of the raw counts of levels, without correction; 0 where there is one level."""
    freq = fq.frequencies(fq.long_texts(df, columns, ["population"]), ["population"])
    both, group = paired(freq, snapshots, ["value"]), ["feature", "snapshot"]
    totals = both.groupBy(*group).agg(F.sum("n_baseline").cast("double").alias("t0"), F.sum("n").cast("double").alias("t1"))
    level, whole = F.col("n_baseline") + F.col("n"), F.col("t0") + F.col("t1")
    e0, e1 = F.col("t0") * level / whole, F.col("t1") * level / whole
    term = (F.col("n_baseline") - e0) ** 2 / F.nullif(e0, F.lit(0.0)) + (F.col("n") - e1) ** 2 / F.nullif(e1, F.lit(0.0))
    usable = (F.first("t0") > 0) & (F.first("t1") > 0)
    value = F.when(usable, F.when(F.count("*") <= 1, 0.0).otherwise(F.sum(term)))
    return both.join(totals, group).groupBy(*group).agg(value.alias("value"))


def ks_details(df: DataFrame, columns: Sequence[str], snapshots: Sequence[str]) -> DataFrame:
    """KS statistic, p-value, and the critical region of the populations' numbers of rows."""
    found = cdf_distances(df, columns, snapshots).withColumn("p_value", ks_p_values("ks", "n_baseline", "n"))
    rows = df.groupBy("population").agg(F.count("*").alias("rows"))
    base = F.max(F.when(F.col("population") == BASELINE, F.col("rows"))).over(Window.partitionBy(F.lit(0)))  # over a row for each population
    sizes = rows.withColumn("rows_baseline", base).where(F.col("population") != BASELINE).withColumnRenamed("population", "snapshot")
    region = 1.731 * F.sqrt((F.col("rows_baseline") + F.col("rows")) / (F.col("rows_baseline").cast("double") * F.col("rows")))
    return found.join(sizes, "snapshot").select("feature", "snapshot", F.bround("ks", 4).alias("ks"), F.bround("p_value", 4).alias("p_value"), F.bround(region, 4).alias("critical_region"))


def distances(df: DataFrame, columns: Sequence[str], methods: Sequence[str] = ("psi",), snapshots: Sequence[str] | None = None, *, n_buckets: int = 10, buckets: str = "bins") -> DataFrame:
    """(method, feature, snapshot, value) with four decimals; null with a note where a method doesn't apply."""
    wanted = []
    for m in methods:
        name = METHODS.get(str(m).strip().lower())
        if name is None:
            raise ValueError(f"unknown method {m!r}; known: {sorted(METHODS)}")
        wanted.append(name)
    wanted = list(dict.fromkeys(wanted))
    snapshots = populations(df) if snapshots is None else list(snapshots)
    numeric, other = split_kinds(df, columns)
    spark, parts = df.sparkSession, []
    by_cdf = [m for m in wanted if m in ("ks", "wasserstein", "energy")]
    if by_cdf and numeric:
        cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("value")) for m in by_cdf])
        parts.append(cdf_distances(df, numeric, snapshots).select("feature", "snapshot", F.inline(cells)).select("method", "feature", "snapshot", "value"))
    if "psi" in wanted:
        parts.append(psi(df, columns, snapshots, n_buckets=n_buckets, buckets=buckets).select(F.lit("psi").alias("method"), "feature", "snapshot", "value"))
    if "chi_square" in wanted and other:
        parts.append(chi_square(df, other, snapshots).select(F.lit("chi_square").alias("method"), "feature", "snapshot", "value"))
    grid = [(i, m, j, f, k, s, ("distance needs a numeric feature" if m in ("ks", "wasserstein", "energy") and f in other else "chi-square needs a categorical feature" if m == "chi_square" and f in numeric else None)) for i, m in enumerate(wanted) for j, f in enumerate(columns) for k, s in enumerate(snapshots)]
    frame = spark.createDataFrame(grid, "method_order int, method string, feature_order int, feature string, snapshot_order int, snapshot string, note string")
    found = parts[0] if parts else frame.select("method", "feature", "snapshot", F.lit(None).cast("double").alias("value")).limit(0)
    for p in parts[1:]:
        found = found.union(p)
    out = frame.join(found, ["method", "feature", "snapshot"], "left")
    return out.select("method", "feature", "snapshot", F.bround("value", 4).alias("value"), F.coalesce("note", F.when(F.col("value").isNull(), "a population has no usable value")).alias("note"), "method_order", "feature_order", "snapshot_order")


def extended(found: DataFrame) -> DataFrame:
    """Mean, standard deviation and range of each distance over the snapshots."""
    return found.groupBy("method", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def severity(value: Column, warn: float = 0.10, alert: float = 0.25, *, higher_is_worse: bool = True) -> Column:
    """``stable``, ``moderate`` or ``substantial``; a value on a threshold belongs to the worse side."""
    if higher_is_worse:
        return F.when(value >= alert, "substantial").when(value >= warn, "moderate").when(value.isNotNull(), "stable")
    return F.when(value <= alert, "substantial").when(value <= warn, "moderate").when(value.isNotNull(), "stable")


def triage(found: DataFrame) -> DataFrame:
    """Features by their worst PSI, with where it was and how bad it is; undefined ones last."""
    best = found.where("method = 'psi'").groupBy("feature").agg(F.max("value").alias("psi"), F.expr("max_by(snapshot, struct(value, snapshot))").alias("snapshot"))
    return best.select("feature", "psi", F.when(F.col("psi").isNotNull(), F.col("snapshot")).alias("snapshot"), severity(F.col("psi")).alias("severity"))


def ranked(found: DataFrame, method: str) -> DataFrame:
    """Features by their largest distance of one method; those without any are left out."""
    return found.where(F.col("method") == method).groupBy("feature").agg(F.max("value").alias("worst")).where("worst is not null")


def psi_of_columns(df: DataFrame, expected: str, actual: str, *, n_buckets: int = 20, buckets: str = "bins") -> DataFrame:
    """PSI of two columns of one table."""
    long = df.select(F.inline(F.array(F.struct(F.lit(BASELINE).alias("population"), F.col(f"`{expected}`").alias("value")), F.struct(F.lit("actual").alias("population"), F.col(f"`{actual}`").alias("value")))))
    return psi(long, ["value"], ["actual"], n_buckets=n_buckets, buckets=buckets).select("value")
