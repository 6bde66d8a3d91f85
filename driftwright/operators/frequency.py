"""Frequency tables, running counts and exact quantiles: what most statistics are made from.

A frequency table has a row for each (keys, feature, value) with its count ``n``. Counting combines before it
shuffles, so a value with a third of all rows costs one row for each task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import as_double, between, finite
from ..scratch import Scratch
from . import radix

#: Estimated input size from which running counts are split into ranges of values.
SPLIT_BYTES = 4 << 30
RANGES = 64


def long_numbers(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), *, only_finite: bool = False) -> DataFrame:
    """(keys, feature, value double) without missing values, one row for each cell."""
    clean = finite if only_finite else as_double
    wide = df.select(*keys, *[clean(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)])
    return _melt(wide, columns, keys).where("value is not null")


def long_texts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value string) without nulls, one row for each cell."""
    wide = df.select(*keys, *[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(columns)])
    return _melt(wide, columns, keys).where("value is not null")


def _melt(wide: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    if not columns:
        raise ValueError("no columns of this kind")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("value")) for i, c in enumerate(columns)])
    return wide.select(*keys, F.inline(cells))


def frequencies(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*keys, "feature", "value").agg(F.count("*").alias("n"))


def is_large(df: DataFrame, most: int | None = None) -> bool:
    """Whether the optimizer's estimate of ``df`` is beyond ``most`` (``SPLIT_BYTES``); runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > (SPLIT_BYTES if most is None else most)


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by equal keys, in which null equals null; the keys are those of ``left``."""
    own = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in right.columns])
    same = reduce(lambda p, q: p & q, [F.col(f"`{k}`").eqNullSafe(F.col(o)) for k, o in own.items()])
    return left.join(other, same).drop(*own.values())


def beside(cells: DataFrame, limits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``cells`` (keys, feature, ...) with their group's row of ``limits``, in the tasks that have the cells.

    A shuffle by so few groups would bring all cells of one to one task, and Spark doesn't broadcast by measured size
    what fills few partitions. Without ``keys`` there is a row for each column, which is broadcast; with them, limits
    are written, so that their size is known when the join is planned.
    """
    small = Scratch(cells.sparkSession, "limits").table(limits, "limits") if keys else F.broadcast(limits)
    return cells.join(small, [*keys, "feature"])


def below(value: str, cuts: str, most: int) -> Column:
    """How many of the ascending ``cuts``, at most ``most``, are less than ``value``: a binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col(cuts), at + step - 1) < F.col(value), at + step).otherwise(at))


def running(table: DataFrame, keys: Sequence[str], counts: Sequence[str], *, ranges: int | None = None) -> DataFrame:
    """``table`` (keys, value, counts) with running sums ``cum_<count>`` up to each value, ``total_<count>`` and ``next_value``.

    Small tables take one window for each key. Large ones (``ranges`` above 1, or by the size of the input) are written;
    the values of a key are cut into ranges at approximate quantiles, and each range is summed by itself and starts
    at the total of the ranges before it, so that no key's values meet in one task.
    """
    ranges = (RANGES if is_large(table) else 1) if ranges is None else ranges
    whole = Window.partitionBy(*keys)
    if ranges <= 1:
        by = whole.orderBy("value")
        return table.select("*", *[F.sum(c).over(by).alias(f"cum_{c}") for c in counts], *[F.sum(c).over(whole).alias(f"total_{c}") for c in counts], F.lead("value").over(by).alias("next_value"))
    scratch = Scratch(table.sparkSession, "running")
    table = scratch.table(table, "counts")
    cuts = scratch.table(table.groupBy(*keys).agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts")), "cuts")
    ranged = joined(table, cuts, keys).withColumn("_range", below("value", "_cuts", ranges)).drop("_cuts")
    before = whole.orderBy("_range")
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts], F.min("value").alias("_first"))
    starts = totals.select(*keys, "_range", *[(F.sum(f"_t_{c}").over(before) - F.col(f"_t_{c}")).alias(f"_s_{c}") for c in counts], *[F.sum(f"_t_{c}").over(whole).alias(f"total_{c}") for c in counts], F.lead("_first").over(before).alias("_after"))
    by = Window.partitionBy(*keys, "_range").orderBy("value")
    own = ranged.select("*", *[F.sum(c).over(by).alias(f"_w_{c}") for c in counts], F.lead("value").over(by).alias("_lead"))
    return joined(own, starts, [*keys, "_range"]).select(*table.columns, *[(F.col(f"_w_{c}") + F.col(f"_s_{c}")).alias(f"cum_{c}") for c in counts], *[f"total_{c}" for c in counts], F.coalesce("_lead", "_after").alias("next_value"))


def quantiles(freq: DataFrame, keys: Sequence[str], probabilities: Sequence[float], names: Sequence[str] | None = None, *, ranges: int | None = None) -> DataFrame:
    """Exact quantiles (linear between order statistics) of each key from its frequencies.

    A row for each key: ``total`` and either one column for each of ``names`` or an array ``quantiles``.
    """
    run = running(freq, keys, ["n"], ranges=ranges).withColumnRenamed("total_n", "total")
    bounds: list[Column] = []
    for i, q in enumerate(probabilities):
        at = F.lit(float(q)) * (F.col("total") - 1)
        bounds += [F.min(F.when(F.col("cum_n") > F.floor(at), F.col("value"))).alias(f"_l{i}"), F.min(F.when(F.col("cum_n") > F.ceil(at), F.col("value"))).alias(f"_h{i}")]
    ends = run.groupBy(*keys).agg(F.first("total").alias("total"), *bounds)
    values = [between(F.col(f"_l{i}"), F.col(f"_h{i}"), (lambda at: at - F.floor(at))(F.lit(float(q)) * (F.col("total") - 1))) for i, q in enumerate(probabilities)]
    if names is None:
        return ends.select(*keys, "total", F.array(*values).alias("quantiles"))
    return ends.select(*keys, "total", *[v.alias(n) for v, n in zip(values, names, strict=True)])


def quantiles_of(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], names: Sequence[str] | None = None, keys: Sequence[str] = (), *, only_finite: bool = False, digits: bool | None = None) -> DataFrame:
    """As ``quantiles``, of columns whose frequencies nobody needs otherwise: (keys, feature, total, quantiles or names).

    Of large tables (``is_large``, or ``digits``) the quantiles are selected by their digits, in up to four passes, and
    nothing in proportion to the distinct values is shuffled.
    """
    if not (is_large(df) if digits is None else digits):
        cells = long_numbers(df, columns, keys, only_finite=only_finite)
        return quantiles(frequencies(cells, keys), [*keys, "feature"], probabilities, names)
    out = radix.quantiles(df, columns, probabilities, keys, only_finite=only_finite)
    return out if names is None else out.select(*[F.col(f"`{k}`") for k in keys], "feature", "total", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)])


def modes(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of distinct values, the most frequent one (the least of equals) and its count for each key."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))
    return freq.groupBy(*keys).agg(F.count("*").alias("n_unique"), best.alias("_b")).select(*keys, "n_unique", F.col("_b.v").alias("mode"), (-F.col("_b.m")).alias("n_mode"))


def integral(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose values a double can't all tell apart."""
    return [c for c in columns if isinstance(df.schema[c].dataType, (T.LongType, T.DecimalType))]
