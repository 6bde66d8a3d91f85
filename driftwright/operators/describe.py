"""Descriptive statistics and missing values of each column, for a table or for each of its segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kinds
from ..functions.numbers import present, share
from . import frequency as fq

QUANTILES = (0.01, 0.5, 0.99)


def _counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows, valid values and zeros of each column in one pass."""
    types = {f.name: f.dataType for f in df.schema}

    def zero(c: str) -> Column:
        if isinstance(types[c], T.BooleanType):
            return ~F.col(f"`{c}`")
        return F.col(f"`{c}`") == 0 if isinstance(types[c], T.NumericType) else F.lit(False)

    sums = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        sums += [F.count_if(present(F.col(f"`{c}`"), types[c])).alias(f"_v{i}"), F.count_if(zero(c)).alias(f"_z{i}")]
    wide = df.groupBy(*keys).agg(*sums)
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.lit(types[c].simpleString()).alias("data_type"), F.col(f"_v{i}").alias("n_valid"), F.col(f"_z{i}").alias("n_zeros")) for i, c in enumerate(columns)]
    return wide.select(*keys, "n_rows", F.inline(F.array(*cells)))


def _finish(counts: DataFrame, stats: DataFrame, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Counts with statistics; nulls are the mode where they are strictly more frequent than any value."""
    missing = F.col("n_rows") - F.col("n_valid")
    nulls = missing > F.coalesce("n_mode", F.lit(0))
    return (
        counts.join(stats, [*keys, "feature"], "left")
        .withColumn("n_missing", missing)
        .select(
            *keys, "feature", "position", "data_type", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "n_missing", share(F.col("n_missing"), F.col("n_rows"), 3).alias("perc_missing"), "n_zeros",
            share(F.col("n_zeros"), F.col("n_rows"), 3).alias("perc_zeros"), F.when(~nulls, F.col("mode")).alias("mode"), share(F.when(nulls, F.col("n_missing")).otherwise(F.coalesce("n_mode", F.lit(0))), F.col("n_rows"), 3).alias("perc_mode"), *extra,
        )
    )


def states(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """What ``describe`` is made from, as tables that ``merged`` adds up over parts of a table: counts of cells, frequencies
    of values as doubles, and of 64-bit integers and decimals as such."""
    names = kinds.columns_of(df, kinds.NUMERIC, [c for c in (columns or df.columns) if c not in keys])
    if not names:
        raise ValueError("no numeric columns")
    out = {"counts": _counts(df, names, keys), "numbers": fq.frequencies(fq.long_numbers(df, names, keys), keys)}
    exact = fq.integral(df, names)
    if exact:
        cells = fq._melt(df.select(*keys, *[F.col(f"`{c}`").cast("decimal(38,6)").alias(f"_{i}") for i, c in enumerate(exact)]), exact, keys).where("value is not null")
        out["exact"] = fq.frequencies(cells, keys)
    return out


def merged(parts: Mapping[str, DataFrame], keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """States of a whole table from those of its parts, given as unions. A column of several types is of type ``mixed``; if
    some parts count it as doubles, the whole does."""
    kind = F.when(F.min("data_type") == F.max("data_type"), F.min("data_type")).otherwise("mixed").alias("data_type")
    counts = parts["counts"].groupBy(*keys, "feature").agg(F.sum("n_rows").alias("n_rows"), F.min("position").alias("position"), kind, F.sum("n_valid").alias("n_valid"), F.sum("n_zeros").alias("n_zeros"))
    out = {"counts": counts, **{n: t.groupBy(*keys, "feature", "value").agg(F.sum("n").alias("n")) for n, t in parts.items() if n != "counts"}}
    if "exact" in out:
        group = [*keys, "feature"]
        whole = fq.joined(counts.select(*group, "n_valid"), parts["exact"].groupBy(*group).agg(F.sum("n").alias("n_exact")), group).where("n_valid = n_exact")
        out["exact"] = fq.joined(out["exact"], whole.select(*group), group)
    return out


def described(own: Mapping[str, DataFrame], keys: Sequence[str] = (), *, ranges: int | None = None) -> DataFrame:
    """The result of ``describe`` from the states of a table."""
    group = [*keys, "feature"]
    stats = fq.modes(own["numbers"], group)
    if "exact" in own:
        exact = fq.modes(own["exact"], group).withColumn("mode", F.col("mode").cast("double"))
        stats = stats.join(exact.select(*group), group, "left_anti").unionByName(exact)
    quantiles = fq.quantiles(own["numbers"], group, (0.0, *QUANTILES, 1.0), ("min", "q01", "q50", "q99", "max"), ranges=ranges).drop("total")
    return _finish(own["counts"], stats.join(quantiles, group, "left"), keys, ("min", "q01", "q50", "q99", "max"))


def describe(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), *, ranges: int | None = None, type_labels: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each numeric column: missing, zeros, mode, and exact quantiles. Infinite values are ordinary ones.

    Distinct values and modes of 64-bit integers and decimals are counted as such, not as doubles. The types of
    columns that were narrowed can be reported as they were by ``type_labels``.
    """
    out = described(states(df, columns, keys), keys, ranges=ranges)
    for name, label in (type_labels or {}).items():
        out = out.withColumn("data_type", F.when(F.col("feature") == name, label).otherwise(F.col("data_type")))
    return out


def describe_discrete(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """A row for each column that isn't numeric; the mode is text, equal counts go to the least text."""
    names = [c for c in (columns or df.columns) if c not in keys and kinds.kind(df.schema[c].dataType) != kinds.NUMERIC]
    if not names:
        raise ValueError("no discrete columns")
    stats = fq.modes(fq.frequencies(fq.long_texts(df, names, keys), keys), [*keys, "feature"])
    return _finish(_counts(df, names, keys), stats, keys, ())


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), *, only_missing: bool = True) -> DataFrame:
    """Missing values of each column (NaN counts), with their share in percent."""
    names = [c for c in (columns or df.columns) if c not in keys]
    out = _counts(df, names, keys).withColumn("number_of_missing", F.col("n_rows") - F.col("n_valid"))
    out = out.select(*keys, "feature", "position", "number_of_missing", share(F.col("number_of_missing"), F.col("n_rows"), 4).alias("percentage_of_missing"))
    return out.where("number_of_missing > 0") if only_missing else out


def formatted(table: DataFrame, digits: dict[str, int]) -> DataFrame:
    """``table`` with some of its numbers as text with thousands separators."""
    return table.withColumns({c: F.format_number(c, d) for c, d in digits.items()})
