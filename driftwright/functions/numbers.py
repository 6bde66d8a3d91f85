"""Numeric expressions with the library's rules for missing and infinite values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def as_double(c: Column) -> Column:
    """A double in which NaN is null."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null; text that isn't a number is null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(INF)), d)


def present(c: Column, data_type: T.DataType) -> Column:
    """True unless null or NaN."""
    return c.isNotNull() & ~F.isnan(c) if isinstance(data_type, (T.DoubleType, T.FloatType)) else c.isNotNull()


def share(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``part`` in percent of ``whole``, 0 of nothing."""
    p = F.coalesce(100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))
    return p if digits is None else F.bround(p, digits)


def between(low: Column, high: Column, weight: Column) -> Column:
    """Linear interpolation; an infinite end gives that end, both infinite ends nothing."""
    inf = F.lit(INF)
    return (
        F.when(low == high, low)
        .when((F.abs(low) < inf) & (F.abs(high) < inf), low + (high - low) * weight)
        .when((low == -inf) & (high == inf), F.lit(float("nan")))
        .when(low == -inf, low)
        .otherwise(inf)
    )


def number_text(x: float | None) -> str:
    """Four significant digits, scientific for very large and very small numbers."""
    if x is None or not math.isfinite(x):
        return "n/a"
    return "0" if x == 0 else f"{x:.3e}" if abs(x) >= 1e6 or abs(x) < 1e-4 else f"{x:.4g}"


@F.pandas_udf(T.StringType())
def interval_text(lower: pd.Series, upper: pd.Series, first: pd.Series) -> pd.Series:
    """``[a, b]`` for the first interval and ``(a, b]`` for others; one number where both ends are equal."""
    return pd.Series([number_text(a) if a == b else f"{'[' if f else '('}{number_text(a)}, {number_text(b)}]" for a, b, f in zip(lower, upper, first, strict=True)], dtype=object)


def linspace(low: Column, high: Column, n: int) -> Column:
    """``n + 1`` evenly spaced edges as an array; the last one is ``high`` itself."""
    return F.array(*[low + F.lit(float(i)) * ((high - low) / F.lit(float(n))) for i in range(n)], high)
