"""Segments of a table: a column beside the others, so that one plan serves all segments at once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite, share
from . import frequency as fq

SEGMENT = "segment"
BY_VALUE, INTERVALS, EQUAL_WIDTH, QUANTILE, WHOLE = "value", "intervals", "equal-width", "quantile", "all"


@dataclass(frozen=True)
class Grouping:
    """A table with its segment column (null: unassigned), and the edges that made it."""

    frame: DataFrame
    method: str
    by: str | None
    edges: tuple[float, ...] = ()

    @property
    def assigned(self) -> DataFrame:
        return self.frame.where(F.col(SEGMENT).isNotNull())

    def sizes(self) -> DataFrame:
        """Rows and share of each segment, unassigned rows as a null segment."""
        counts = self.frame.groupBy(SEGMENT).agg(F.count("*").alias("n_rows"), F.min("_order").alias("position"))
        total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # over a row for each segment
        return counts.select(SEGMENT, "position", "n_rows", share(F.col("n_rows"), total, 4).alias("share_of_rows"))

    def segment(self, key: str) -> DataFrame:
        return self.frame.where(F.col(SEGMENT) == key)


def _edge(x: float) -> str:
    return f"{x:.6g}"


def _ranges(value: Column, bins: Sequence[tuple[float, float]], closed_first: bool = False) -> tuple[Column, Column]:
    """Label and order of the right-closed interval that holds ``value``."""
    label, order = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (a, b) in reversed(list(enumerate(bins))):
        inside = (value > a) & (value <= b) if not (closed_first and i == 0) else (value >= a) & (value <= b)
        label = F.when(inside, F.lit(f"({_edge(a)}, {_edge(b)}]")).otherwise(label)
        order = F.when(inside, F.lit(float(i))).otherwise(order)
    return label, order


def _check(by: str | None, bins: Sequence[tuple[float, float]] | None, n_bins: int | None, n_quantiles: int | None) -> None:
    chosen = [n for n, v in (("bins", bins), ("n_bins", n_bins), ("n_quantiles", n_quantiles)) if v is not None]
    if len(chosen) > 1:
        raise ValueError(f"choose one of {chosen}")
    if chosen and by is None:
        raise ValueError(f"{chosen[0]} needs a column to cut")
    for name, v in (("n_bins", n_bins), ("n_quantiles", n_quantiles)):
        if v is not None and (isinstance(v, bool) or not isinstance(v, int)):
            raise TypeError(f"{name} must be an integer")
        if v is not None and v < 1:
            raise ValueError(f"{name} must be positive")
    if bins is not None:
        if not bins:
            raise ValueError("bins is empty")
        for i, b in enumerate(bins):
            if len(b) < 2 or not all(map(math.isfinite, b[:2])) or not b[0] < b[1]:
                raise ValueError(f"bins[{i}]: two finite ends with left < right are needed")
        order = sorted((float(b[0]), float(b[1])) for b in bins)
        if any(nxt[0] < own[1] for own, nxt in zip(order, order[1:], strict=False)):
            raise ValueError("bins overlap")


def make_grouping(df: DataFrame, by: str | Column | None = None, *, bins: Sequence[tuple[float, float]] | None = None, n_bins: int | None = None, n_quantiles: int | None = None) -> Grouping:
    """Segments of ``df`` by the values of a column or expression, or by intervals of it.

    Intervals are closed on the right and rows outside of all of them are unassigned. Equal-width intervals
    reach a thousandth of the range below the least value; quantile intervals include it. A constant column has
    one equal-width interval around it and no quantile interval. Only edges pass the driver.
    """
    _check(by if by is None or isinstance(by, str) else "expression", bins, n_bins, n_quantiles)
    if by is None:
        return Grouping(df.withColumn(SEGMENT, F.lit("All")).withColumn("_order", F.lit(0.0)), WHOLE, None)
    column, name = (F.col(f"`{by}`"), by) if isinstance(by, str) else (by, "expression")
    if bins is None and n_bins is None and n_quantiles is None:
        is_number = df.select(column.alias("_c")).schema[0].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
        return Grouping(df.withColumn(SEGMENT, column.cast("string")).withColumn("_order", column.cast("double") if is_number else F.lit(None).cast("double")), BY_VALUE, name)
    value = finite(column)
    if bins is not None:
        pairs = [(float(b[0]), float(b[1])) for b in bins]
        label, order = _ranges(value, pairs)
        return Grouping(df.withColumn(SEGMENT, label).withColumn("_order", order), INTERVALS, name, tuple(x for p in pairs for x in p))
    if n_bins is not None:
        low, high = df.agg(F.min(value), F.max(value)).first()
        if low is None:
            edges = []
        elif low == high:
            pad = 0.001 * abs(low) if low else 0.001
            edges = [low - pad + i * (2 * pad) / n_bins for i in range(n_bins)] + [high + pad]
        else:
            edges = [low + i * (high - low) / n_bins for i in range(n_bins)] + [high]
            edges[0] -= 0.001 * (high - low)
        label, order = _ranges(value, list(zip(edges, edges[1:], strict=False)))
        return Grouping(df.withColumn(SEGMENT, label).withColumn("_order", order), EQUAL_WIDTH, name, tuple(edges))
    row = fq.quantiles_of(df.select(value.alias("value")), ["value"], [i / n_quantiles for i in range(n_quantiles + 1)]).first()
    edges = sorted(set(row["quantiles"])) if row else []
    label, order = _ranges(value, list(zip(edges, edges[1:], strict=False)), closed_first=True)
    return Grouping(df.withColumn(SEGMENT, label).withColumn("_order", order), QUANTILE, name, tuple(edges))
