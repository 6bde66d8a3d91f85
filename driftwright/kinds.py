"""What kind of statistics a column gets, from its type alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, OTHER = "numeric", "categorical", "other"


def kind(data_type: T.DataType) -> str:
    """Numbers are numeric, text and booleans categorical; dates and nested values are neither."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    return CATEGORICAL if isinstance(data_type, (T.StringType, T.BooleanType)) else OTHER


def unique_columns(df: DataFrame) -> list[str]:
    """The columns of ``df``; duplicate names are an error."""
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate column names: {twice}")
    return df.columns


def columns_of(df: DataFrame, wanted: str, among: Sequence[str] | None = None) -> list[str]:
    """Columns of one kind, in order and each once."""
    kinds = {f.name: kind(f.dataType) for f in df.schema}
    names = dict.fromkeys(among if among is not None else unique_columns(df))
    missing = [c for c in names if c not in kinds]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return [c for c in names if kinds[c] == wanted]


def drift_kind(data_type: T.DataType) -> str:
    """For drift every column that isn't a number is categorical, dates included."""
    return NUMERIC if isinstance(data_type, T.NumericType) else CATEGORICAL
