"""Delimited text as typed tables."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lines, prepare

DELIMITERS = (",", ";", "\t", "|")
#: Texts that stand for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass(frozen=True)
class LoadedTable:
    """A table and where it is from."""

    frame: DataFrame
    source: str
    delimiter: str
    token: str
    original_types: Mapping[str, str]
    narrowed_types: Mapping[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.frame.columns


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The delimiter of some first lines; failing that, the one most frequent in the header, or a comma."""
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        header = lines[0] if lines else ""
        best = max(DELIMITERS, key=header.count)
        return best if header.count(best) else ","


def content_token(spark: SparkSession, path: str) -> str:
    """The size and an ordered fingerprint of a file's content, equal for equal content at any path and for its bytes (``lines.fingerprint_of``)."""
    return lines.fingerprint(spark, path)


def _quoted(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """A table of texts from files whose quoted fields hold line breaks; each file has the header."""
    own = lines.records(spark, path, delimiter)
    header = F.col("start") + F.col("at") == 0
    first = own.where(header).orderBy("file").first()
    names = next(csv.reader([first["value"].removeprefix("\ufeff")], delimiter=delimiter)) if first else []
    schema = T.StructType([T.StructField(c or f"_c{i}", T.StringType()) for i, c in enumerate(names)])
    if len(set(names)) < len(names):
        raise ValueError("duplicate column names")
    rows = own.where(~header & (F.trim("value") != ""))
    return rows.select(F.from_csv("value", schema.toDDL(), {"sep": delimiter, "escape": '"', "multiLine": "true"}).alias("row")).select("row.*")


def _typed(raw: DataFrame) -> DataFrame:
    """Texts as the narrowest of boolean, bigint, double and string that all values of a column have; one pass."""
    clean = raw.select([F.when(~F.trim(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    sums = []
    for i, c in enumerate(raw.columns):
        t = F.trim(f"`{c}`")
        sums += [F.count(t).alias(f"n{i}"), F.count(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))).alias(f"i{i}"), F.count(t.try_cast("double")).alias(f"d{i}"), F.count_if(F.lower(t).isin("true", "false")).alias(f"b{i}")]
    counts = clean.agg(*sums).first()
    out = []
    for i, c in enumerate(raw.columns):
        n, kind = counts[f"n{i}"], "string"
        for key, name in (("b", "boolean"), ("i", "bigint"), ("d", "double")):
            if n and counts[f"{key}{i}"] == n:
                kind = name
                break
        out.append((F.trim(f"`{c}`").cast(kind) if kind != "string" else F.col(f"`{c}`")).alias(c) if n else F.col(f"`{c}`").cast("double").alias(c))
    return clean.select(out)


def load_table(spark: SparkSession, path: str, *, delimiter: str | None = None, optimize: bool = True) -> LoadedTable:
    """Read delimited text with a header line. Types and missing values are found over all rows.

    Quoted fields may hold line breaks: where a line has an odd number of quotes, records are put together from lines
    (``lines.records``). Files are read in splits either way.
    """
    if delimiter is not None and len(delimiter) != 1:
        raise ValueError("the delimiter must be one character")
    if delimiter is None:
        delimiter = sniff_delimiter([r["value"] for r in spark.read.text(path).limit(20).collect()])
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = _quoted(spark, path, delimiter) if broken else spark.read.csv(path, sep=delimiter, header=True, inferSchema=False, escape='"')
    if len(set(raw.columns)) < len(raw.columns):
        raise ValueError("duplicate column names")
    frame = _typed(raw)
    types, narrow = dict(frame.dtypes), {}
    if optimize and any(t == "bigint" for t in types.values()):
        frame = prepare.narrowed(frame)
        narrow = {c: t for c, t in frame.dtypes if types[c] != t}
    return LoadedTable(frame, path.rstrip("/").rsplit("/", 1)[-1], delimiter, content_token(spark, path), types, narrow)


def as_frame(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A table as it is, or read from a Parquet or delimited file."""
    if isinstance(source, str):
        return spark.read.parquet(source) if source.rstrip("/").endswith(".parquet") else load_table(spark, source, optimize=False).frame
    return source
