"""Preparation of tables: stacking, one-hot collapse, sampling, type summaries and fingerprints."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kinds
from ..operators import frequency as fq
from ..scratch import Scratch

#: Most distinct values, and largest share of rows, of text that is worth encoding as categories.
MOST_LEVELS, MOST_SHARE = 10_000, 0.5
#: Rows are counted in ``2**RANGE_BITS`` ranges of their hash to find a sample's threshold.
RANGE_BITS = 14
#: Copies of a row that are made at once.
COPIES = 10_000


def combine(tables: Mapping[str, DataFrame], tag: str = "Dataset") -> DataFrame:
    """Stack tables by column name, with the origin of each row in ``tag``; missing columns are null."""
    if not tables:
        raise ValueError("no tables")
    labels = [str(k) for k in tables]
    if len(set(labels)) < len(labels):
        raise ValueError("labels collide as text")
    if any(tag in t.columns for t in tables.values()):
        raise ValueError(f"{tag!r} is a column already")
    parts = [t.withColumn(tag, F.lit(label)) for label, t in zip(labels, tables.values(), strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """One snapshot of several tables."""
    if not parts:
        raise ValueError("a snapshot without tables")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dummy_groups(columns: Sequence[str], features: str | Sequence[str] | Mapping[str, Sequence[str]] = "auto", separator: str = "__") -> dict[str, list[str]]:
    """Which columns are the dummies of which feature: by the last separator, by feature names, or as given."""
    if isinstance(features, Mapping):
        return {f: [c for c in own if c in columns] for f, own in features.items()}
    if isinstance(features, str):
        if features.lower() != "auto":
            raise TypeError("features must be 'auto', names or a mapping")
        found: dict[str, list[str]] = {}
        for c in columns:
            at = c.rfind(separator)
            if at > 0:
                found.setdefault(c[:at], []).append(c)
        return found
    return {f: [c for c in columns if c.startswith(f"{f}{separator}")] or [c for c in columns if f in c] for f in features}


def collapse_one_hot(df: DataFrame, features: str | Sequence[str] | Mapping[str, Sequence[str]] = "auto", *, separator: str = "__", all_zero: str = "first", strip_prefix: bool = False) -> DataFrame:
    """Replace each group of at least two dummies by one text column at the place of the first.

    The largest dummy wins, the first of equals. Rows without any value are null; rows whose dummies are all
    zero give the first dummy (``all_zero="first"``) or null (``"null"``, where text is read as numbers too).
    """
    if all_zero not in ("first", "null"):
        raise ValueError(f"all_zero: {all_zero!r}")
    groups = {f: own for f, own in dummy_groups(df.columns, features, separator).items() if len(own) > 1}
    used = [c for own in groups.values() for c in own]
    if len(set(used)) < len(used):
        raise ValueError("a column belongs to two groups")
    types = {f.name: f.dataType for f in df.schema}
    out, at = [], {own[0]: (f, own) for f, own in groups.items()}
    for c in df.columns:
        if c not in used:
            out.append(F.col(f"`{c}`"))
        elif c in at:
            f, own = at[c]
            if f in df.columns and f not in own:
                raise ValueError(f"{f!r} is a column already")
            if all_zero == "first" and not all(isinstance(types[d], (T.NumericType, T.BooleanType)) for d in own):
                raise TypeError(f"the dummies of {f!r} must be numbers or booleans")
            values = [F.col(f"`{d}`").cast("int").cast("double") if isinstance(types[d], T.BooleanType) else F.col(f"`{d}`").try_cast("double") for d in own]
            best = F.greatest(*values)
            winner = F.lit(None).cast("string")
            for d, v in reversed(list(zip(own, values, strict=True))):
                winner = F.when(v == best, F.lit(d.removeprefix(f"{f}{separator}") if strip_prefix else d)).otherwise(winner)
            out.append((F.when(best > 0, winner) if all_zero == "null" else winner).alias(f))
    return df.select(*out)


def _split(seed: int):
    """In which ranges the copies of each repeated row lie: independent places, drawn from the row's hash, so anew the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, unsigned = 1 << RANGE_BITS, (1 << 64) - 1
        for b in batches:
            at, bins, copies = [], [], []
            for i, (row, other, times) in enumerate(zip(*(b[c].to_pylist() for c in ("_row", "_other", "_times")), strict=True)):
                draw = np.random.default_rng([seed & unsigned, row & unsigned, other & unsigned])
                n = np.bincount(draw.integers(0, ranges, times), minlength=ranges) if times <= ranges else draw.multinomial(times, np.full(ranges, 1 / ranges))
                own = np.flatnonzero(n)
                at.append(np.full(len(own), i))
                bins.append(own)
                copies.append(n[own])
                if sum(map(len, at)) > 100_000:
                    yield _taken(b, at, bins, copies)
                    at, bins, copies = [], [], []
            if at:
                yield _taken(b, at, bins, copies)

    return run


def _taken(b: pa.RecordBatch, at: list[np.ndarray], bins: list[np.ndarray], copies: list[np.ndarray]) -> pa.RecordBatch:
    rows = b.take(pa.array(np.concatenate(at)))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(bins).astype(np.int32)), pa.array(np.concatenate(copies).astype(np.int64))], [*rows.schema.names, "_bin", "_copies"])


def sample(df: DataFrame, *, percent: float | None = None, rows: int | None = None, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """An exact number of rows, of the table or of each group of ``by``: percent of them (at least one) or ``rows``.

    A seeded hash of all their columns orders rows. Repeated rows, found by counting hashes of 128 bits, are sampled one
    by one: how many copies lie in each range of the hash is drawn with a seed from the hash, and the result has as many
    copies of the row. So the sample is a function of the table's rows alone, whatever its partitions are, and a
    retried task finds the same again.

    The threshold that leaves the wanted number is found from counts of hash ranges; only rows in the range of the
    threshold are ranked, so no task sorts all rows of a group, and many copies of a row are made in parts.
    """
    if (percent is None) == (rows is None):
        raise ValueError("give percent or rows")
    if percent is not None and not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    if percent == 100:
        return df
    cells = []
    for f in df.schema:  # nulls leave no trace in a hash, so they are hashed as such
        c = F.col(f"`{f.name}`")
        cells += [c.isNull(), F.to_json(F.struct(c.alias("v"))) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else c]
    group = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    keys = [F.col(f"`{c}`").alias(g) for c, g in zip(by, group, strict=False)] or [F.lit(0).alias("_g0")]
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_kept"), *keys, F.xxhash64(F.lit(seed), *cells).alias("_row"), F.xxhash64(F.lit(~seed), *cells).alias("_other"))
    bin_ = F.shiftrightunsigned("_row", 64 - RANGE_BITS).cast("int").alias("_bin")
    name = ["_row", "_other"]
    scratch = Scratch(df.sparkSession, "sample")
    alone, copies = marked, None
    # eight bytes a row tell whether any may repeat
    if not marked.groupBy("_row").agg(F.count("*").alias("_times")).where("_times > 1").isEmpty():
        repeated = scratch.table(marked.groupBy(*name).agg(F.count("*").alias("_times"), *[F.first(g).alias(g) for g in group]).where("_times > 1"), "repeated")
        flagged = marked.join(repeated.select(*name, F.lit(True).alias("_again")), name, "left")
        alone = flagged.where("_again is null").drop("_again")
        copies = scratch.table(repeated.mapInArrow(_split(seed), T.StructType([*repeated.schema, T.StructField("_bin", T.IntegerType()), T.StructField("_copies", T.LongType())])), "copies")
    counts = alone.select(*group, bin_).groupBy(*group, "_bin").agg(F.count("*").alias("_n"))  # at most a row for each range and group
    if copies is not None:
        counts = counts.union(copies.groupBy(*group, "_bin").agg(F.sum("_copies"))).groupBy(*group, "_bin").agg(F.sum("_n").alias("_n"))
    everything = F.sum("_n").over(Window.partitionBy(*group))
    # half to even, as the size is defined
    wanted = F.least(everything, F.lit(rows)) if rows is not None else F.greatest(F.lit(1), F.bround(everything * (percent / 100.0), 0).cast("long"))
    cum = counts.withColumns({"_cum": F.sum("_n").over(Window.partitionBy(*group).orderBy("_bin")), "_wanted": wanted})
    before = F.col("_cum") - F.col("_n")
    edge = cum.where((F.col("_cum") >= F.col("_wanted")) & (before < F.col("_wanted"))).select(*group, F.col("_bin").alias("_edge"), (F.col("_wanted") - before).alias("_rest"))
    edge = scratch.table(edge, "edge") if by or copies is not None else edge
    edge = edge if by else F.broadcast(edge)  # a row for each group
    placed = fq.joined(alone.select("*", bin_), edge, group)
    near = placed.where("_bin = _edge").select(*group, "_rest", F.col("_row").alias("_order"), *name, F.lit(False).alias("_again"), "_kept")
    if copies is not None:
        drawn = fq.joined(copies, edge, group)
        parts = drawn.where("_bin = _edge").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        near = near.union(parts.select(*group, "_rest", F.xxhash64(*name, "_i"), *name, F.lit(True), F.lit(None).cast(marked.schema["_kept"].dataType)))
    last = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_order", *name))).where("_rank <= _rest")
    if copies is None:
        return placed.where("_bin < _edge").select("_kept.*").union(last.select("_kept.*"))
    last = scratch.table(last.select(*name, "_again", "_kept"), "last")
    out = placed.where("_bin < _edge").select("_kept").union(last.where("not _again").select("_kept"))
    n = drawn.where("_bin < _edge").select(*name, F.col("_copies").alias("_n")).union(last.where("_again").select(*name, F.lit(1).cast("long"))).groupBy(*name).agg(F.sum("_n").alias("_n"))
    each = flagged.where("_again").groupBy(*name).agg(F.first("_kept").alias("_kept")).join(n, name)
    chunks = each.select("_kept", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))).alias("_from")).repartition("_from")
    made = chunks.select("_kept", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col("_n")) - 1)).alias("_i")).select("_kept")
    return out.union(made).select("_kept.*")


def dtype_summary(df: DataFrame) -> DataFrame:
    """Number of columns of each type, and the optimizer's estimate of the size is ``estimated_bytes``."""
    rows: dict[str, int] = {}
    for _, t in df.dtypes:
        rows[t] = rows.get(t, 0) + 1
    return df.sparkSession.createDataFrame(sorted(rows.items()), "data_type string, n_columns long")


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def narrow_types(df: DataFrame) -> DataFrame:
    """Range and narrowest lossless type of each integer column."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    if not names:
        raise ValueError("no integer columns")
    wide = df.agg(*[x for i, c in enumerate(names) for x in (F.min(f"`{c}`").cast("long").alias(f"l{i}"), F.max(f"`{c}`").cast("long").alias(f"h{i}"))])
    types = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(types[c]).alias("data_type"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, c in enumerate(names)])
    fits = lambda bits: (F.col("min") >= -(2 ** (bits - 1))) & (F.col("max") <= 2 ** (bits - 1) - 1)
    return wide.select(F.inline(cells)).withColumn("narrowest", F.when(fits(8), "tinyint").when(fits(16), "smallint").when(fits(32), "int").otherwise("bigint"))


def narrowed(df: DataFrame) -> DataFrame:
    """``df`` with its integers cast to the narrowest lossless types."""
    to = {r["feature"]: r["narrowest"] for r in narrow_types(df).collect()}
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in to.items()})


def category_candidates(df: DataFrame) -> DataFrame:
    """Text columns of few distinct values, which would be stored as categories."""
    names = kinds.columns_of(df, kinds.CATEGORICAL)
    wide = df.agg(F.count("*").alias("n"), *[F.count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"d{i}").alias("n_unique")) for i, c in enumerate(names)])
    return wide.select("n", F.inline(cells)).where((F.col("n_unique") <= MOST_LEVELS) & (F.col("n_unique") <= F.col("n") * MOST_SHARE)).drop("n")


def shared_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Which columns two tables share, which only one has, and which differ in type."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    rows = [(c, "shared" if a.get(c) == b.get(c) else "left only" if c not in b else "right only" if c not in a else "different types") for c in dict.fromkeys([*a, *b])]
    return left.sparkSession.createDataFrame(rows, "column_name string, status string")


def fingerprint(df: DataFrame) -> DataFrame:
    """Number of rows and an order-free hash of their content."""
    return df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")).agg(F.count("*").alias("n_rows"), F.lower(F.hex(F.bit_xor("h"))).alias("content_xor"), F.lower(F.hex(F.sum(F.col("h").cast("decimal(38,0)")).cast("string"))).alias("content_sum"))
