"""Pearson, Spearman and Kendall correlation of pairs of numeric columns.

Results are long: a row for each pair (upper triangle), null where undefined. All three leave out rows in
which either column is missing, pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kinds
from ..functions.numbers import as_double
from ..scratch import Scratch
from . import frequency as fq
from . import moments, ranks

METHODS = ("pearson", "spearman", "kendall")
#: Pairs whose sums are aggregates of one plan.
PAIRS_IN_A_PASS = 150
#: Distinct values of a column up to which their ranks are broadcast, and combinations of two columns' values up to which they are counted.
BROADCAST_VALUES = 1 << 16
#: Rows of one group of Kendall's tau, and ranges that a larger one is split into.
ONE_GROUP, FAN = 1 << 20, 400


def _pairs(df: DataFrame, columns: Sequence[str] | None, keys: Sequence[str]) -> list[tuple[int, str, int, str]]:
    names = kinds.columns_of(df, kinds.NUMERIC, [c for c in (columns or df.columns) if c not in keys])
    return [(i, a, j, b) for (i, a), (j, b) in combinations(enumerate(names), 2)]


def _label(pair: tuple[int, str, int, str]) -> list[Column]:
    i, a, j, b = pair
    return [F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.lit(i).alias("position_1"), F.lit(j).alias("position_2")]


def _clipped(r: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))


def pearson(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One pass over the rows for any number of columns; a constant side or an infinite value gives null.

    Up to ``PAIRS_IN_A_PASS`` pairs are aggregates of one plan, more are matrices of moments.
    """
    pairs = _pairs(df, columns, keys)
    if not pairs:
        raise ValueError("fewer than two numeric columns")
    if len(pairs) > PAIRS_IN_A_PASS:
        names = kinds.columns_of(df, kinds.NUMERIC, [c for c in (columns or df.columns) if c not in keys])
        return moments.pearson(df, names, keys)
    return _covariances(df, [(p, as_double(F.col(f"`{p[1]}`")), as_double(F.col(f"`{p[3]}`"))) for p in pairs], keys)


def _covariances(df: DataFrame, pairs: Sequence[tuple[tuple[int, str, int, str], Column, Column]], keys: Sequence[str]) -> DataFrame:
    """Pearson's r of pairs of expressions, as aggregates of one pass."""
    sums = []
    for k, (_, x, y) in enumerate(pairs):
        sums += [F.covar_pop(x, y).alias(f"c{k}"), F.stddev_pop(F.when(y.isNotNull(), x)).alias(f"x{k}"), F.stddev_pop(F.when(x.isNotNull(), y)).alias(f"y{k}"), F.count(x + y).alias(f"n{k}")]
    wide = df.groupBy(*keys).agg(*sums)

    def r(k: int) -> Column:
        found = F.col(f"c{k}") / F.nullif(F.col(f"x{k}") * F.col(f"y{k}"), F.lit(0.0))
        return F.when((F.col(f"n{k}") > 1) & (F.col(f"x{k}") * F.col(f"y{k}") > 0) & ~F.isnan(found), _clipped(found))

    return wide.select(*keys, F.inline(F.array(*[F.struct(*_label(p), r(k).alias("r")) for k, (p, _, _) in enumerate(pairs)])))


def pair_frequencies(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """How often each pair of values of each pair of columns occurs in rows that have both."""
    pairs = _pairs(df, columns, keys)
    if not pairs:
        raise ValueError("fewer than two numeric columns")
    cells = F.array(*[F.struct(*_label(p), as_double(F.col(f"`{p[1]}`")).alias("x"), as_double(F.col(f"`{p[3]}`")).alias("y")) for p in pairs])
    return df.select(*keys, F.inline(cells)).where("x is not null and y is not null").groupBy(*keys, "feature_1", "feature_2", "position_1", "position_2", "x", "y").agg(F.count("*").alias("n"))


def _positions(df: DataFrame, names: Sequence[str], keys: Sequence[str], scratch: Scratch) -> DataFrame:
    """``keys`` as they are and as text ``grp``, the columns as doubles, and each row's ``pos``: a table, so that positions stay."""
    grp = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("")
    return scratch.table(df.select(*[F.col(f"`{k}`") for k in keys], grp.alias("grp"), *[as_double(F.col(f"`{c}`")).alias(f"_v{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("pos")), "positions")


def _cells(table: DataFrame, values: Sequence[Column]) -> DataFrame:
    own = F.array(*[F.struct(F.lit(g).alias("g"), v.alias("value")) for g, v in enumerate(values)])
    return table.select("pos", "grp", F.inline(own)).where("value is not null")


def _ranked(df: DataFrame, names: Sequence[str], keys: Sequence[str], distinct: Sequence[int], scratch: Scratch) -> DataFrame:
    """Each value's average rank in its column, of columns without missing values.

    Ranks of a column of at most ``BROADCAST_VALUES`` values (``distinct`` has their numbers) are broadcast. Others come
    from places in a sort and are brought back to their rows by position.
    """
    few = [i for i in range(len(names)) if distinct[i] <= BROADCAST_VALUES]
    many = [i for i in range(len(names)) if i not in few]
    out = df.select(*[F.col(f"`{k}`") for k in keys], *[as_double(F.col(f"`{c}`")).alias(f"_v{i}") for i, c in enumerate(names)])
    if many:
        table = _positions(df, names, keys, scratch)
        ranked = ranks.average(_cells(table, [F.col(f"_v{i}") for i in many]), scratch)
        wide = ranked.groupBy("pos").agg(*[F.max(F.when(F.col("g") == g, F.col("rank"))).alias(f"_r{i}") for g, i in enumerate(many)])
        out = table.drop("grp").join(wide, "pos") if few or keys else wide
    for i in few:
        own = fq.running(fq.frequencies(fq.long_numbers(df, [names[i]], keys), keys), [*keys, "feature"], ["n"])
        mine = own.select(*[F.col(f"`{k}`").alias(f"_k{j}") for j, k in enumerate(keys)], F.col("value").alias("_value"), (F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)).alias(f"_r{i}"))
        same = F.col(f"_v{i}") == F.col("_value")
        for j, k in enumerate(keys):
            same &= F.col(f"`{k}`").eqNullSafe(F.col(f"_k{j}"))
        out = out.join(F.broadcast(mine), same).drop("_value", *[f"_k{j}" for j in range(len(keys))])
    return out.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"_r{i}").alias(c) for i, c in enumerate(names)])


def _counted_ranks(df: DataFrame, pairs: Sequence[tuple[int, str, int, str]], keys: Sequence[str]) -> DataFrame:
    """Spearman's r of pairs with few combinations of values, from how often each occurs: one pass, and no row is moved.

    Combinations with a missing side are counted too, as nothing, so that groups without complete rows have theirs.
    """
    own = [f"_k{j}" for j in range(len(keys))]
    cells = F.array(*[F.struct(F.lit(k).alias("_pair"), as_double(F.col(f"`{p[1]}`")).alias("x"), as_double(F.col(f"`{p[3]}`")).alias("y")) for k, p in enumerate(pairs)])
    freq = df.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, own, strict=True)], F.inline(cells)).groupBy(*own, "_pair", "x", "y").agg(F.count("*").alias("n"))
    group = [*own, "_pair"]
    freq = freq.withColumn("n", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("n")).otherwise(0))

    def rank(c: str) -> Column:
        return F.sum("n").over(Window.partitionBy(*group).orderBy(c)) - (F.sum("n").over(Window.partitionBy(*group, c)) - 1) / F.lit(2.0)

    total = F.sum("n").over(Window.partitionBy(*group))
    away = freq.select(*group, "n", *[(rank(c) - (total + 1) / F.lit(2.0)).alias(c) for c in ("x", "y")])
    sums = away.groupBy(*group).agg(*[F.sum(F.col("n") * F.col(a) * F.col(b)).alias(a + b) for a, b in ("xy", "xx", "yy")])
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), _clipped(F.col("xy") / F.sqrt("xx") / F.sqrt("yy")))
    label = F.get(F.array(*[F.struct(*_label(p)) for p in pairs]), F.col("_pair"))
    return sums.select(*[F.col(a).alias(k) for k, a in zip(keys, own, strict=True)], label.alias("_label"), r.alias("r")).select(*[F.col(f"`{k}`") for k in keys], "_label.*", "r")


def spearman(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks, ranked within the complete rows of each pair.

    A column has the same ranks in all pairs whose other column has no missing values; one row of counts tells.
    For each other column with missing values it is ranked once more, among the rows that have both. All of them
    are ranked together in one sort and brought back to their rows in one shuffle. Pairs with at most
    ``BROADCAST_VALUES`` combinations of values are counted instead, unless all columns are ranked anyway.
    """
    pairs = _pairs(df, columns, keys)
    if not pairs:
        raise ValueError("fewer than two numeric columns")
    names = kinds.columns_of(df, kinds.NUMERIC, [c for c in (columns or df.columns) if c not in keys])
    scratch = Scratch(df.sparkSession, "spearman")
    values = [as_double(F.col(f"`{c}`")) for c in names]
    distinct = [F.approx_count_distinct(F.struct(*[F.col(f"`{k}`").alias(f"k{j}") for j, k in enumerate(keys)], v.alias("v"))) for v in values]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)], *[d.alias(f"d{i}") for i, d in enumerate(distinct)]).first()
    gaps = {i for i in range(len(names)) if counts[f"n{i}"] < counts["rows"]}
    rest = [p for p in pairs if counts[f"d{p[0]}"] * counts[f"d{p[2]}"] > BROADCAST_VALUES]
    counted = [p for p in pairs if p not in rest] if counts["rows"] and (gaps or not rest) and BROADCAST_VALUES else []
    out = _counted_ranks(df, counted, keys) if counted else None
    pairs = [p for p in pairs if p not in counted]
    if not pairs:
        return out
    if not gaps:
        return pearson(_ranked(df, names, keys, [counts[f"d{i}"] for i in range(len(names))], scratch), names, keys)
    table = _positions(df, names, keys, scratch)
    # a column, and the other one that its rows must have
    groups = list(dict.fromkeys((x, y if y in gaps else None) for i, _, j, _ in pairs for x, y in ((i, j), (j, i))))
    cells = _cells(table, [F.col(f"_v{x}") if y is None else F.when(F.col(f"_v{y}").isNotNull(), F.col(f"_v{x}")) for x, y in groups])
    wide = ranks.average(cells, scratch).groupBy("pos").agg(*[F.max(F.when(F.col("g") == g, F.col("rank"))).alias(f"_r{g}") for g in range(len(groups))])
    wide = scratch.table(table.select(*[F.col(f"`{k}`") for k in keys], "pos").join(wide, "pos") if keys else wide, "ranks")
    at = {group: F.col(f"_r{g}") for g, group in enumerate(groups)}
    for lo in range(0, len(pairs), PAIRS_IN_A_PASS):
        own = [(p, at[i, j if j in gaps else None], at[j, i if i in gaps else None]) for p in pairs[lo : lo + PAIRS_IN_A_PASS] for i, _, j, _ in [p]]
        rows = _covariances(wide, own, keys)
        out = rows if out is None else out.unionByName(rows)
    return out


def _concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Concordant less discordant weighted pairs.

    Rows are merged bottom-up in order of x: in each step the weights of the left half below and above each y of
    the right half come from running sums, so the work is n log(n)^2.
    """
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order].astype(np.float64)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    parts = [(y[a:b], n[a:b]) for a, b in zip(starts, np.append(starts[1:], len(y)), strict=True)]
    total = 0.0
    while len(parts) > 1:
        merged = []
        for k in range(0, len(parts) - 1, 2):
            (ya, na), (yb, nb) = parts[k], parts[k + 1]
            sums = np.concatenate(([0.0], np.cumsum(na)))
            below, upto = sums[np.searchsorted(ya, yb, "left")], sums[np.searchsorted(ya, yb, "right")]
            total += float((nb * (below - (sums[-1] - upto))).sum())
            y_all, n_all = np.concatenate((ya, yb)), np.concatenate((na, nb))
            o = np.argsort(y_all, kind="stable")
            merged.append((y_all[o], n_all[o]))
        if len(parts) % 2:
            merged.append(parts[-1])
        parts = merged
    return total


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"gid": rows["gid"].iloc[:1], "s": _concordance(*(rows[c].to_numpy() for c in ("x", "y", "n")))})


def _place(c: str, cuts: str, fan: int) -> Column:
    """Twice the number of ``cuts`` below the value, and one more if it is a cut itself."""
    below = fq.below(c, cuts, fan)
    return below * 2 + F.coalesce((F.get(F.col(cuts), below) == F.col(c)).cast("int"), F.lit(0))


def _split(points: DataFrame, scratch: Scratch, fan: int, first: bool) -> DataFrame:
    """``points`` (gid, path, x, y, n) in groups (gid, path) of at most ``ONE_GROUP`` rows whose pairs are those of the whole.

    The values of x and of y of a larger group are cut into ``fan`` ranges, and values that are cuts are ranges of
    their own, found by binary search. A pair of rows stands in one range of x; or in one of y but not of x, where
    only the range of x counts; or in neither, and then the frequencies of pairs of ranges have it. These three are
    groups of their own, and are cut again while they are too large. Rows of one value tie, so a value's own range
    has no pairs, however many rows it has.
    """
    done, step = None, 0
    while True:
        sizes = points.groupBy("gid", "path").agg(F.count("*").alias("rows"))
        large = scratch.table(sizes.where(F.lit(True) if first and not step else F.col("rows") > ONE_GROUP).select("gid", "path"), f"large-{step}")
        small = points.join(large, ["gid", "path"], "left_anti") if step or not first else None
        if small is not None:
            done = small if done is None else done.union(small)
        if large.isEmpty():
            return done
        shares = [i / fan for i in range(1, fan)]
        cuts = scratch.table(points.join(large, ["gid", "path"]).groupBy("gid", "path").agg(*[F.array_distinct(F.percentile_approx(c, shares, 10 * fan)).alias(f"_{c}") for c in ("x", "y")]), f"cuts-{step}")
        cut = scratch.table(points.join(cuts, ["gid", "path"]).select("gid", "path", "x", "y", "n", *[_place(c, f"_{c}", fan).alias(f"b{c}") for c in ("x", "y")]), f"cut-{step}")
        bx, by = F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y")
        own = cut.where("bx % 2 = 0").select("gid", F.concat("path", F.lit("/x"), "bx").alias("path"), "x", "y", "n")
        beside = cut.where("by % 2 = 0").groupBy("gid", "path", "by", "bx", "y").agg(F.sum("n").alias("n")).select("gid", F.concat("path", F.lit("/y"), "by").alias("path"), bx, "y", "n")
        coarse = cut.groupBy("gid", "path", "bx", "by").agg(F.sum("n").alias("n")).select("gid", F.concat("path", F.lit("/c")).alias("path"), bx, by, "n")
        points, step = scratch.table(own.union(beside).union(coarse), f"points-{step}"), step + 1


def kendall(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), *, blocks: int | None = None) -> DataFrame:
    """Kendall's tau-b with ties.

    Of up to ``ONE_GROUP`` rows each pair of columns is one group; of more it is split until each group has at most as many.
    Each split by ``FAN`` ranges takes two or three times the rows before, and a few of them do for any table: a table of
    FAN^k times ``ONE_GROUP`` rows takes about k. ``blocks`` splits smaller tables too, into that many ranges.
    """
    group = [*keys, "feature_1", "feature_2", "position_1", "position_2"]
    grp = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("")
    table = pair_frequencies(df, columns, keys).withColumn("gid", F.concat_ws("/", "position_1", "position_2", grp))
    if blocks is None:
        blocks = 1 if df.count() <= ONE_GROUP else min(FAN, (math.isqrt(ONE_GROUP) + 1) // 2)  # so that a group is larger than the frequencies of pairs of ranges
        first = False
    else:
        first = True
    scratch = Scratch(df.sparkSession, "kendall") if blocks > 1 else None
    if scratch is not None:
        table = scratch.table(table, "pairs")
    ties = []
    for side in ("x", "y"):
        own = table.groupBy("gid", side).agg(F.sum(F.col("n").cast("double")).alias("m"))
        ties.append(own.groupBy("gid").agg(F.sum(F.col("m") * F.col("m")).alias(f"t{side}")))
    total = table.groupBy("gid").agg(F.sum(F.col("n").cast("double")).alias("total"), *[F.first(f"`{c}`").alias(c) for c in group])
    points = table.select("gid", F.lit("").alias("path"), "x", "y", "n")
    if scratch is not None:
        points = _split(points, scratch, blocks, first)
    parts = points.groupBy("gid", "path").applyInPandas(_counted, "gid string, s double")
    sums = parts.groupBy("gid").agg(F.sum("s").alias("s")).join(total, "gid").join(ties[0], "gid").join(ties[1], "gid")
    n2 = F.col("total") * F.col("total")
    return sums.select(*[F.col(f"`{c}`") for c in group], (2 * F.col("s") / F.nullif(F.sqrt(n2 - F.col("tx")) * F.sqrt(n2 - F.col("ty")), F.lit(0.0))).alias("r"))


def correlate(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    found = {"pearson": pearson, "spearman": spearman, "kendall": kendall}.get(method.lower())
    if found is None:
        raise ValueError(f"unknown correlation method {method!r}; known: {METHODS}")
    return found(df, columns, keys)


def correlate_all(df: DataFrame, methods: Sequence[str] = METHODS, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Several methods, each once, in one long table with ``method``."""
    parts = [correlate(df, m, columns, keys).withColumn("method", F.lit(m)) for m in dict.fromkeys(m.lower() for m in methods)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matrix(pairs: DataFrame, keys: Sequence[str] = (), *, constant_diagonal: bool = False) -> DataFrame:
    """The square matrix of long pairs.

    The diagonal is 1 for columns that correlate with any other; a constant column has none under Pearson and
    Spearman, and 1 under Kendall (``constant_diagonal``).
    """
    swapped = pairs.select(*keys, F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), F.col("position_2").alias("position_1"), F.col("position_1").alias("position_2"), "r")
    both = pairs.select(*swapped.columns).union(swapped)
    own = both.groupBy(*keys, "feature_1", "position_1").agg((F.lit(1.0) if constant_diagonal else F.max(F.when(F.col("r").isNotNull(), 1.0))).alias("r")).select(*keys, "feature_1", F.col("feature_1").alias("feature_2"), "position_1", F.col("position_1").alias("position_2"), "r")
    return both.union(own).groupBy(*keys, F.col("feature_1").alias("feature"), F.col("position_1").alias("position")).pivot("feature_2").agg(F.first("r")).orderBy("position")


def top_pairs(pairs: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Defined pairs beyond ``threshold`` (strictly), with their absolute correlation."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be within 0 and 1")
    return pairs.where(F.abs("r") > threshold).withColumn("abs_r", F.abs("r"))


def compare(pairs: DataFrame, segment: str, values: Sequence[str], *, min_abs: float = 0.0) -> DataFrame:
    """Pairs by segment as columns, with the largest difference between segments."""
    wide = pairs.groupBy("feature_1", "feature_2", "position_1", "position_2").pivot(segment, list(values)).agg(F.first("r"))
    cells = [F.col(f"`{v}`") for v in values]
    spread = F.array_max(F.array(*cells)) - F.array_min(F.array(*cells))
    return wide.withColumn("max_abs_difference", spread).where(F.array_max(F.array(*[F.abs(c) for c in cells])) > min_abs)

