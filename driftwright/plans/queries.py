"""The registered queries over the test tables, each with SQL that says the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeperiods as tp
from ..operators import correlate, describe, distribute, drift, segment, trends
from ..operators import frequency as fq
from ..scratch import Scratch
from ..sources import prepare
from . import assessment, cache, profiling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


# --- sources -----------------------------------------------------------------------------------------------

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
GAPS = "SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0.08) AS l_tax) FROM lineitem"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing values, of which the tables have none."""
    return read(spark, sf_dir, "lineitem").withColumns({"l_discount": F.nullif("l_discount", F.lit(0.0)), "l_tax": F.nullif("l_tax", F.lit(0.08))})


@query("SELECT data_type, count(*)::BIGINT AS n_columns FROM (VALUES ('bigint'), ('bigint'), ('bigint'), ('int'), ('double'), ('double'), ('double'), ('double'), ('string'), ('string'), ('timestamp_ntz')) t(data_type) GROUP BY 1")
def dtype_summary(spark, sf_dir):
    return prepare.dtype_summary(read(spark, sf_dir, "lineitem"))


_NARROW = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}


@query(union([f"SELECT '{c}' AS feature, '{t}' AS data_type, min({c})::BIGINT AS min, max({c})::BIGINT AS max, CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS narrowest FROM lineitem" for c, t in _NARROW.items()]))
def narrow_types(spark, sf_dir):
    return prepare.narrow_types(read(spark, sf_dir, "lineitem"))


@query("SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS market, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL, s_name FROM supplier")
def combine_tagged(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("market"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return prepare.combine({"customer": c, "supplier": s}, tag="source")


def _dummies(spark, sf_dir, separator):
    c = read(spark, sf_dir, "customer")
    kinds = ("AUTOMOBILE", "BUILDING", "FURNITURE")
    return c.select("c_custkey", *[F.when(F.col("c_custkey") % 7 != 0, (F.col("c_mktsegment") == k).cast("double")).alias(f"segment{separator}{k.lower()}") for k in kinds])


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'segment__' || lower(c_mktsegment) ELSE 'segment__automobile' END AS segment FROM customer")
def ohe_collapse_first(spark, sf_dir):
    return prepare.collapse_one_hot(_dummies(spark, sf_dir, "__"), separator="__", all_zero="first")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN lower(c_mktsegment) END AS segment FROM customer")
def ohe_collapse_null(spark, sf_dir):
    return prepare.collapse_one_hot(_dummies(spark, sf_dir, "_"), separator="_", all_zero="null", strip_prefix=True)


@query("SELECT count(*)::BIGINT AS n_rows, count(DISTINCT l_returnflag)::BIGINT AS n_flags FROM (SELECT * FROM lineitem)")
def whole_sample(spark, sf_dir):
    """A sample of all rows is the table."""
    return prepare.sample(read(spark, sf_dir, "lineitem"), percent=100).agg(F.count("*").alias("n_rows"), F.count_distinct("l_returnflag").alias("n_flags"))


@query("SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT AS n_rows FROM lineitem")
def sample_profile(spark, sf_dir):
    return prepare.sample(read(spark, sf_dir, "lineitem"), percent=10, seed=3).agg(F.count("*").alias("n_rows"))


@query("SELECT l_returnflag AS population, greatest(1, round_even(count(*) * 0.05, 0))::BIGINT AS n_rows FROM lineitem GROUP BY 1")
def sample_population(spark, sf_dir):
    return prepare.sample(read(spark, sf_dir, "lineitem"), percent=5, seed=3, by=["l_returnflag"]).groupBy(F.col("l_returnflag").alias("population")).agg(F.count("*").alias("n_rows"))


@query("SELECT l_returnflag, true AS like_all FROM lineitem GROUP BY 1")
def sample_shares(spark, sf_dir):
    """Equal rows are sampled one by one: each flag's share in a tenth of the column is that in the table, but for five points."""
    flags = read(spark, sf_dir, "lineitem").select("l_returnflag")
    share = lambda df, name: df.groupBy("l_returnflag").agg(F.count("*").alias("n")).select("l_returnflag", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    both = share(flags, "whole").join(share(prepare.sample(flags, percent=10, seed=3), "sampled"), "l_returnflag", "left")
    return both.select("l_returnflag", F.coalesce(F.abs(F.col("whole") - F.col("sampled")) < 0.05, F.lit(False)).alias("like_all"))


@query("SELECT 'l_returnflag' AS feature, true AS without_drift")
def sample_without_drift(spark, sf_dir):
    """A table against itself, each sampled: no drift."""
    flags = read(spark, sf_dir, "lineitem").select("l_returnflag")
    found = assessment.DriftAssessment(flags, ["l_returnflag"], reference=flags, sample_percent=10, seed=3).distances(["psi"])
    return found.select("feature", (F.col("value") < 0.05).alias("without_drift"))


@query("SELECT 'none' AS feature, 0 AS bin, 0.0::DOUBLE AS bin_lower, 1.0::DOUBLE AS bin_upper, 0::BIGINT AS count, 'no data' AS bin_label FROM (SELECT 1) UNION ALL SELECT 'far', 0, 0.0, 1.0, count(*)::BIGINT, 'non-finite values' FROM supplier")
def hist_without_values(spark, sf_dir):
    """Columns without a value, or with infinite ones alone, have one bin."""
    df = read(spark, sf_dir, "supplier").select(F.lit(None).cast("double").alias("none"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))).alias("far"))
    return distribute.histogram(df, labels=True).select("feature", "bin", "bin_lower", "bin_upper", "count", "bin_label")


@query("SELECT * FROM (VALUES ('c_custkey', 'left only'), ('c_name', 'left only'), ('s_suppkey', 'right only'), ('s_name', 'right only'), ('nationkey', 'shared'), ('acctbal', 'different types'), ('c_mktsegment', 'left only')) t(column_name, status)")
def shared_columns(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumnsRenamed({"c_nationkey": "nationkey", "c_acctbal": "acctbal"})
    s = read(spark, sf_dir, "supplier").withColumnsRenamed({"s_nationkey": "nationkey"}).withColumn("acctbal", F.col("s_acctbal").cast("string")).drop("s_acctbal")
    return prepare.shared_columns(c, s)


@query()
def fingerprint(spark, sf_dir):
    return prepare.fingerprint(read(spark, sf_dir, "lineitem"))


# --- description -------------------------------------------------------------------------------------------


def _describe_sql(table: str, columns: dict[str, str], key: str | None = None) -> str:
    parts = []
    for i, (c, t) in enumerate(columns.items()):
        k, by, g = (f"{key} AS {key}, ", f"WHERE b.{key} = a.{key} AND", f"GROUP BY {key}") if key else ("", "WHERE", "")
        mode = f"(SELECT {c} FROM ({table}) b {by} {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        top = f"(SELECT count(*) FROM ({table}) b {by} {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1)"
        parts.append(
            f"SELECT {k}'{c}' AS feature, {i} AS position, '{t}' AS data_type, count(DISTINCT {c})::BIGINT AS n_unique, (count(*) - count({c}))::BIGINT AS n_missing, round_even(100.0 * (count(*) - count({c})) / count(*), 3)::DOUBLE AS perc_missing, count(*) FILTER ({c} = 0)::BIGINT AS n_zeros, "
            f"round_even(100.0 * count(*) FILTER ({c} = 0) / count(*), 3)::DOUBLE AS perc_zeros, CASE WHEN count(*) - count({c}) <= {top} THEN {mode} END::DOUBLE AS mode, round_even(100.0 * greatest(count(*) - count({c}), {top}) / count(*), 3)::DOUBLE AS perc_mode, "
            f"round(min({c}), 6)::DOUBLE AS min, round(quantile_cont({c}, 0.01), 6)::DOUBLE AS q01, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS q50, round(quantile_cont({c}, 0.99), 6)::DOUBLE AS q99, round(max({c}), 6)::DOUBLE AS max FROM ({table}) a {g}"
        )
    return union(parts)


_Q = ("min", "q01", "q50", "q99", "max")


@query(_describe_sql(GAPS, dict.fromkeys(LINE[:4], "double") | {"l_linenumber": "int"}))
def describe_numeric(spark, sf_dir):
    return rounded(describe.describe(gaps(spark, sf_dir), LINE), *_Q)


@query(_describe_sql(GAPS, {"l_discount": "double", "l_quantity": "double", "l_orderkey": "bigint"}))
def describe_appended(spark, sf_dir):
    """Lines of one flag after another: each call counts only the new ones, and adds the kept counts of the others."""
    lines, root, parts = gaps(spark, sf_dir), Scratch(spark, "appended").at, {}
    for flag in ("A", "N", "R"):
        parts[flag] = lambda flag=flag: lines.where(F.col("l_returnflag") == flag)
        own = cache.appended(spark, root, parts, "describe", lambda df: describe.states(df, ["l_discount", "l_quantity", "l_orderkey"]))
    return rounded(describe.described(describe.merged(own)), *_Q)


@query(_describe_sql("SELECT * FROM customer", {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}))
def describe_customer(spark, sf_dir):
    return rounded(describe.describe(read(spark, sf_dir, "customer")), *_Q)


@query(_describe_sql(GAPS, {"l_discount": "double", "l_quantity": "double"}, "l_returnflag"))
def seg_describe(spark, sf_dir):
    return rounded(describe.describe(gaps(spark, sf_dir), ["l_discount", "l_quantity"], ["l_returnflag"]), *_Q)


@query(
    union([
        f"SELECT '{c}' AS feature, {i} AS position, 'string' AS data_type, count(DISTINCT {c})::BIGINT AS n_unique, (count(*) - count({c}))::BIGINT AS n_missing, round_even(100.0 * (count(*) - count({c})) / count(*), 3)::DOUBLE AS perc_missing, 0::BIGINT AS n_zeros, 0::DOUBLE AS perc_zeros, "
        f"(SELECT {c} FROM orders GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode, round_even(100.0 * (SELECT count(*) FROM orders GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) / count(*), 3)::DOUBLE AS perc_mode FROM orders"
        for i, c in enumerate(("o_orderstatus", "o_orderpriority"))
    ])
)
def describe_discrete(spark, sf_dir):
    return describe.describe_discrete(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(union([f"SELECT '{c}' AS feature, {i} AS position, (count(*) - count({c}))::BIGINT AS number_of_missing, round_even(100.0 * (count(*) - count({c})) / count(*), 4)::DOUBLE AS percentage_of_missing FROM ({GAPS})" for i, c in enumerate(LINE) if c in ("l_discount", "l_tax")]))
def missing_counts(spark, sf_dir):
    return describe.missing_counts(gaps(spark, sf_dir), LINE)


@query("SELECT feature, count(*)::BIGINT AS n_values, round(sum(value * n), 2) AS total FROM (SELECT 'l_quantity' AS feature, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_tax', l_tax, count(*) FROM lineitem GROUP BY 2) GROUP BY 1")
def frequency_table(spark, sf_dir):
    freq = fq.frequencies(fq.long_numbers(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]))
    return freq.groupBy("feature").agg(F.count("*").alias("n_values"), F.round(F.sum(F.col("value") * F.col("n")), 2).alias("total"))


@query(union([f"SELECT '{c}' AS feature, count({c})::BIGINT AS total, " + ", ".join(f"round(quantile_cont({c}, {q}), 6)::DOUBLE AS {n}" for q, n in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))) + " FROM lineitem" for c in ("l_extendedprice", "l_quantity")]))
def quantiles_in_ranges(spark, sf_dir):
    """Quantiles by running counts over ranges of values, as for a large table."""
    freq = fq.frequencies(fq.long_numbers(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"]))
    return rounded(fq.quantiles(freq, ["feature"], (0.1, 0.5, 0.9), ("q10", "q50", "q90"), ranges=8), "q10", "q50", "q90")


@query(union([f"SELECT l_returnflag, '{c}' AS feature, count({c})::BIGINT AS total, " + ", ".join(f"round(quantile_cont({c}, {q}), 6)::DOUBLE AS {n}" for q, n in ((0.0, "q0"), (0.1, "q10"), (0.5, "q50"), (0.95, "q95"))) + f" FROM ({GAPS}) GROUP BY l_returnflag" for c in LINE]))
def quantiles_by_digits(spark, sf_dir):
    """Quantiles of several columns and groups together by radix selection, as for a large table."""
    names = ("q0", "q10", "q50", "q95")
    return rounded(fq.quantiles_of(gaps(spark, sf_dir), LINE, (0.0, 0.1, 0.5, 0.95), names, ["l_returnflag"], digits=True), *names)


# --- correlation -------------------------------------------------------------------------------------------


def _pairs(columns: tuple[str, ...]) -> list[tuple[int, str, int, str]]:
    return [(i, a, j, columns[j]) for i, a in enumerate(columns) for j in range(i + 1, len(columns))]


def _corr_sql(table: str, columns: tuple[str, ...], key: str | None = None) -> str:
    k, g = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return union([f"SELECT {k}'{a}' AS feature_1, '{b}' AS feature_2, {i} AS position_1, {j} AS position_2, round(corr({a}, {b}), 6) AS r FROM ({table}) {g}" for i, a, j, b in _pairs(columns)])


def _ranks_sql(table: str, columns: tuple[str, ...]) -> str:
    return union([
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {i} AS position_1, {j} AS position_2, round(corr(x, y), 6) AS r FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS y FROM ({table}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for i, a, j, b in _pairs(columns)
    ])


def _tau_sql(table: str, columns: tuple[str, ...]) -> str:
    return union([
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {i} AS position_1, {j} AS position_2, round((SELECT sum(p.n * q.n * sign(p.x - q.x) * sign(p.y - q.y)) FROM f p, f q) / (sqrt((SELECT sum(n)::DOUBLE ^ 2 FROM f) - (SELECT sum(m * m) FROM (SELECT sum(n)::DOUBLE AS m FROM f GROUP BY x))) * sqrt((SELECT sum(n)::DOUBLE ^ 2 FROM f) - (SELECT sum(m * m) FROM (SELECT sum(n)::DOUBLE AS m FROM f GROUP BY y)))), 6) AS r "
        .join((f"WITH f AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM ({table}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) ", ""))
        for i, a, j, b in _pairs(columns)
    ])


FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(_corr_sql("SELECT * FROM lineitem", FOUR))
def corr_pearson(spark, sf_dir):
    return rounded(correlate.pearson(read(spark, sf_dir, "lineitem"), FOUR), "r")


#: Columns from those of lineitem, some of them with missing values: more pairs than one plan of aggregates takes.
_WIDE = {c: c for c in LINE} | {f"{a}_{b}": f"{a} * {b}" for i, a in enumerate(LINE) for b in LINE[i:]} | {f"{c}_gap": f"nullif({c}, {v})" for c, v in (("l_quantity", "7"), ("l_discount", "0.0"), ("l_tax", "0.08"), ("l_linenumber", "1"))}


@query(union([f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {i} AS position_1, {j} AS position_2, round(corr({_WIDE[a]}, {_WIDE[b]}), 6) AS r FROM lineitem" for i, a in enumerate(_WIDE) for j, b in enumerate(_WIDE) if i < j]))
def corr_pearson_wide(spark, sf_dir):
    wide = read(spark, sf_dir, "lineitem").select(*[F.expr(f"cast({e} as double)").alias(c) for c, e in _WIDE.items()])
    return rounded(correlate.pearson(wide), "r")


@query(_corr_sql(GAPS, FOUR))
def corr_pearson_pairwise(spark, sf_dir):
    return rounded(correlate.pearson(gaps(spark, sf_dir), FOUR), "r")


@query(_ranks_sql("SELECT * FROM lineitem", FOUR))
def corr_spearman(spark, sf_dir):
    return rounded(correlate.spearman(read(spark, sf_dir, "lineitem"), FOUR), "r")


@query(_ranks_sql(GAPS, ("l_quantity", "l_discount", "l_tax")))
def corr_spearman_pairwise(spark, sf_dir):
    return rounded(correlate.spearman(gaps(spark, sf_dir), ("l_quantity", "l_discount", "l_tax")), "r")


THREE = ("l_quantity", "l_discount", "l_tax")


@query(_tau_sql(GAPS, THREE))
def corr_kendall(spark, sf_dir):
    return rounded(correlate.kendall(gaps(spark, sf_dir), THREE), "r")


@query(_tau_sql("SELECT * FROM part", ("p_size", "p_retailprice")))
def corr_kendall_in_blocks(spark, sf_dir):
    """Kendall's tau by ranges of values, as for a large table."""
    return rounded(correlate.kendall(read(spark, sf_dir, "part"), ("p_size", "p_retailprice"), blocks=6), "r")


_MIXED = "SELECT l_quantity, l_extendedprice, l_quantity * 3 + l_discount AS bent, -l_extendedprice AS turned FROM lineitem"


@query(f"SELECT *, abs(r) AS abs_r FROM ({_corr_sql(_MIXED, ('l_quantity', 'l_extendedprice', 'bent', 'turned'))}) WHERE abs(r) > 0.65")
def corr_top_pairs(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_quantity") * 3 + F.col("l_discount")).alias("bent"), (-F.col("l_extendedprice")).alias("turned"))
    return correlate.top_pairs(rounded(correlate.pearson(t), "r"), 0.65)


@query(f"SELECT feature_1, feature_2, position_1, position_2, max(r) FILTER (l_returnflag = 'A') AS \"A\", max(r) FILTER (l_returnflag = 'N') AS \"N\", max(r) FILTER (l_returnflag = 'R') AS \"R\", round(max(r) - min(r), 6) AS max_abs_difference FROM ({_corr_sql('SELECT * FROM lineitem', THREE, 'l_returnflag')}) GROUP BY ALL")
def seg_corr_compare(spark, sf_dir):
    pairs = rounded(correlate.pearson(read(spark, sf_dir, "lineitem"), THREE, ["l_returnflag"]), "r")
    return rounded(correlate.compare(pairs, "l_returnflag", ["A", "N", "R"]), "max_abs_difference")


@query("SELECT 'l_quantity' AS feature, 0 AS position, 1.0::DOUBLE AS l_quantity, round(corr(l_quantity, l_tax), 6) AS l_tax FROM lineitem UNION ALL SELECT 'l_tax', 1, round(corr(l_quantity, l_tax), 6), 1.0 FROM lineitem")
def corr_matrix(spark, sf_dir):
    return correlate.matrix(rounded(correlate.pearson(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]), "r"))


# --- distributions -----------------------------------------------------------------------------------------


def _bins_sql(table: str, column: str, edges: str, closed: str, binning: str, position: int = 0) -> str:
    """``edges`` is SQL for the list of edges ``e`` of the values ``v``."""
    inner = "list_filter(e[2:len(e) - 1], lambda z: z <= v)" if closed == "left" else "list_filter(e[2:len(e) - 1], lambda z: z < v)"
    return (
        f"WITH t AS (SELECT {column}::DOUBLE AS v FROM ({table})), ed AS (SELECT {edges} AS e FROM t), c AS (SELECT len({inner}) AS bin, count(*) AS n FROM t, ed WHERE v IS NOT NULL GROUP BY 1), g AS (SELECT unnest(range(len(e) - 1)) AS bin, e FROM ed) "
        f"SELECT '{column}' AS feature, {position} AS position, 'numeric' AS type, '{binning}' AS binning, g.bin::INT AS bin, round(e[g.bin + 1], 6) AS bin_lower, round(e[g.bin + 2], 6) AS bin_upper, '{closed}' AS closed, coalesce(n, 0)::BIGINT AS count, round_even(100.0 * coalesce(n, 0) / (SELECT count(v) FROM t), 6)::DOUBLE AS percentage, (SELECT count(*) - count(v) FROM t)::BIGINT AS n_missing, 0::BIGINT AS n_non_finite FROM g LEFT JOIN c ON g.bin = c.bin"
    )


def _even_sql(table: str, column: str, n: int, position: int = 0) -> str:
    """Equal-width edges from the range, written out one by one."""
    lo, hi = "(SELECT min(v) - (max(v) - min(v)) * 0.001 FROM t)", "(SELECT max(v) + (max(v) - min(v)) * 0.001 FROM t)"
    edges = "[" + ", ".join([f"{lo} + {float(i)} * (({hi} - {lo}) / {float(n)})" for i in range(n)] + [hi]) + "]"
    return _bins_sql(table, column, edges, "left", "equal-width", position).replace(f"SELECT {edges} AS e FROM t", f"SELECT {edges} AS e")


@query(union([_even_sql(GAPS, c, 8, i) for i, c in enumerate(("l_extendedprice", "l_discount"))]))
def hist_equal_width(spark, sf_dir):
    return rounded(distribute.histogram(gaps(spark, sf_dir), ["l_extendedprice", "l_discount"]), "bin_lower", "bin_upper")


@query(_bins_sql("SELECT * FROM part", "p_retailprice", "list_distinct_sorted", "right", "quantile").replace("SELECT list_distinct_sorted AS e FROM t", "SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM t"))
def hist_quantile(spark, sf_dir):
    return rounded(distribute.histogram(read(spark, sf_dir, "part"), ["p_retailprice"], binning="quantile", n_bins=10), "bin_lower", "bin_upper")


@query(
    "WITH c AS (SELECT l_linenumber::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT min(d) / 2 AS half FROM (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM c)), o AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS bin FROM c) "
    "SELECT 'l_linenumber' AS feature, 0 AS position, 'numeric' AS type, 'quantile' AS binning, bin::INT AS bin, round(v - half, 6) AS bin_lower, round(coalesce(lead(v) OVER (ORDER BY v) - half, v + half), 6) AS bin_upper, 'left' AS closed, n::BIGINT AS count, round_even(100.0 * n / (SELECT count(*) FROM lineitem), 6)::DOUBLE AS percentage, 0::BIGINT AS n_missing, 0::BIGINT AS n_non_finite FROM o, g"
)
def hist_distinct(spark, sf_dir):
    return rounded(distribute.histogram(read(spark, sf_dir, "lineitem"), ["l_linenumber"], binning="quantile", n_bins=10), "bin_lower", "bin_upper")


@query(
    "WITH c AS (SELECT p_type AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS k, sum(count(*)) OVER () AS total, count(*) OVER () AS levels FROM part GROUP BY 1) "
    "SELECT 'p_type' AS feature, 'categorical' AS type, (k - 1)::INT AS bin, v AS bin_label, n::BIGINT AS count, round_even(100.0 * n / total, 6)::DOUBLE AS percentage FROM c WHERE k <= 3 UNION ALL SELECT 'p_type', 'categorical', 3, 'Other (' || (any_value(levels) - 3)::VARCHAR || ' categories)', sum(n)::BIGINT, round_even(100.0 * sum(n) / any_value(total), 6)::DOUBLE FROM c WHERE k > 3 HAVING count(*) > 0"
)
def cat_counts_folded(spark, sf_dir):
    return distribute.category_counts(read(spark, sf_dir, "part"), ["p_type"], max_categories=3)


def _box_sql(table: str, column: str, position: int = 0) -> str:
    return (
        f"WITH t AS (SELECT {column}::DOUBLE AS v FROM {table}), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM t), l AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
        f"SELECT '{column}' AS feature, {position} AS position, count(v)::BIGINT AS n_valid, (count(*) - count(v))::BIGINT AS n_missing, 0::BIGINT AS n_non_finite, round(min(v), 6) AS min, round(min(v) FILTER (v >= lo), 6) AS lower_fence, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(max(v) FILTER (v <= hi), 6) AS upper_fence, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(any_value(q3 - q1), 6) AS iqr, "
        "count(*) FILTER (v < lo)::BIGINT AS n_outliers_low, count(*) FILTER (v > hi)::BIGINT AS n_outliers_high, count(*) FILTER (v < lo OR v > hi)::BIGINT AS n_outliers, round_even(100.0 * count(*) FILTER (v < lo OR v > hi) / count(v), 4)::DOUBLE AS perc_outliers FROM t, l"
    )


@query(union([_box_sql("events", "value"), _box_sql("customer", "c_acctbal")]))
def box_summary(spark, sf_dir):
    out = distribute.box_summary(read(spark, sf_dir, "events"), ["value"]).union(distribute.box_summary(read(spark, sf_dir, "customer"), ["c_acctbal"]))
    return rounded(out, "min", "lower_fence", "q1", "median", "q3", "upper_fence", "max", "mean", "std", "iqr")


@query(
    "WITH l AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events), "
    "o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events, l WHERE value < lo OR value > hi), k AS (SELECT unnest(range(least(50, max(n)))) AS place, max(n) AS n FROM o) "
    "SELECT 'value' AS feature, place::BIGINT AS place, value FROM k JOIN o ON o.i = CASE WHEN k.n <= 50 THEN place ELSE floor(place * ((k.n - 1) / 49.0::DOUBLE)) END"
)
def outlier_points(spark, sf_dir):
    return distribute.outlier_points(read(spark, sf_dir, "events"), ["value"], max_points=50)


# --- segments ----------------------------------------------------------------------------------------------


def _sizes(df: DataFrame) -> DataFrame:
    return df.select("segment", "n_rows", "share_of_rows")


def _sizes_sql(label: str, table: str) -> str:
    return f"SELECT {label} AS segment, count(*)::BIGINT AS n_rows, round_even(100.0 * count(*) / (SELECT count(*) FROM {table}), 4)::DOUBLE AS share_of_rows FROM {table} GROUP BY 1"


@query(_sizes_sql("l_returnflag", "lineitem"))
def seg_by_value(spark, sf_dir):
    return _sizes(segment.make_grouping(read(spark, sf_dir, "lineitem"), "l_returnflag").sizes())


@query(_sizes_sql("CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '(0, 10]' WHEN l_quantity > 20 AND l_quantity <= 40 THEN '(20, 40]' END", "lineitem"))
def seg_intervals(spark, sf_dir):
    return _sizes(segment.make_grouping(read(spark, sf_dir, "lineitem"), "l_quantity", bins=[(0, 10), (20, 40)]).sizes())


@query(
    "WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT CASE WHEN l_quantity <= lo + (hi - lo) / 4 THEN 0 WHEN l_quantity <= lo + 2 * (hi - lo) / 4 THEN 1 WHEN l_quantity <= lo + 3 * (hi - lo) / 4 THEN 2 ELSE 3 END AS position FROM lineitem, r) "
    "SELECT position::DOUBLE AS position, count(*)::BIGINT AS n_rows FROM b GROUP BY 1"
)
def seg_equal_width(spark, sf_dir):
    return segment.make_grouping(read(spark, sf_dir, "lineitem"), "l_quantity", n_bins=4).sizes().select("position", "n_rows")


@query(
    "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem) "
    "SELECT (CASE WHEN l_extendedprice <= a THEN 0 WHEN l_extendedprice <= b THEN 1 WHEN l_extendedprice <= c THEN 2 ELSE 3 END)::DOUBLE AS position, count(*)::BIGINT AS n_rows FROM lineitem, q GROUP BY 1"
)
def seg_quantile(spark, sf_dir):
    return segment.make_grouping(read(spark, sf_dir, "lineitem"), "l_extendedprice", n_quantiles=4).sizes().select("position", "n_rows")


# --- dates -------------------------------------------------------------------------------------------------


def _snap(table: str, column: str, interval: str, label: str):
    def run(spark, sf_dir):
        return read(spark, sf_dir, table).groupBy(tp.period_label(F.col(column), interval).alias("snapshot")).agg(F.count("*").alias("n_rows"))

    run.__name__ = f"snap_{interval.lower()}"
    query(f"SELECT {label} AS snapshot, count(*)::BIGINT AS n_rows FROM {table} GROUP BY 1")(run)


_snap("events", "ts", "Daily", "strftime(ts, '%Y-%m-%d')")
_snap("orders", "o_orderdate", "Weekly", "strftime(o_orderdate, '%G-W%V')")
_snap("orders", "o_orderdate", "Monthly", "strftime(o_orderdate, '%Y-%m')")
_snap("orders", "o_orderdate", "Quarterly", "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)::VARCHAR")
_snap("lineitem", "l_shipdate", "Yearly", "strftime(l_shipdate, '%Y')")


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders")
def date_span(spark, sf_dir):
    return tp.span(read(spark, sf_dir, "orders"), "o_orderdate")


def _spelled(name: str, spellings: list[tuple[str, str, str | None]]) -> None:
    """Order dates spelled in turn, by order key: as Spark's expression, as SQL, and the day in SQL that is to be read."""

    def run(spark, sf_dir):
        turn = F.col("o_orderkey") % len(spellings)
        raw = F.lit(None).cast("string")
        for i, (own, _, _) in enumerate(spellings):
            raw = F.when(turn == i, F.expr(own)).otherwise(raw)
        frame = tp.parse_dates(read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "raw")
        return frame.select("o_orderkey", "raw", F.date_format("parsed", "yyyy-MM-dd").alias("day"))

    run.__name__ = name
    cases = [" ".join(f"WHEN {i} THEN {x[k] or 'NULL'}" for i, x in enumerate(spellings)) for k in (1, 2)]
    query(f"SELECT o_orderkey, CASE o_orderkey % {len(spellings)} {cases[0]} END AS raw, CASE o_orderkey % {len(spellings)} {cases[1]} END AS day FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)")(run)


_DAY, _MONTH, _QUARTER = "strftime(d, '%Y-%m-%d')", "strftime(d, '%Y-%m-01')", "strftime(date_trunc('quarter', d), '%Y-%m-%d')"
_spelled("parse_dates", [
    ("date_format(o_orderdate, 'yyyy-MM-dd')", _DAY, _DAY),
    ("date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')", "strftime(d, '%Y-%m-%d %H:%M:%S')", _DAY),
    ("date_format(o_orderdate, if(day(o_orderdate) > 12, 'dd/MM/yyyy', 'yyyy/MM/dd'))", "CASE WHEN day(d) > 12 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%Y/%m/%d') END", _DAY),
    ("date_format(o_orderdate, 'MMM yyyy')", "strftime(d, '%b %Y')", _MONTH),
    ("date_format(o_orderdate, 'MMMM yyyy')", "strftime(d, '%B %Y')", _MONTH),
    ("date_format(o_orderdate, 'yyyy-MM')", "strftime(d, '%Y-%m')", _MONTH),
    ("concat('bad ', o_orderstatus)", "'bad ' || (SELECT o_orderstatus FROM orders o WHERE o.o_orderkey = s.o_orderkey)", None),
])
SQL["parse_dates"] = SQL["parse_dates"].replace("FROM orders)", "FROM orders) s")
_spelled("parse_quarters", [(f"concat({', '.join(x)})", " || ".join(y), _QUARTER) for x, y in (
    (("year(o_orderdate)", "'Q'", "quarter(o_orderdate)"), ("year(d)::VARCHAR", "'Q'", "quarter(d)::VARCHAR")),
    (("year(o_orderdate)", "'-Q'", "quarter(o_orderdate)"), ("year(d)::VARCHAR", "'-Q'", "quarter(d)::VARCHAR")),
    (("'Q'", "quarter(o_orderdate)", "' '", "year(o_orderdate)"), ("'Q'", "quarter(d)::VARCHAR", "' '", "year(d)::VARCHAR")),
    (("'Q'", "quarter(o_orderdate)", "'-'", "year(o_orderdate)"), ("'Q'", "quarter(d)::VARCHAR", "'-'", "year(d)::VARCHAR")),
)])
_spelled("parse_digits", [
    ("date_format(o_orderdate, 'yyyy')", "strftime(d, '%Y')", "strftime(d, '%Y-01-01')"),
    ("date_format(o_orderdate, 'yyyyMM')", "strftime(d, '%Y%m')", _MONTH),
    ("date_format(o_orderdate, 'yyyyMMdd')", "strftime(d, '%Y%m%d')", _DAY),
    ("concat(year(o_orderdate), '13')", "strftime(d, '%Y13')", None),
])


# --- drift -------------------------------------------------------------------------------------------------


def orders_by_year(spark, sf_dir, *columns):
    """Orders of 1995 as baseline and those of each later year as snapshots."""
    o = read(spark, sf_dir, "orders")
    year = tp.period_label(F.col("o_orderdate"), "Yearly")
    return o.select(F.when(year == "1995", drift.BASELINE).otherwise(year).alias("population"), *columns)


_ORDERS = "SELECT CASE WHEN year(o_orderdate) = 1995 THEN '' ELSE strftime(o_orderdate, '%Y') END AS p, * FROM orders"


def moved(spark, sf_dir, *columns):
    """Events of the first ten days as baseline; later ones by decade, with values that moved."""
    e = read(spark, sf_dir, "events")
    decade = F.when(F.dayofmonth("ts") <= 10, drift.BASELINE).when(F.dayofmonth("ts") <= 20, "middle").otherwise("late")
    value = F.when(F.col("event_type") == "purchase", F.col("value") * 1.3).otherwise(F.col("value"))
    kind = F.when((F.dayofmonth("ts") > 20) & (F.col("event_type") == "click"), "tap").otherwise(F.col("event_type"))
    return e.select(decade.alias("population"), F.when(decade == drift.BASELINE, F.col("value")).otherwise(value).alias("value"), kind.alias("kind")).select("population", *columns)


_MOVED = "SELECT CASE WHEN day(ts) <= 10 THEN '' WHEN day(ts) <= 20 THEN 'middle' ELSE 'late' END AS p, CASE WHEN day(ts) > 10 AND event_type = 'purchase' THEN value * 1.3 ELSE value END AS value, CASE WHEN day(ts) > 20 AND event_type = 'click' THEN 'tap' ELSE event_type END AS kind FROM events"


def _psi_sql(table: str, column: str, edges: str, digits: int = 6) -> str:
    return (
        f"WITH t AS (SELECT p, {column}::DOUBLE AS v FROM ({table}) WHERE {column} IS NOT NULL), ed AS (SELECT {edges} AS e FROM t WHERE p = ''), c AS (SELECT p, len(list_filter(e, lambda z: z <= v)) AS bin, count(*) AS n FROM t, ed GROUP BY 1, 2), s AS (SELECT p, count(*) AS total FROM t GROUP BY 1), b AS (SELECT unnest(range(len(e) + 1)) AS bin FROM ed), "
        f"g AS (SELECT s.p, b.bin, greatest(coalesce(c.n, 0) / s.total::DOUBLE, 1e-4) AS a, greatest(coalesce(z.n, 0) / (SELECT total FROM s WHERE p = '')::DOUBLE, 1e-4) AS x FROM s CROSS JOIN b LEFT JOIN c ON c.p = s.p AND c.bin = b.bin LEFT JOIN c z ON z.p = '' AND z.bin = b.bin WHERE s.p <> '') "
        f"SELECT '{column}' AS feature, p AS snapshot, round(sum((a - x) * ln(a / x)), {digits}) AS value FROM g GROUP BY p"
    )


def _inner_even(n: int) -> str:
    return "[" + ", ".join(f"min(v) + {float(i)} * ((max(v) - min(v)) / {float(n)})" for i in range(1, n)) + "]"


@query(_psi_sql(_ORDERS, "o_totalprice", _inner_even(10)))
def psi_numeric_bins(spark, sf_dir):
    d = orders_by_year(spark, sf_dir, "o_totalprice")
    return rounded(drift.psi(d, ["o_totalprice"], drift.populations(d)), "value")


@query(_psi_sql(_MOVED, "value", "list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))"))
def psi_numeric_quantile(spark, sf_dir):
    return rounded(drift.psi(moved(spark, sf_dir, "value"), ["value"], ["middle", "late"], buckets="quantiles"), "value")


_FLAT = "SELECT CASE WHEN strftime(o_orderdate, '%Y') = '1995' THEN '' ELSE 'later' END AS p, CASE WHEN strftime(o_orderdate, '%Y') = '1995' THEN 1 ELSE least(o_orderkey % 4, 2) END AS v FROM orders"


@query(f"WITH t AS ({_FLAT}), b AS (SELECT v, greatest(count(*) FILTER (p = '') / (SELECT count(*) FROM t WHERE p = ''), 1e-4::DOUBLE) AS e, greatest(count(*) FILTER (p = 'later') / (SELECT count(*) FROM t WHERE p = 'later'), 1e-4::DOUBLE) AS a FROM t GROUP BY v) SELECT 'amount' AS feature, 'later' AS snapshot, round(sum((a - e) * ln(a / e)), 6) AS value FROM b")
def psi_constant(spark, sf_dir):
    """A baseline of one value against orders below, at and above it."""
    base = F.year("o_orderdate") == 1995
    amount = F.when(base, 1.0).otherwise(F.least(F.col("o_orderkey") % 4, F.lit(2)).cast("double"))
    frame = read(spark, sf_dir, "orders").select(F.when(base, drift.BASELINE).otherwise("later").alias("population"), amount.alias("amount"))
    return rounded(drift.psi(frame, ["amount"], ["later"]), "value")


#: Days of shipping as snapshots against those before 1996: one plan of fixed width.
_DAILY = "SELECT CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS p, l_quantity AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'"


@query(f"WITH t AS ({_DAILY}), f AS (SELECT p, v, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), s AS (SELECT p, sum(n) AS total FROM f GROUP BY p), v AS (SELECT DISTINCT v FROM t), g AS (SELECT s.p, v.v, sum(coalesce(n, 0)) OVER (PARTITION BY s.p ORDER BY v.v) / total AS c, lead(v.v) OVER (PARTITION BY s.p ORDER BY v.v) - v.v AS w FROM s CROSS JOIN v LEFT JOIN f ON f.p = s.p AND f.v = v.v), b AS (SELECT v, c AS c0 FROM g WHERE p = '') SELECT 'l_quantity' AS feature, p AS snapshot, round(max(abs(c - c0)), 6) AS ks, round(sum(abs(c - c0) * coalesce(w, 0)), 6) AS wasserstein FROM g JOIN b USING (v) WHERE p <> '' GROUP BY p")
def drift_of_days(spark, sf_dir):
    """Every day's distances from the years before: about a thousand snapshots."""
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate < timestamp '1999-01-01'")
    day = F.when(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"), drift.BASELINE).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    frame = rows.select(day.alias("population"), "l_quantity")
    found = drift.cdf_distances(frame, ["l_quantity"], drift.populations(frame))
    return rounded(found, "ks", "wasserstein").select("feature", "snapshot", "ks", "wasserstein")


_LEVELS = f"WITH t AS (SELECT p, kind AS v FROM ({_MOVED})), l AS (SELECT DISTINCT v FROM t), s AS (SELECT p, count(*) AS total FROM t GROUP BY 1), c AS (SELECT p, v, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT s.p, l.v, s.total, (SELECT total FROM s WHERE p = '') AS total0, coalesce(c.n, 0) AS n, coalesce(z.n, 0) AS n0 FROM s CROSS JOIN l LEFT JOIN c ON c.p = s.p AND c.v = l.v LEFT JOIN c z ON z.p = '' AND z.v = l.v WHERE s.p <> '') "


@query(_LEVELS + "SELECT 'kind' AS feature, p AS snapshot, round(sum((greatest(n / total::DOUBLE, 1e-4) - greatest(n0 / total0::DOUBLE, 1e-4)) * ln(greatest(n / total::DOUBLE, 1e-4) / greatest(n0 / total0::DOUBLE, 1e-4))), 6) AS value FROM g WHERE n + n0 > 0 GROUP BY p")
def psi_categorical(spark, sf_dir):
    return rounded(drift.psi(moved(spark, sf_dir, "kind"), ["kind"], ["middle", "late"]), "value")


@query(_LEVELS + "SELECT 'kind' AS feature, p AS snapshot, v AS level, n0::BIGINT AS n_baseline, n::BIGINT AS n, round(n0 / total0::DOUBLE, 6) AS share_baseline, round(n / total::DOUBLE, 6) AS share FROM g WHERE n + n0 > 0")
def psi_bin_table(spark, sf_dir):
    table = drift.psi_table(moved(spark, sf_dir, "kind"), ["kind"], ["middle", "late"])
    return rounded(table.select("feature", "snapshot", "level", "n_baseline", "n", "share_baseline", "share"), "share_baseline", "share")


@query(f"WITH q AS ({_psi_sql(_MOVED, 'value', _inner_even(10), 12)}) SELECT 'value' AS feature, round_even(max(value), 4)::DOUBLE AS psi, arg_max(snapshot, value) AS snapshot, CASE WHEN max(value) >= 0.25 THEN 'substantial' WHEN max(value) >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity FROM q")
def psi_triage(spark, sf_dir):
    return drift.triage(drift.distances(moved(spark, sf_dir, "value"), ["value"], ["psi"], ["middle", "late"]))


_CDF = f"WITH t AS (SELECT p, value::DOUBLE AS v FROM ({_MOVED})), s AS (SELECT p, count(*) AS total FROM t GROUP BY 1), pr AS (SELECT p FROM s WHERE p <> ''), u AS (SELECT pr.p, t.v, count(*) FILTER (t.p = '') AS n0, count(*) FILTER (t.p <> '') AS n FROM pr JOIN t ON t.p = '' OR t.p = pr.p GROUP BY 1, 2), f AS (SELECT u.p, v, abs(sum(n0) OVER w / (SELECT total FROM s WHERE p = '')::DOUBLE - sum(n) OVER w / s.total::DOUBLE) AS gap, coalesce(lead(v) OVER w - v, 0) AS width FROM u JOIN s ON s.p = u.p WINDOW w AS (PARTITION BY u.p ORDER BY v)) "


def _cdf(name: str, expression: str):
    def run(spark, sf_dir):
        found = drift.cdf_distances(moved(spark, sf_dir, "value"), ["value"], ["middle", "late"])
        return found.select("feature", "snapshot", F.round(name, 6).alias("value"))

    run.__name__ = {"ks": "ks_stat"}.get(name, name)
    query(_CDF + f"SELECT 'value' AS feature, p AS snapshot, round({expression}, 6) AS value FROM f GROUP BY p")(run)


_cdf("ks", "max(gap)")
_cdf("wasserstein", "sum(gap * width)")
_cdf("energy", "sqrt(2 * sum(gap * gap * width))")


@query(_LEVELS + "SELECT 'kind' AS feature, p AS snapshot, round(sum(pow(n0 - total0 * (n + n0) / (total + total0)::DOUBLE, 2) / (total0 * (n + n0) / (total + total0)::DOUBLE) + pow(n - total * (n + n0) / (total + total0)::DOUBLE, 2) / (total * (n + n0) / (total + total0)::DOUBLE)), 6) AS value FROM g WHERE n + n0 > 0 GROUP BY p")
def chisquare(spark, sf_dir):
    return rounded(drift.chi_square(moved(spark, sf_dir, "kind"), ["kind"], ["middle", "late"]), "value")


@query(_CDF + "SELECT 'value' AS feature, f.p AS snapshot, round_even(max(gap), 4)::DOUBLE AS ks, round_even(1.731 * sqrt(((SELECT total FROM s WHERE p = '') + any_value(s.total)) / ((SELECT total FROM s WHERE p = '')::DOUBLE * any_value(s.total))), 4)::DOUBLE AS critical_region FROM f JOIN s ON s.p = f.p GROUP BY f.p")
def ks_details(spark, sf_dir):
    return drift.ks_details(moved(spark, sf_dir, "value"), ["value"], ["middle", "late"]).drop("p_value")


@query()
def ks_pvalue(spark, sf_dir):
    return drift.ks_details(moved(spark, sf_dir, "value"), ["value"], ["middle", "late"])


@query(_CDF + ", d AS (SELECT p, max(gap) AS ks FROM f GROUP BY p), r AS (SELECT round_even(ks, 4)::DOUBLE AS v FROM d) SELECT 'ks' AS method, 'value' AS feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max FROM r")
def distance_extended(spark, sf_dir):
    found = drift.distances(moved(spark, sf_dir, "value"), ["value"], ["ks2"], ["middle", "late"])
    return rounded(drift.extended(found), "mean", "std")


@query("SELECT 'chi_square' AS method, 'value' AS feature, s AS snapshot, NULL::DOUBLE AS value, 'chi-square needs a categorical feature' AS note FROM (VALUES ('middle'), ('late')) t(s) UNION ALL SELECT 'ks', 'kind', s, NULL, 'distance needs a numeric feature' FROM (VALUES ('middle'), ('late')) t(s)")
def distance_notes(spark, sf_dir):
    found = drift.distances(moved(spark, sf_dir, "value", "kind"), ["value", "kind"], ["ks", "chi2"], ["middle", "late"])
    return found.where("note is not null").select("method", "feature", "snapshot", "value", "note")


@query("SELECT round_even(0.0, 6)::DOUBLE AS value")
def psi_of_columns(spark, sf_dir):
    """A column against itself."""
    return rounded(drift.psi_of_columns(read(spark, sf_dir, "orders").withColumn("same", F.col("o_totalprice")), "o_totalprice", "same"), "value")


# --- trends ------------------------------------------------------------------------------------------------

_NAME = f"CASE WHEN p = '' THEN '{drift.BASELINE}' ELSE p END"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("population", F.when(F.col("population") == drift.BASELINE, "baseline").otherwise(F.col("population")))


_P = "CASE WHEN p = '' THEN 'baseline' ELSE p END AS population"


@query(f"SELECT 'mean' AS measure, 'o_totalprice' AS feature, {_P}, round_even(avg(o_totalprice), 4)::DOUBLE AS number, NULL::VARCHAR AS text FROM ({_ORDERS}) GROUP BY p")
def trend_mean(spark, sf_dir):
    return _named(trends.descriptives(orders_by_year(spark, sf_dir, "o_totalprice"), ["o_totalprice"], ["mean"]))


@query(f"SELECT 'mean' AS measure, 'o_orderpriority' AS feature, {_P}, NULL::DOUBLE AS number, v AS text FROM (SELECT p, o_orderpriority AS v, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, o_orderpriority) AS k FROM ({_ORDERS}) GROUP BY 1, 2) WHERE k = 1")
def trend_mode(spark, sf_dir):
    return _named(trends.descriptives(orders_by_year(spark, sf_dir, "o_orderpriority"), ["o_orderpriority"], ["mean"]))


@query(f"SELECT 'std' AS measure, 'o_totalprice' AS feature, {_P}, round_even(stddev_samp(o_totalprice), 4)::DOUBLE AS number, NULL::VARCHAR AS text FROM ({_ORDERS}) GROUP BY p")
def trend_std(spark, sf_dir):
    return _named(trends.descriptives(orders_by_year(spark, sf_dir, "o_totalprice"), ["o_totalprice"], ["std"]))


@query(f"SELECT {_P}, count(*)::BIGINT AS n_rows, 'o_orderstatus' AS feature, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS n_missing, round_even(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 3)::DOUBLE AS perc_missing FROM ({_ORDERS}) GROUP BY p")
def missing_trend(spark, sf_dir):
    d = orders_by_year(spark, sf_dir, F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"))
    return _named(trends.missing(d, ["o_orderstatus"]))


@query(f"SELECT CASE WHEN p = '' THEN 'baseline' ELSE 'current' END AS side, {_P}, count(*)::BIGINT AS n_rows, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY p = ''), 4)::DOUBLE AS share_of_rows FROM ({_ORDERS}) GROUP BY p")
def rows_compared(spark, sf_dir):
    return _named(trends.rows_compared(orders_by_year(spark, sf_dir, "o_totalprice")))


@query(
    f"WITH t AS (SELECT p, value::DOUBLE AS v FROM ({_MOVED})), ed AS (SELECT {_inner_even(10)} AS e FROM t WHERE p = ''), c AS (SELECT p, len(list_filter(e, lambda z: z <= v)) AS bin, count(*) AS n FROM t, ed GROUP BY 1, 2), s AS (SELECT p, count(*) AS total FROM t GROUP BY 1), b AS (SELECT unnest(range(10)) AS bin) "
    f"SELECT CASE WHEN s.p = '' THEN 'baseline' ELSE s.p END AS population, b.bin::INT AS bin, round_even(100.0::DOUBLE * coalesce(n, 0) / total, 4)::DOUBLE AS share FROM s CROSS JOIN b LEFT JOIN c ON c.p = s.p AND c.bin = b.bin"
)
def score_bands(spark, sf_dir):
    return _named(trends.score_bands(moved(spark, sf_dir, "value"), "value", ["middle", "late"])).select("population", "bin", "share")


@query(
    f"WITH t AS (SELECT p, value::DOUBLE AS v FROM ({_MOVED})), q AS ({_psi_sql(_MOVED, 'value', _inner_even(10), 12)}) SELECT {_P}, count(*)::BIGINT AS n_rows, 0::BIGINT AS n_missing, "
    + ", ".join(f"round({e}, 6)::DOUBLE AS {n}" for e, n in (("avg(v)", "mean"), ("stddev_samp(v)", "std"), ("min(v)", "min"), ("quantile_cont(v, 0.25)", "p25"), ("quantile_cont(v, 0.5)", "median"), ("quantile_cont(v, 0.75)", "p75"), ("max(v)", "max")))
    + ", round_even(coalesce((SELECT value FROM q WHERE snapshot = p), 0), 4)::DOUBLE AS psi_vs_baseline FROM t GROUP BY p"
)
def score_summary(spark, sf_dir):
    return rounded(_named(trends.score_summary(moved(spark, sf_dir, "value"), "value", ["middle", "late"])), "mean", "std", "min", "p25", "median", "p75", "max")


@query(
    "WITH t AS (SELECT 'customer' AS population, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier), s AS (SELECT population, count(*) AS total, stddev_samp(v) * pow(count(*), -0.2) AS h FROM t GROUP BY 1), r AS (SELECT min(v) AS lo, max(v) AS hi FROM t), "
    "g AS (SELECT i AS point, lo - 0.05 * (hi - lo) + i * ((hi - lo + 2 * (0.05 * (hi - lo))) / 31.0) AS x FROM r, (SELECT unnest(range(32)) AS i)) "
    "SELECT t.population, g.point::INT AS point, round(any_value(x), 4) AS score, round(sum(exp(-pow((x - v) / h, 2) / 2)) / (any_value(total) * any_value(h) * 2.5066282746310002), 10) AS density FROM t JOIN s ON s.population = t.population CROSS JOIN g GROUP BY 1, 2"
)
def score_density(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("population"), F.col("c_acctbal").alias("score"))
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("population"), F.col("s_acctbal").alias("score"))
    out = trends.score_density(c.union(s), "score", points=32)
    return out.select("population", "point", F.round("score", 4).alias("score"), F.round("density", 10).alias("density"))


# --- whole runs --------------------------------------------------------------------------------------------


@query("SELECT feature, n_unique::BIGINT AS n_unique FROM (SELECT 'o_orderstatus' AS feature, count(DISTINCT o_orderstatus) AS n_unique FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders)")
def category_candidates(spark, sf_dir):
    return prepare.category_candidates(read(spark, sf_dir, "orders"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F')::BIGINT AS n_unreadable, count(*)::BIGINT AS n_dates, max(CASE WHEN o_orderstatus = 'F' THEN 'never' END) AS example FROM orders")
def unreadable_dates(spark, sf_dir):
    raw = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("raw"))
    return tp.unreadable(tp.parse_dates(raw, "raw"), "raw")


@query(f"WITH q AS ({_psi_sql(_MOVED, 'value', _inner_even(10), 12)}) SELECT 'value' AS feature, max(round_even(value, 4))::DOUBLE AS worst FROM q")
def ranked_features(spark, sf_dir):
    return drift.ranked(drift.distances(moved(spark, sf_dir, "value"), ["value"], ["psi"], ["middle", "late"]), "psi")


@query(f"WITH q AS ({_psi_sql(_MOVED, 'value', _inner_even(10), 12)}) SELECT arg_max(snapshot, value) AS snapshot, max(round_even(value, 4))::DOUBLE AS psi, CASE WHEN max(value) >= 0.25 THEN 'substantial' WHEN max(value) >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity FROM q")
def score_verdict(spark, sf_dir):
    return trends.score_verdict(trends.score_summary(moved(spark, sf_dir, "value"), "value", ["middle", "late"]))


@query("SELECT c_mktsegment AS segment, feature, count(*)::BIGINT AS n_rows, round(median, 6) AS q50 FROM (SELECT c_mktsegment, 'c_acctbal' AS feature, quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_mktsegment) AS median FROM customer) GROUP BY ALL")
def profile_segments(spark, sf_dir):
    found = profiling.run_profiling(read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), profiling.ProfilingSettings(correlation_methods=()), by="c_mktsegment")
    sizes = found["segments"].select("segment", "n_rows")
    return rounded(found["describe"].select("segment", "feature", "q50").join(sizes, "segment"), "q50").select("segment", "feature", "n_rows", "q50")


@query(
    "SELECT strftime(o_orderdate, '%Y') AS snapshot, count(*)::BIGINT AS n_rows, round_even(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share_of_rows FROM orders GROUP BY 1"
)
def assessment_by_year(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    a = assessment.DriftAssessment(orders, ["o_totalprice", "o_orderpriority"], reference=orders, date_column="o_orderdate", interval="Yearly")
    return a.rows_compared().where("side = 'current'").select(F.col("population").alias("snapshot"), "n_rows", "share_of_rows")


@query("SELECT method, feature, count(*)::BIGINT AS n_cells FROM (VALUES ('energy', 'o_totalprice'), ('ks', 'o_totalprice'), ('psi', 'o_totalprice'), ('wasserstein', 'o_totalprice'), ('psi', 'o_orderpriority'), ('chi_square', 'o_orderpriority')) t(method, feature), (SELECT DISTINCT year(o_orderdate) FROM orders) GROUP BY ALL")
def assessment_complete(spark, sf_dir):
    """How many distances a whole run gives; their values have queries of their own."""
    orders = read(spark, sf_dir, "orders")
    a = assessment.DriftAssessment(orders, ["o_totalprice", "o_orderpriority"], reference=orders, date_column="o_orderdate", interval="Yearly")
    found = a.run(assessment.DriftSettings(("cm", "ks2", "psi", "ws", "chi2")))["distances"]
    return found.where("value is not null").groupBy("method", "feature").agg(F.count("*").alias("n_cells"))
