"""Dates, preparation, whole runs, reports and streams."""

import csv
import json
import random
import threading
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from io import BytesIO, StringIO
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwright.functions import pvalues
from driftwright.functions import timeperiods as tp
from driftwright.operators import describe, drift
from driftwright.plans import assessment, cache, profiling
from driftwright.sinks import addresses as ad
from driftwright.sinks import archive, report
from driftwright.sources import prepare, readers
from driftwright.streaming import drift as streamed


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "raw string")


SPELLED = {
    "iso": ["2021-04-30", "2021-07-04", "2021-12-09"], "day first": ["30/04/2021", "24/07/2021", "29/12/2021"], "names": ["April 2021", "July 2021", "December 2021"], "short names": ["Apr 2021", "Jul 2021", "Dec 2021"],
    "months": ["202104", "202107", "202112"], "days": ["20210430", "20210704", "20211209"], "times": ["2021-04-30 06:15:00", "2021-07-04 12:00:01", "2021-12-09 22:10:59"],
}


@pytest.mark.parametrize("kind", SPELLED)
def test_kinds_of_dates(spark, kind):
    rows = tp.parse_dates(texts(spark, SPELLED[kind]), "raw").select(tp.period_label(F.col("parsed"), "monthly")).collect()
    assert [r[0] for r in rows] == ["2021-04", "2021-07", "2021-12"]


def test_quarters_in_either_order(spark):
    good = ["2021Q2", "2021-Q3", "Q4 2021", "q1-2022", " 2022_q2 ", "Q3/2022", "2022 Q 4"]
    bad = ["2021Q5", "Q2", "21Q2", "2021", "2021Q22", "xQ1 2021", "Q1 2021x", "Q1 20211", "Q1--2021", "", None]
    found = [r[0] for r in texts(spark, good + bad).select(tp.period_label(tp.from_quarters(F.col("raw")), "Quarterly")).collect()]
    assert found == ["2021-Q2", "2021-Q3", "2021-Q4", "2022-Q1", "2022-Q2", "2022-Q3", "2022-Q4"] + [None] * len(bad)


def test_numbers_and_timestamps_as_dates(spark):
    df = spark.createDataFrame([(202108,), (20211117,)], "raw long")
    assert [str(r["parsed"])[:10] for r in tp.parse_dates(df, "raw").collect()] == ["2021-08-01", "2021-11-17"]
    stamp = spark.sql("select timestamp_ntz'2021-11-17 04:30:00' as raw")
    assert str(tp.parse_dates(stamp, "raw").first()["parsed"]) == "2021-11-17 04:30:00"


@pytest.mark.parametrize(("interval", "labels"), [("Quarterly", ["2020-Q4", "2021-Q3", "2022-Q1"]), ("y", ["2020", "2021", "2022"]), ("weeks", ["2020-W53", "2021-W36", "2021-W52"])])
def test_period_labels(spark, interval, labels):
    df = tp.parse_dates(texts(spark, ["2020-12-31", "2021-09-08", "2022-01-02"]), "raw")
    assert [r[0] for r in df.select(tp.period_label(F.col("parsed"), interval)).collect()] == labels


def test_interval_names():
    assert tp.normalise_interval(None) == "Monthly" and tp.normalise_interval("Whole data") == "All"
    with pytest.raises(ValueError):
        tp.normalise_interval("fortnight")


def test_delimited_text(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("group;value;gap;flag\nA;1;NA;true\nA;2;n/a;false\nB;300;0.5;true\n")
    t = readers.load_table(spark, str(path))
    assert t.delimiter == ";" and dict(t.frame.dtypes) == {"group": "string", "value": "smallint", "gap": "double", "flag": "boolean"}
    assert t.narrowed_types == {"value": "smallint"} and t.frame.where("gap is null").count() == 2
    (tmp_path / "copy.csv").write_text(path.read_text())
    assert readers.content_token(spark, str(tmp_path / "copy.csv")) == t.token
    with pytest.raises(ValueError):
        readers.load_table(spark, str(path), delimiter=";;")


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines, ""quoted"""\n2,plain\n')
    rows = readers.load_table(spark, str(path)).frame.orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    (tmp_path / "other.csv").write_text('2,plain\nid,note\n1,"two\nlines, ""quoted"""\n')
    assert readers.content_token(spark, str(path)) != readers.content_token(spark, str(tmp_path / "other.csv"))


def test_blanks_and_junk_alone_are_no_dates(spark):
    df = spark.createDataFrame([(" ", 1.0), ("", 2.0), ("junk", 3.0)], "when string, v double")
    with pytest.raises(ValueError, match="junk"):
        assessment.DriftAssessment(df, ["v"], date_column="when", reference=df)


def test_large_tables_are_in_the_archive(spark, monkeypatch):
    monkeypatch.setattr(report, "MOST_ROWS", 5)
    with zipfile.ZipFile(BytesIO(report.build_zip({"big": spark.range(25000, numPartitions=3), "none": spark.range(0)}, {"a": 1}))) as z:
        assert z.namelist() == ["01_big.csv", "02_none.csv", "metadata.json", "README.txt"]
        assert sorted(map(int, z.read("01_big.csv").decode().split()[1:])) == list(range(25000)) and z.read("02_none.csv") == b"id\n"


def test_archive_is_written_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "MOST_ROWS", 5)
    monkeypatch.setattr(archive, "FETCH", 5000)
    odd = spark.range(3000, numPartitions=4).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("gaps"), F.lit('a,"b"\n\u00e9').alias("a.b"), F.array("id").alias("list"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") != 7, F.lit(0.5)).alias("x")
    )
    (tmp_path / "r.zip").write_bytes(b"older")
    long = spark.range(60000, numPartitions=2).select("id", F.repeat(F.lit("x"), F.lit(100)).alias("x"))  # three pieces a task
    at = report.write_zip(spark, {"odd": odd, "few": odd.limit(2), "none": odd.limit(0), "gone": odd.where("id < 0"), "long": long}, {"a": 1}, str(tmp_path / "r.zip"))
    with zipfile.ZipFile(at) as z:
        assert z.testzip() is None and len(z.namelist()) == 7
        rows = list(csv.reader(StringIO(z.read("01_odd.csv").decode(), newline="")))
        assert rows[0] == ["id", "gaps", "a.b", "list", "at", "x"] and len(rows) == 3001
        assert rows[1:] == [[str(i), str(i) if i % 3 else "", 'a,"b"\n\u00e9', f"[{i}]", str(datetime(1970, 1, 1) + timedelta(seconds=i)), "" if i == 7 else "0.5"] for i in range(3000)]
        assert z.read("02_few.csv") == z.read("01_odd.csv")[: len(z.read("02_few.csv"))] and z.read("03_none.csv") == z.read("04_gone.csv")
        assert z.read("05_long.csv").decode().split() == ["id,x", *[f"{i},{'x' * 100}" for i in range(60000)]]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("r.zip.")]


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined_crc(a, b):
    assert archive.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_output_folder():
    out = ad.OutputFolder("results/x")
    assert out.resolve() == "results/x" and out.set("s3://bucket/eda/") == "s3://bucket/eda" == out.resolve() and out.resolve("/tmp/y") == "/tmp/y"
    assert out.reset() == "results/x"
    with pytest.raises(ValueError):
        out.set(" ")


def test_columns_without_finite_values_have_one_bin(spark):
    from driftwright.operators import distribute

    df = spark.createDataFrame([(None, float("inf"), 1.0), (None, float("-inf"), float("inf")), (None, None, 3.0)], "none double, far double, near double")
    for binning in (distribute.EQUAL_WIDTH, distribute.QUANTILE):
        rows = {(r["feature"], r["bin"]): r for r in distribute.histogram(df, binning=binning, n_bins=2, labels=True).collect()}
        assert sorted(rows) == [("far", 0), ("near", 0), ("near", 1), ("none", 0)]
        none, far = rows["none", 0], rows["far", 0]
        assert (none["bin_lower"], none["bin_upper"], none["count"], none["n_missing"], none["bin_label"]) == (0.0, 1.0, 0, 3, "no data")
        assert (far["count"], far["n_non_finite"], far["bin_label"]) == (2, 2, "non-finite values")
        assert [rows["near", k]["count"] for k in (0, 1)] == [1, 2] and rows["near", 1]["bin_label"].endswith(" + ∞") and "∞" not in rows["near", 0]["bin_label"]


def test_long_samples_have_exact_p_values():
    # a two-sided path count by recursion on a small case, and a large case against the limit
    def inside(n, m, h):
        counts = {(0, 0): 1}
        for i in range(n + 1):
            for j in range(m + 1):
                if (i, j) != (0, 0):
                    counts[i, j] = (counts.get((i - 1, j), 0) + counts.get((i, j - 1), 0)) if abs(i * m - j * n) < h else 0
        return counts[n, m]

    from math import comb

    for n, m in ((5, 7), (8, 8), (12, 3)):
        for h in range(1, n * m + 1):
            d = h / (n * m)
            if h % np.gcd(n, m) == 0:
                assert abs(pvalues.exact(d, n, m) - (1 - inside(n, m, h) / comb(n + m, n))) < 1e-12
    assert abs(pvalues.ks_p_value(0.02, 9000, 10000) - pvalues.asymptotic(0.02, 9000, 10000)) < 5e-3


def test_stacking(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "value int"), spark.createDataFrame([(3, "x")], "value int, other string")
    rows = prepare.combine({"train": a, "test": b}).orderBy("value").collect()
    assert [(r["value"], r["Dataset"], r["other"]) for r in rows] == [(1, "train", None), (2, "train", None), (3, "test", "x")]
    with pytest.raises(ValueError):
        prepare.combine({"a": a.withColumn("Dataset", F.lit(1))})


def test_one_hot_of_both_kinds(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 0.0), (4, None, None)], "id int, colour__red double, colour__blue double")
    assert [r["colour"] for r in prepare.collapse_one_hot(df).orderBy("id").collect()] == ["colour__red", "colour__blue", "colour__red", None]
    own = prepare.collapse_one_hot(df, separator="__", all_zero="null", strip_prefix=True)
    assert own.columns == ["id", "colour"] and [r["colour"] for r in own.orderBy("id").collect()] == ["red", "blue", None, None]
    with pytest.raises(ValueError):
        prepare.collapse_one_hot(df.withColumn("colour", F.lit("x")))


@pytest.mark.parametrize("parts", [1, 5])
def test_samples_are_exact_and_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).withColumn("k", F.col("id") % 3).repartition(parts)
    own = sorted(r["id"] for r in prepare.sample(df, percent=10, seed=4).collect())
    assert len(own) == 100 and own == sorted(r["id"] for r in prepare.sample(df.repartition(3), percent=10, seed=4).collect())
    assert own != sorted(r["id"] for r in prepare.sample(df, percent=10, seed=5).collect())
    assert {r["count"] for r in prepare.sample(df, rows=7, by=["k"]).groupBy("k").count().collect()} == {7}
    assert prepare.sample(df.limit(3), percent=1).count() == 1
    with pytest.raises(ValueError):
        prepare.sample(df, percent=0)


def test_repeated_rows_are_sampled_one_by_one(spark):
    df = spark.range(6000, numPartitions=5).select(F.col("id") % 3, F.when(F.col("id") % 2 == 0, F.lit("g")).alias("g"))
    found = {r[0]: r[1] for r in prepare.sample(df, percent=10, seed=1).groupBy("(id % 3)").count().collect()}
    assert sum(found.values()) == 600 and all(150 < n < 250 for n in found.values())
    each = {r["g"]: r["count"] for r in prepare.sample(df, percent=10, by=["g"]).groupBy("g").count().collect()}
    assert each == {"g": 300, None: 300}


def test_a_sampled_table_doesnt_drift_from_itself(spark):
    df = spark.range(30000, numPartitions=4).select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("flag"))
    a = assessment.DriftAssessment(df, ["flag"], reference=df, sample_percent=10)
    assert a.distances(["psi"]).first()["value"] < 0.01


def test_segments_are_sampled_each(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") < 300, F.lit("few")).otherwise(F.lit("many")).alias("s"))
    p = profiling.run_profiling(df, profiling.ProfilingSettings(sample_percent=10), by="s")
    assert {r[profiling.segment.SEGMENT]: r["n_valid"] for r in p["boxes"].where("feature = 'x'").collect()} == {"few": 30, "many": 270}
    assert any("constant" in n for n in profiling.run_profiling(df.where("s = 'few'"), by="s").notes)


def test_samples_of_copies_are_the_same_under_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(prepare, "COPIES", 7)
    # a third of the rows are one row, others stand once or a few times; nulls change places, arrays hold them
    rows = [("hot", None, [1, None])] * 400 + [(f"few {i % 90}", "x", None) for i in range(300)] + [(None if i % 2 else "ab", "ab" if i % 2 else None, [None, i]) for i in range(500)]
    rows += [(None, "swap", None), ("swap", None, None)] * 3
    df = spark.createDataFrame(rows, "a string, `b.c` string, v array<int>")
    get = lambda d: sorted(map(str, d.collect()))
    kept = [get(prepare.sample(df.repartition(n), percent=20, seed=5)) for n in (1, 3, 8)]
    shuffled = prepare.sample(df.repartition(6, F.rand()), percent=20, seed=5)  # rows in other places at each read
    assert kept[0] == kept[1] == kept[2] == get(shuffled) == get(shuffled) and len(kept[0]) == round(0.2 * len(rows))
    have = sorted(map(str, df.collect()))
    assert all(kept[0].count(r) <= have.count(r) for r in set(kept[0])) and kept[0] != get(prepare.sample(df, percent=20, seed=6))
    assert 40 < sum("hot" in r for r in kept[0]) < 120
    by = prepare.sample(df, rows=50, by=["b.c"], seed=5).groupBy("`b.c`").count().collect()
    assert {r[0]: r[1] for r in by} == {None: 50, "x": 50, "ab": 50, "swap": 3}


def test_copies_are_drawn_evenly(spark):
    df = spark.range(40).select((F.col("id") % 4).alias("k"))
    seen = [0, 0, 0, 0]
    for seed in range(12):
        for r in prepare.sample(df, rows=20, seed=seed).collect():
            seen[r["k"]] += 1
    assert sum(seen) == 240 and all(40 < n < 80 for n in seen)


def test_repeated_rows_in_a_sample(spark):
    df = spark.createDataFrame([("a",)] * 50, "v string")
    assert prepare.sample(df, rows=20).count() == 20


def brute_ks(n, m, d):
    paths = list(combinations(range(n + m), n))
    hit = 0
    for p in paths:
        i = j = 0
        worst = 0.0
        for k in range(n + m):
            i, j = (i + 1, j) if k in p else (i, j + 1)
            worst = max(worst, abs(i / n - j / m))
        hit += worst >= d - 1e-12
    return hit / len(paths)


@pytest.mark.parametrize(("n", "m", "d"), [(3, 4, 0.5), (5, 5, 0.6), (6, 3, 1.0), (4, 6, 0.25), (7, 5, 0.0)])
def test_exact_p_values_count_paths(n, m, d):
    assert np.isclose(pvalues.exact(d, n, m), brute_ks(n, m, d))


def test_asymptotic_p_value_is_near_the_exact_one():
    assert abs(pvalues.exact(0.1, 400, 300) - pvalues.asymptotic(0.1, 400, 300)) < 0.01
    assert pvalues.asymptotic(0.9, 10**6, 10**6) == 0.0


def test_profile_of_segments(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0, "x"), ("A", 2.0, 1.0, "y"), ("B", 3.0, 5.0, "x"), (None, 4.0, 4.0, "x")], "g string, a double, b double, c string")
    seen = []
    p = profiling.run_profiling(df, by="g", progress=lambda label, share: seen.append(share))
    assert p.numeric == ["a", "b"] and any("1 rows belong to no segment" in n for n in p.notes) and seen == sorted(seen)
    assert {r["segment"] for r in p["describe"].collect()} == {"A", "B"}
    assert p["segments"].count() == 2 and p.of_segment("A")["describe"].count() == 2
    assert p.correlation_comparison("kendall", ["A", "B"]).count() == 1
    json.dumps(p.metadata())


def test_profile_settings_fail_first(spark):
    df = spark.range(3)
    for bad in (profiling.ProfilingSettings(n_bins=0), profiling.ProfilingSettings(binning="odd"), profiling.ProfilingSettings(correlation_methods=("cosine",)), profiling.ProfilingSettings(sample_percent=0)):
        with pytest.raises(ValueError):
            profiling.run_profiling(df, bad)
    with pytest.raises(ValueError, match="none of the features"):
        profiling.run_profiling(df, profiling.ProfilingSettings(features=("absent",)))


def dated(spark):
    return spark.createDataFrame([(1.0, "a", "2025-01-01"), (2.0, "b", "2025-01-20"), (10.0, "a", "2025-02-01"), (11.0, "c", "bad date")], "value double, kind string, when string")


def test_chosen_analyses_alone_are_run(spark):
    df = spark.createDataFrame([(float(i), i * i, "ab"[i % 2]) for i in range(20)], "x double, y long, t string")
    tables = {"describe": {"describe", "describe_discrete"}, "missing": {"missing"}, "correlations": {"correlations", "top_correlations"}, "distributions": {"distributions", "categories"}, "boxes": {"boxes"}}
    whole = profiling.run_profiling(df)
    assert set(whole) == set().union(*tables.values())
    for name, own in tables.items():
        p = profiling.run_profiling(df, profiling.ProfilingSettings(analyses=(name,)))
        assert set(p) == own and p.metadata()["settings"]["analyses"] == (name,)
    for bad in (("charts",), ()):
        with pytest.raises(ValueError):
            profiling.ProfilingSettings(analyses=bad).check()


def test_first_snapshot_is_the_baseline_and_bad_dates_are_noted(spark):
    a = assessment.DriftAssessment(dated(spark), ["value", "kind"], date_column="when")
    assert a.snapshots == ["2025-01", "2025-02"] and "1 rows have unreadable dates" in a.notes[0]
    found = {(r["method"], r["feature"], r["snapshot"]): r["value"] for r in a.distances(["psi", "chi2"]).collect()}
    assert found["psi", "value", "2025-01"] == 0.0 and found["psi", "value", "2025-02"] > 0 and found["chi_square", "value", "2025-02"] is None


def test_unreadable_dates_and_bad_columns(spark):
    with pytest.raises(ValueError, match="no date"):
        assessment.DriftAssessment(spark.createDataFrame([(1.0, "abc"), (2.0, "def")], "v double, when string"), ["v"], date_column="when")
    with pytest.raises(ValueError, match="not found"):
        assessment.DriftAssessment(dated(spark), ["absent"], date_column="when")
    with pytest.raises(ValueError, match="reference"):
        assessment.DriftAssessment(dated(spark), ["value"])
    with pytest.raises(ValueError, match="feature too"):
        assessment.DriftAssessment(dated(spark), ["value"], date_column="when", score_column="value")


def test_whole_drift_run_with_a_mapping(spark):
    base = spark.createDataFrame([(1.0, "A", 0.1), (2.0, "A", 0.2), (3.0, "B", 0.4), (None, None, 0.9)], "amount double, segment string, score double")
    later = spark.createDataFrame([(2.0, "A", 0.2), (3.0, "B", 0.5), (4.0, "C", 0.6), (5.0, "C", 0.7)], "amount double, segment string, score double")
    a = assessment.DriftAssessment({"later": [later, later]}, ["amount", "segment"], reference=base, score_column="score")
    tables = a.run(assessment.DriftSettings(("cm", "ks2", "psi", "ws", "chi2"), deviations=True, missing=True, score=True))
    assert {r["method"] for r in tables["distances"].where("value is not null").collect()} == {"energy", "ks", "psi", "wasserstein", "chi_square"}
    assert tables["rows_compared"].where("population = 'later'").first()["n_rows"] == 8
    assert set(tables) >= {"triage", "psi_bins", "missing", "score_bands", "score_summary", "score_density", "descriptives", "extended"}
    assert tables["missing"].where((F.col("population") == drift.BASELINE) & (F.col("feature") == "amount")).first()["perc_missing"] == 25.0


def test_each_population_is_sampled(spark):
    df = spark.range(400).select(F.col("id").cast("double").alias("v"), F.when(F.col("id") < 100, "2024-01-01").otherwise("2024-02-01").alias("when"))
    a = assessment.DriftAssessment(df, ["v"], reference=df, date_column="when", sample_percent=10)
    assert {r["population"]: r["n_rows"] for r in a.rows_compared().collect()} == {drift.BASELINE: 40, "2024-01": 10, "2024-02": 30}


def test_report_folder_and_archive(spark, tmp_path):
    p = profiling.run_profiling(spark.createDataFrame([("A", 1.0), ("B", 2.0)], "g string, v double"), by="g")
    written = report.write_segmented_report(spark, p, str(tmp_path / "out"))
    names = {w.removeprefix(str(tmp_path / "out") + "/") for w in written}
    assert "00_comparison/metadata.json" in names and any(n.startswith("01_A/") for n in names)
    with zipfile.ZipFile(BytesIO(report.build_zip(p.tables, p.metadata()))) as z:
        assert "README.txt" in z.namelist() and b"feature" in z.read("01_describe.csv")


def test_cached_results(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return {"a": spark.range(3)}

    key = cache.result_key("token", "{}")
    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), key, make)["a"].count() == 3
    assert len(made) == 1


def test_concurrent_runs_keep_one_whole_result(spark, tmp_path):
    both = threading.Barrier(2)

    def run(i):
        def make():
            both.wait(60)
            return {n: spark.range(10).select(F.lit(i).alias("run")) for n in ("a", "b")}

        return {r["run"] for t in cache.cached(spark, str(tmp_path), "k", make).values() for r in t.collect()}

    with ThreadPoolExecutor(2) as pool:
        seen = list(pool.map(run, range(2)))
    again = {r["run"] for t in cache.cached(spark, str(tmp_path), "k", dict).values() for r in t.collect()}
    assert all(len(s) == 1 for s in [*seen, again]) and again in seen


def test_interrupted_run_is_not_taken(spark, tmp_path):
    def broken():
        return {"a": spark.range(3), "b": spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))}

    with pytest.raises(Exception, match="broken"):
        cache.cached(spark, str(tmp_path), "k", broken)
    assert [p.name for p in (tmp_path / "k").iterdir()] == []
    assert cache.cached(spark, str(tmp_path), "k", lambda: {"a": spark.range(4)})["a"].count() == 4


def test_appended_files_only_cost_themselves(spark, tmp_path, monkeypatch):
    rng, paths, counted = random.Random(5), [], []
    states = describe.states
    monkeypatch.setattr(describe, "states", lambda df, columns: counted.append(df.count()) or states(df, columns))
    for i, n in enumerate((40, 1, 200)):
        rows = [f"{rng.choice(['', '0', '7', str(rng.randrange(50))])},{rng.random():.2f},t" for _ in range(n)]
        (tmp_path / f"{i}.csv").write_text("\n".join(["a,b,c", *rows]) + "\n")
        paths.append(str(tmp_path / f"{i}.csv"))
        got = cache.describe_files(spark, str(tmp_path / "kept"), [*paths, *paths[:1]], ["a", "b"])
        assert counted == [40, 40, 1, 200][: i + 2]
    monkeypatch.undo()
    frames = [readers.as_frame(spark, p).select(F.col("a").cast("bigint"), "b") for p in [*paths, paths[0]]]
    want = describe.describe(frames[0].union(frames[1]).union(frames[2]).union(frames[3]))
    keep = [c for c in want.columns if c != "data_type"]
    assert sorted(got.select(keep).collect()) == sorted(want.select(keep).collect())


def test_columns_of_several_types_are_counted_as_doubles(spark):
    whole, halves = spark.createDataFrame([(1,), (2,), (2,)], "a bigint"), spark.createDataFrame([(2.0,), (0.5,), (0.5,), (0.5,), (None,)], "a double")
    one, two = describe.states(whole), describe.states(halves)
    row = describe.described(describe.merged({"counts": one["counts"].union(two["counts"]), "numbers": one["numbers"].union(two["numbers"]), "exact": one["exact"]})).first()
    assert (row["data_type"], row["n_unique"], row["mode"], row["n_missing"], row["max"]) == ("mixed", 3, 0.5, 1, 2.0)


def test_interactive_settings():
    s = profiling.ProfilingSettings.interactive(seed=3)
    assert (s.correlation_methods, s.correlation_threshold, s.n_bins, s.features, s.sample_percent, s.seed) == (("spearman",), 0.65, 10, None, 100.0, 3)
    d = assessment.DriftSettings.interactive()
    assert (d.methods, d.n_buckets, d.buckets, d.means, d.deviations, d.missing, d.score, d.sample_percent) == (("psi",), 10, "bins", True, False, True, False, 100.0)


def test_run_stamps():
    summer, winter = (datetime(2024, m, 15, 2, 30, tzinfo=timezone.utc) for m in (7, 1))
    assert ad.run_stamp("drift", now=summer) == "drift_20240714_223000" and ad.run_stamp(now=winter) == "20240114_213000"
    assert ad.run_stamp(zone="UTC", now=summer) == ad.run_stamp(zone="No/Where", now=summer) == "20240715_023000"


def test_addresses():
    assert ad.join_address("s3://b/x/", "/y", "z.csv") == "s3://b/x/y/z.csv"
    assert ad.is_remote("abfss://c@a/x") and ad.is_remote("dbfs:/x") and not ad.is_remote("/tmp/x") and not ad.is_remote("C:/x")
    assert ad.parent_address("s3://b/x/y") == "s3://b/x" and ad.parent_address("/a/b") == "/a" and ad.parent_address("dbfs:/x/y") == "dbfs:/x"
    assert ad.with_suffix("/a/b.csv", ".png") == "/a/b.png" and ad.numbered_address("/a/b.csv", 2) == "/a/b_2.csv"
    assert ad.relative_label("/a/b/c", "/a/b") == "c" and ad.safe_name("../x y?") == "x_y"
    assert ad.unique_names(["a b", "A_b"]) == ["a_b", "A_b_2"]


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + k % 3} 0{k % 9}:00:00", float(k % 10 + (5 if k % 3 == 2 else 0))) for k in range(90)] + [("2024-02-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "t string, v double").select(F.to_timestamp("t").alias("ts"), "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    base = df.where("ts < '2024-01-02'")
    edges = drift.breakpoints(base, ["v"], n_buckets=4)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streamed.bucket_counts(stream, edges, ["v"], time="ts").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start(str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    found = {str(r["window_start"])[:10]: r["psi"] for r in streamed.psi_of_windows(spark.read.parquet(str(tmp_path / "out")), base, edges, ["v"]).collect()}
    assert found["2024-01-01"] == 0.0 and found["2024-01-03"] > 0.1 and set(found) == {"2024-01-01", "2024-01-02", "2024-01-03"}


def test_registered_queries_have_sql_or_are_known_not_to():
    import __spark_entry__ as entry
    from driftwright.plans import queries

    assert set(queries.SQL) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.QUERIES) - set(queries.SQL) == {"fingerprint", "ks_pvalue"}
