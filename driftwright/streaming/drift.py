"""Drift of a stream: bucket counts of each window against a baseline's edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift
from ..operators import frequency as fq


def bucket_counts(stream: DataFrame, edges: DataFrame, columns: Sequence[str], *, time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, feature, bin, n) of a stream; ``edges`` is the small static result of ``drift.breakpoints``.

    Rows that come later than ``late`` behind the newest are dropped, and a window is final once that has passed.
    """
    cells = fq.long_numbers(stream.withWatermark(time, late), columns, [time], only_finite=True)
    bins = fq.beside(cells, edges).select(time, "feature", drift.bucket(F.col("value")).alias("bin"))
    return bins.groupBy(F.window(time, window).alias("window"), "feature", "bin").agg(F.count("*").alias("n"))


def psi_of_windows(counts: DataFrame, baseline: DataFrame, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PSI of each window from its final counts; for ``foreachBatch`` or the table that the stream writes."""
    base = fq.beside(fq.long_numbers(baseline, columns, only_finite=True), edges).groupBy("feature", drift.bucket(F.col("value")).alias("bin")).agg(F.count("*").alias("n0"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin")).join(base, ["feature", "bin"], "left")
    totals = counts.groupBy("window", "feature").agg(F.sum("n").alias("total"))
    whole = base.groupBy("feature").agg(F.sum("n0").alias("total0"))
    cells = totals.join(grid, "feature").join(whole, "feature").join(counts, ["window", "feature", "bin"], "left")
    share, own = F.coalesce("n0", F.lit(0)) / F.col("total0"), F.coalesce("n", F.lit(0)) / F.col("total")
    return cells.groupBy("window", "feature").agg(F.sum(drift._psi(share, own)).alias("psi")).select(F.col("window.start").alias("window_start"), "feature", F.bround("psi", 4).alias("psi"))
