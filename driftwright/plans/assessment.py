"""Drift of current data against a baseline."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeperiods as tp
from ..operators import drift, trends
from ..sources import prepare, readers

WHOLE = "Current data"


@dataclass(frozen=True)
class DriftSettings:
    methods: tuple[str, ...] = ("psi",)
    n_buckets: int = 10
    buckets: str = "bins"
    means: bool = True
    deviations: bool = False
    missing: bool = False
    score: bool = False
    sample_percent: float = 100.0
    seed: int = 0

    @classmethod
    def interactive(cls, **changes) -> DriftSettings:
        """What an interactive session starts from: missing values are shown too."""
        return cls(**{"missing": True, **changes})

    def key(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


Source = DataFrame | str


class DriftAssessment:
    """Snapshots of current data compared with a baseline, feature by feature.

    ``current`` is a table, cut into calendar periods of ``date_column`` (or one snapshot without it), or a
    mapping of snapshot names to tables or lists of tables. Without ``reference`` the first snapshot is the
    baseline and stays among the snapshots. Features keep the kind that they have in the baseline. All
    populations are one long table, of which only features, score and population are read.
    """

    def __init__(
        self,
        current: Source | Mapping[str, Source | Sequence[Source]],
        columns: Sequence[str],
        *,
        reference: Source | None = None,
        date_column: str | None = None,
        interval: str = "Monthly",
        score_column: str | None = None,
        one_hot: str | Sequence[str] | Mapping[str, Sequence[str]] | None = None,
        sample_percent: float = 100.0,
        seed: int = 0,
    ):
        self.columns = list(columns)
        if not self.columns or len(set(self.columns)) < len(self.columns):
            raise ValueError("columns must be distinct and at least one")
        if score_column in self.columns:
            raise ValueError(f"the score column {score_column!r} can't be a feature too")
        if not 0 < sample_percent <= 100:
            raise ValueError("sample_percent must be above 0 and at most 100")
        self.spark, self.score_column, self.notes = SparkSession.active(), score_column, []
        self.interval = tp.normalise_interval(interval)
        keep = [*self.columns, *([score_column] if score_column else [])]

        if "population" in [c.lower() for c in keep]:
            raise ValueError("'population' names the snapshots; rename that column before it is assessed")

        def prepared(source: Source, extra: Sequence[str] = ()) -> DataFrame:
            frame = readers.as_frame(self.spark, source)
            if one_hot is not None:
                frame = prepare.collapse_one_hot(frame, one_hot, separator="_", all_zero="null", strip_prefix=True)
            absent = [c for c in [*keep, *extra] if c not in frame.columns]
            if absent:
                raise ValueError(f"columns not found: {absent}")
            return frame.select(*[F.col(f"`{c}`") for c in [*keep, *extra]])

        if isinstance(current, Mapping):
            if not current:
                raise ValueError("no snapshots")
            parts = [prepare.stack([prepared(s) for s in (own if isinstance(own, (list, tuple)) else [own])]).withColumn("population", F.lit(str(label))) for label, own in current.items()]
            snapshots = reduce(lambda a, b: a.unionByName(b), parts)
            self.snapshots = [str(k) for k in current]
        elif date_column is None or self.interval == "All":
            snapshots = prepared(current).withColumn("population", F.lit(WHOLE))
            self.snapshots = [WHOLE]
        else:
            dated = tp.parse_dates(prepared(current, [date_column]), date_column, "_parsed")
            bad = tp.unreadable(dated, date_column, "_parsed").first()
            if bad["n_dates"] and bad["n_unreadable"] == bad["n_dates"]:
                raise ValueError(f"no date of {date_column!r} can be read, for example {bad['example']!r}")
            if bad["n_unreadable"]:
                self.notes.append(f"{bad['n_unreadable']} rows have unreadable dates, for example {bad['example']!r}")
            snapshots = dated.withColumn("population", tp.period_label(F.col("_parsed"), self.interval)).where("population is not null").select(*keep, "population")
            self.snapshots = sorted(r[0] for r in snapshots.select("population").distinct().collect())
        if reference is None:
            if len(self.snapshots) < 2:
                raise ValueError("a single population needs a reference")
            base = snapshots.where(F.col("population") == self.snapshots[0]).drop("population")
        else:
            base = prepared(reference)
        base = base.select(*keep).withColumn("population", F.lit(drift.BASELINE))
        types = dict(base.dtypes)
        for c in keep:  # the baseline decides the kind
            if types[c] != dict(snapshots.dtypes)[c]:
                snapshots = snapshots.withColumn(c, F.col(f"`{c}`").try_cast(types[c]))
        self.frame = base.unionByName(snapshots.select(*keep, "population"))
        if sample_percent < 100:
            self.frame = prepare.sample(self.frame, percent=sample_percent, seed=seed, by=["population"])
        sizes = {r[0]: r[1] for r in self.frame.groupBy("population").count().collect()}
        empty = [p for p in [drift.BASELINE, *self.snapshots] if not sizes.get(p)]
        if empty:
            raise ValueError(f"populations without rows: {['baseline' if p == drift.BASELINE else p for p in empty]}")
        self.numeric, self.categorical = drift.split_kinds(base, self.columns)

    def distances(self, methods: Sequence[str] = ("cm", "ks2", "psi", "ws"), *, n_buckets: int = 10, buckets: str = "bins") -> DataFrame:
        return drift.distances(self.frame, self.columns, methods, self.snapshots, n_buckets=n_buckets, buckets=buckets)

    def psi_table(self, *, n_buckets: int = 10, buckets: str = "bins") -> DataFrame:
        return drift.psi_table(self.frame, self.columns, self.snapshots, n_buckets=n_buckets, buckets=buckets)

    def ks_details(self) -> DataFrame:
        return drift.ks_details(self.frame, self.numeric, self.snapshots)

    def descriptives(self, measures: Sequence[str] = ("mean", "std")) -> DataFrame:
        return trends.descriptives(self.frame, self.columns, measures)

    def missing(self) -> DataFrame:
        return trends.missing(self.frame, self.columns)

    def rows_compared(self) -> DataFrame:
        return trends.rows_compared(self.frame)

    def levels(self) -> DataFrame:
        """The values of each categorical feature, over all populations."""
        from ..operators import frequency as fq

        return fq.long_texts(self.frame, self.categorical).distinct()

    def _score(self) -> str:
        if self.score_column is None:
            raise ValueError("no score column was given")
        return self.score_column

    def score_bands(self, **options) -> DataFrame:
        return trends.score_bands(self.frame, self._score(), self.snapshots, **options)

    def score_summary(self, **options) -> DataFrame:
        return trends.score_summary(self.frame, self._score(), self.snapshots, **options)

    def score_density(self, **options) -> DataFrame:
        return trends.score_density(self.frame, self._score(), **options)

    def run(self, settings: DriftSettings | None = None) -> dict[str, DataFrame]:
        """All tables that ``settings`` ask for; chi-square stays for categorical features alone."""
        s = settings or DriftSettings()
        found = self.distances(s.methods, n_buckets=s.n_buckets, buckets=s.buckets)
        found = found.where((F.col("method") != "chi_square") | F.col("feature").isin(self.categorical)) if self.categorical else found.where("method <> 'chi_square'")
        out = {"distances": found, "extended": drift.extended(found), "rows_compared": self.rows_compared()}
        if "psi" in [drift.METHODS.get(m.lower()) for m in s.methods]:
            out |= {"psi_bins": self.psi_table(n_buckets=s.n_buckets, buckets=s.buckets), "triage": drift.triage(found)}
        measures = [m for m, on in (("mean", s.means), ("std", s.deviations)) if on]
        if measures:
            out["descriptives"] = self.descriptives(measures)
        if s.missing:
            out["missing"] = self.missing()
        if s.score:
            out |= {"score_bands": self.score_bands(n_bins=s.n_buckets, buckets=s.buckets), "score_summary": self.score_summary(n_bins=s.n_buckets, buckets=s.buckets), "score_density": self.score_density()}
        return out

    def complete(self) -> dict[str, DataFrame]:
        """All distances with the default buckets, means and deviations."""
        return self.run(DriftSettings(("cm", "ks2", "psi", "ws"), deviations=True))
