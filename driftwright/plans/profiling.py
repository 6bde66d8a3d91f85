"""Profile of one table, or of all its segments in the same jobs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kinds
from ..operators import correlate, describe, distribute, segment
from ..sources import prepare

Progress = Callable[[str, float], None]
#: The analyses of a run; settings may name some of them.
ANALYSES = ("describe", "missing", "correlations", "distributions", "boxes")


@dataclass(frozen=True)
class ProfilingSettings:
    features: tuple[str, ...] | None = None
    analyses: tuple[str, ...] = ANALYSES
    correlation_methods: tuple[str, ...] = ("kendall",)
    correlation_threshold: float = 0.65
    binning: str = distribute.EQUAL_WIDTH
    n_bins: int = 8
    max_categories: int = 30
    sample_percent: float = 100.0
    max_correlation_rows: int | None = None
    seed: int = 0

    @classmethod
    def interactive(cls, **changes) -> ProfilingSettings:
        """What an interactive session starts from: Spearman's correlations and ten bins."""
        return cls(**{"correlation_methods": ("spearman",), "n_bins": 10, **changes})

    def check(self) -> None:
        for name in ("n_bins", "max_categories", "seed"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int):
                raise TypeError(f"{name} must be an integer")
        if self.n_bins < 1 or self.max_categories < 1:
            raise ValueError("n_bins and max_categories must be at least 1")
        if not 0 <= self.correlation_threshold <= 1:
            raise ValueError("correlation_threshold must be within 0 and 1")
        if not 0 < self.sample_percent <= 100:
            raise ValueError("sample_percent must be above 0 and at most 100")
        if self.binning not in (distribute.EQUAL_WIDTH, distribute.QUANTILE):
            raise ValueError(f"unknown binning {self.binning!r}")
        strange = [a for a in self.analyses if a not in ANALYSES]
        if strange or not self.analyses:
            raise ValueError(f"unknown analyses {strange}; known: {ANALYSES}" if strange else "no analysis is chosen")
        unknown = [m for m in self.correlation_methods if m.lower() not in correlate.METHODS]
        if unknown:
            raise ValueError(f"unknown correlation methods {unknown}")
        if self.max_correlation_rows is not None and self.max_correlation_rows < 2:
            raise ValueError("max_correlation_rows must be at least 2")

    def key(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass
class ProfilingResult:
    """Result tables by name, evaluated when they are read, with what was done. Segments are a column of each."""

    tables: dict[str, DataFrame]
    settings: ProfilingSettings
    features: list[str]
    numeric: list[str]
    notes: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    dataset: str = "dataset"
    grouping: segment.Grouping | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def of_segment(self, key: str) -> dict[str, DataFrame]:
        """The tables of one segment."""
        if self.grouping is None:
            raise ValueError("the profile has no segments")
        return {n: t.where(F.col(segment.SEGMENT) == key) for n, t in self.tables.items() if segment.SEGMENT in t.columns}

    def correlation_comparison(self, method: str, segments: Sequence[str], *, min_abs: float = 0.0) -> DataFrame:
        return correlate.compare(self.tables["correlations"].where(F.col("method") == method), segment.SEGMENT, segments, min_abs=min_abs)

    def metadata(self) -> dict:
        spark = SparkSession.active()
        return {"dataset": self.dataset, "settings": asdict(self.settings), "features": self.features, "numeric_features": self.numeric, "notes": self.notes, "seconds": self.seconds, "environment": {"spark": spark.version, "master": spark.sparkContext.master}}


def run_profiling(
    data: DataFrame | Mapping[str, DataFrame],
    settings: ProfilingSettings | None = None,
    *,
    by: str | None = None,
    bins: Sequence[tuple[float, float]] | None = None,
    n_bins: int | None = None,
    n_quantiles: int | None = None,
    tag: str = "Dataset",
    dataset: str = "dataset",
    include_grouping_column: bool = False,
    progress: Progress | None = None,
) -> ProfilingResult:
    """Describe, missing values, correlations, distributions and boxes of ``data``.

    Several tables are stacked, with their origin in ``tag``, which is the segment if nothing else is. Segments
    are a key of every aggregation, so that any number of them takes as many jobs as one.
    """
    settings, notes, seconds = settings or ProfilingSettings(), [], {}
    settings.check()
    tell = progress or (lambda label, share: None)
    combined = isinstance(data, Mapping)
    frame = prepare.combine(data, tag) if combined else data
    kinds.unique_columns(frame)
    by = by or (tag if combined else None)
    grouping = segment.make_grouping(frame, by, bins=bins, n_bins=n_bins, n_quantiles=n_quantiles) if by else None
    if grouping:
        frame = grouping.assigned
    hidden = {tag, segment.SEGMENT, "_order"} if combined else {segment.SEGMENT, "_order"}
    if by and not include_grouping_column:
        hidden.add(by)
    wanted = list(settings.features or [c for c in frame.columns if c not in hidden])
    missing = [c for c in wanted if c not in frame.columns]
    if missing:
        notes.append(f"features not found: {', '.join(missing)}")
    features = [c for c in wanted if c not in missing]
    if not features:
        raise ValueError("none of the features is in the table")
    keys = [segment.SEGMENT] if grouping else []
    frame = frame.select(*keys, *[F.col(f"`{c}`") for c in features])
    if settings.sample_percent < 100:
        frame = prepare.sample(frame, percent=settings.sample_percent, seed=settings.seed, by=keys)
    numeric = kinds.columns_of(frame, kinds.NUMERIC, features)
    text = kinds.columns_of(frame, kinds.CATEGORICAL, features)
    skipped = [c for c in features if c not in numeric and c not in text]
    if skipped:
        notes.append(f"no distribution for {', '.join(skipped)}")
    tables: dict[str, DataFrame] = {}

    def step(name: str, share: float, make: Callable[[], DataFrame | None]) -> None:
        began = time.monotonic()
        tell(name, share)
        found = make()
        if found is not None:
            tables[name] = found
        seconds[name] = round(time.monotonic() - began, 3)

    chosen = set(settings.analyses)
    described, shown = "describe" in chosen, "distributions" in chosen
    step("describe", 0.1, lambda: describe.describe(frame, numeric, keys) if described and numeric else None)
    discrete = [c for c in features if c not in numeric]
    step("describe_discrete", 0.2, lambda: describe.describe_discrete(frame, discrete, keys) if described and discrete else None)
    step("missing", 0.3, lambda: describe.missing_counts(frame, features, keys) if "missing" in chosen else None)
    methods = settings.correlation_methods if "correlations" in chosen else ()
    if len(numeric) >= 2 and methods:
        rows = frame if settings.max_correlation_rows is None else prepare.sample(frame, rows=settings.max_correlation_rows, seed=settings.seed, by=keys)
        step("correlations", 0.4, lambda: correlate.correlate_all(rows, methods, numeric, keys))
        step("top_correlations", 0.6, lambda: correlate.top_pairs(tables["correlations"], settings.correlation_threshold))
    elif methods:
        notes.append("correlation needs two numeric features")
    step("distributions", 0.7, lambda: distribute.histogram(frame, numeric, binning=settings.binning, n_bins=settings.n_bins, keys=keys) if shown and numeric else None)
    step("categories", 0.8, lambda: distribute.category_counts(frame, text, max_categories=settings.max_categories, keys=keys) if shown and text else None)
    step("boxes", 0.9, lambda: distribute.box_summary(frame, numeric, keys=keys) if "boxes" in chosen and numeric else None)
    if grouping:
        tables["segments"] = grouping.sizes().where(F.col(segment.SEGMENT).isNotNull()).withColumn("n_features", F.lit(len(features)))
        lost = grouping.frame.where(F.col(segment.SEGMENT).isNull()).count()
        if lost:
            notes.append(f"{lost} rows belong to no segment")
        if by in grouping.frame.columns and len(grouping.frame.select(F.col(f"`{by}`")).where(F.col(f"`{by}`").isNotNull()).distinct().take(2)) == 1:
            notes.append(f"the grouping column {by} is constant")
    tell("done", 1.0)
    return ProfilingResult(tables, settings, features, numeric, notes, seconds, dataset, grouping)
