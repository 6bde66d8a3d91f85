"""Exact quantiles by radix selection: a few passes that count digits, whatever the number of distinct values.

A double's bits, with the sign turned, are ordered as unsigned integers. A pass counts the next 16 bits of the values
that share the leading bits of a wanted order statistic, for all columns, groups and probabilities together, and so
finds 16 bits more of each. Counts carry the least and greatest value, and a statistic whose values are all equal is
found: whole numbers and amounts take one to three passes, no value more than four. What is shuffled is at most
65,536 counts for each task, column and leading bits; which bits are wanted, a row for each statistic, goes to the
tasks by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import as_double, between, finite
from ..scratch import Scratch

DIGIT, PASSES = 16, 4
#: Counts that a task holds before it sends them on.
HELD = 1 << 20
COUNTS = "grp string, g int, path long, n long, lo double, hi double"


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return bits.view(np.uint64) ^ ((bits >> 63).view(np.uint64) | np.uint64(1 << 63))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts (slot, path, n, lo, hi) of equal slots and paths in one row, in order."""
    slot, path, n, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((path, slot))
    slot, path = slot[order], path[order]
    first = np.flatnonzero(np.concatenate(([True], (slot[1:] != slot[:-1]) | (path[1:] != path[:-1])))) if len(slot) else np.zeros(0, np.int64)
    if not len(first):
        return slot, path, n, lo, hi
    return slot[first], path[first], np.add.reduceat(n[order], first), np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)


def _digits(width: int, step: int, wanted):
    """Counts of the digits after those of ``wanted``: (grp, g) -> sorted leading bits."""
    shift = np.uint64(64 - DIGIT * (step + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leading = wanted.value if step else {}
        codes: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def sent(counts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            slot, path, n, lo, hi = counts
            names = np.array(list(codes), object)
            return pa.RecordBatch.from_arrays([pa.array(names[slot // width] if len(slot) else [], pa.string()), pa.array((slot % width).astype(np.int32)), pa.array(path.view(np.int64)), pa.array(n), pa.array(lo), pa.array(hi)], ["grp", "g", "path", "n", "lo", "hi"])

        size = 0
        for b in batches:
            named = b["grp"].dictionary_encode()
            own = np.array([codes.setdefault(x, len(codes)) for x in named.dictionary.to_pylist()], np.int64)[named.indices.to_numpy()]
            for g in range(width):
                values = b[f"_{g}"].to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(values)
                values, slot = values[known], own[known] * width + g
                key = ordered(values)
                if step:
                    keep = np.zeros(len(key), bool)
                    head = key >> (shift + np.uint64(DIGIT))
                    for grp, code in codes.items():
                        prefixes = leading.get((grp, g))
                        if prefixes is not None:
                            at = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                            keep |= (slot == code * width + g) & (prefixes[at] == head)
                    values, slot, key = values[keep], slot[keep], key[keep]
                held.append(_summed([(slot, key >> shift, np.ones(len(key), np.int64), values, values)]))
                size += len(held[-1][0])
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield sent(held[0])
                    held, size = [], 0
        if held:
            yield sent(_summed(held))

    return run


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = (), *, only_finite: bool = False) -> DataFrame:
    """(keys, feature, total, quantiles): the quantiles of each column, linear between order statistics, as an array.

    Missing values are left out, and infinite ones if ``only_finite``; columns without values have no row. ``df`` is
    read once in each pass.
    """
    spark, own = df.sparkSession, [f"_key{i}" for i in range(len(keys))]
    clean = finite if only_finite else as_double
    grp = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("")
    wide = df.select(grp.alias("grp"), *[F.col(f"`{k}`").alias(a) for k, a in zip(keys, own, strict=True)], *[clean(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)])
    scratch = Scratch(spark, "quantiles")
    cells = wide.select("grp", *[f"_{i}" for i in range(len(columns))])
    group = ["grp", "g"]

    def counted(step: int, wanted) -> DataFrame:
        counts = cells.mapInArrow(_digits(len(columns), step, wanted), COUNTS).groupBy(*group, "path").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return counts.withColumn("head", F.shiftrightunsigned("path", DIGIT) if step else F.lit(0).cast("long"))

    def found(counts: DataFrame, ranks: DataFrame) -> DataFrame:
        """One digit more of each of ``ranks`` (grp, g, total, k, head, rest)."""
        along = Window.partitionBy(*group, "head").orderBy(F.col("path").bitwiseAND((1 << DIGIT) - 1))
        cum = counts.withColumn("upto", F.sum("n").over(along))
        at = (F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n"))
        own_ = ranks.join(cum, [*group, "head"]).where(at)
        return own_.select(*group, "total", "k", F.col("path").alias("head"), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"))

    first = scratch.table(counted(0, None), "counts-0")
    at = [F.lit(float(q)) * (F.col("total") - 1) for q in probabilities]
    ends = F.array(*[F.struct(F.lit(2 * i + j).alias("k"), end(a).cast("long").alias("rest")) for i, a in enumerate(at) for j, end in enumerate((F.floor, F.ceil))])
    ranks = first.groupBy(*group).agg(F.sum("n").alias("total")).select(*group, "total", F.inline(ends)).withColumn("head", F.lit(0).cast("long"))
    ranks = scratch.table(found(first, ranks), "ranks-0")
    done = ranks.where("value is not null")
    for step in range(1, PASSES):
        # a row for each statistic that isn't known yet
        rest = ranks.where("value is null").select(*group, "head").distinct().collect()
        if not rest:
            break
        leading: dict[tuple[str, int], list[int]] = {}
        for r in rest:
            leading.setdefault((r["grp"], r["g"]), []).append(r["head"])
        wanted = spark.sparkContext.broadcast({k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in leading.items()})
        ranks = scratch.table(found(counted(step, wanted), ranks.where("value is null").select(*group, "total", "k", "head", "rest")), f"ranks-{step}")
        done = done.union(ranks.where("value is not null"))
    values = done.groupBy(*group).agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("v"))
    both = [between(F.col("v")[2 * i], F.col("v")[2 * i + 1], a - F.floor(a)) for i, a in enumerate(at)]
    names = F.array(*[F.lit(c) for c in columns])
    out = values.select("grp", F.get(names, F.col("g")).alias("feature"), "total", F.array(*both).alias("quantiles"))
    if not keys:
        return out.drop("grp")
    return out.join(wide.select("grp", *own).distinct(), "grp").select(*[F.col(a).alias(k) for k, a in zip(keys, own, strict=True)], "feature", "total", "quantiles")
