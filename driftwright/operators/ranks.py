"""Average ranks of cells by their place in a sort, without a join by value.

Cells (pos, grp, g, value) are dealt out in ranges of (grp, g, value, pos) and sorted in each partition, so that a
value with a third of all rows is spread like any other. A task numbers the runs of equal values of its partition.
How many cells of a group lie in the partitions before is a running sum over a small table, a row for each
partition and group; runs at a partition's ends, which may go on in the next, are added up in another, of two rows
for each partition. Cells get both by their partition, never by their value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

RUNS = "pos long, grp string, g int, value double, part int, before long, run long, edge int"


def _changes(values: pa.Array, last: object) -> np.ndarray:
    """Where a value differs from the one before; the first one from ``last``."""
    out = np.empty(len(values), bool)
    out[0] = last is None or values[0].as_py() != last
    out[1:] = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
    return out


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of sorted cells: the run's cells, those of its group before it, and whether it is the first (1) or last (2) of all.

    The last run of a batch may go on, so the positions of its cells wait; they are eight bytes each.
    """
    part, seen, group_at = TaskContext.get().partitionId(), 0, 0
    waiting: list[np.ndarray] = []
    head: tuple | None = None  # grp, g, value, before and edge of the run that waits

    def rows(pos, grp, g, value, before, run, edge) -> pa.RecordBatch:
        n = len(pos)
        return pa.RecordBatch.from_arrays([pa.array(pos), grp, pa.array(g, pa.int32()), pa.array(value), pa.array(np.full(n, part, np.int32)), pa.array(before), pa.array(run), pa.array(edge, pa.int32())], ["pos", "grp", "g", "value", "part", "before", "run", "edge"])

    def flushed(last: int) -> pa.RecordBatch:
        grp, g, value, before, edge = head
        pos = np.concatenate(waiting)
        n = len(pos)
        return rows(pos, pa.repeat(pa.scalar(grp, pa.string()), n), np.full(n, g), np.full(n, value), np.full(n, before), np.full(n, n), np.full(n, edge | last))

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        pos, g, value = (b[c].to_numpy() for c in ("pos", "g", "value"))
        groups = _changes(b["grp"], head and head[0]) | _changes(b["g"], head and head[1])
        starts = np.flatnonzero(groups | _changes(b["value"], head and head[2]))
        if not len(starts):
            waiting.append(pos)
            seen += n
            continue
        at = seen + starts
        begun = np.maximum.accumulate(np.where(groups[starts], at, group_at))
        before, edge = at - begun, np.zeros(len(starts), np.int64)
        if head is None:
            edge[0] = 1
        else:
            waiting.append(pos[: starts[0]])
            yield flushed(0)
        lo, hi = starts[0], starts[-1]
        size = np.diff(starts)
        if hi > lo:
            yield rows(pos[lo:hi], b["grp"].slice(lo, hi - lo), g[lo:hi], value[lo:hi], np.repeat(before[:-1], size), np.repeat(size, size), np.repeat(edge[:-1], size))
        head, waiting, group_at, seen = (b["grp"][int(hi)].as_py(), int(g[hi]), float(value[hi]), int(before[-1]), int(edge[-1])), [pos[hi:]], int(begun[-1]), seen + n
    if head is not None:
        yield flushed(2)


def average(cells: DataFrame, scratch: Scratch, *, partitions: int | None = None) -> DataFrame:
    """(pos, grp, g, rank) of ``cells`` (pos long, grp string, g int, value double), none of them null.

    Equal values of a group (grp, g) have the mean of their ranks. ``cells`` is read twice, as ranges are found by a
    sample, so its positions must be those of a table.
    """
    n = partitions or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("grp", "g", "value", "pos")
    local = scratch.table(cells.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(numbered, RUNS), "runs")
    group = ["grp", "g"]
    sizes = local.groupBy(*group, "part").agg(F.count("*").alias("c"))
    offsets = scratch.table(sizes.select(*group, "part", (F.sum("c").over(Window.partitionBy(*group).orderBy("part")) - F.col("c")).alias("offset")), "offsets")
    ends = local.where("edge > 0").groupBy(*group, "part", "edge", "value").agg(F.first("run").alias("run"), F.first("before").alias("before")).join(offsets, [*group, "part"])
    whole = Window.partitionBy(*group, "value")
    ends = ends.select(*group, "part", "edge", F.min(F.col("offset") + F.col("before")).over(whole).alias("less"), F.sum("run").over(whole).alias("equal"))
    ends = ends.groupBy(*group, "part").agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct("less", "equal")))).alias("ends"))
    known = scratch.table(offsets.join(ends, [*group, "part"], "left"), "known")  # a row for each partition and group
    own = F.col("ends")[F.col("edge")]
    rank = F.when(F.col("edge") == 0, F.col("offset") + F.col("before") + (F.col("run") + 1) / 2.0).otherwise(own["less"] + (own["equal"] + 1) / 2.0)
    return local.join(known, [*group, "part"]).select("pos", *group, rank.alias("rank"))
