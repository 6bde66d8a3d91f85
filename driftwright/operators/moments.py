"""Moments of all pairs of many numeric columns in one pass, missing values left out pair by pair.

Columns are cut into tiles. A task adds up the counts, means and centred squares and products of each pair of tiles
in matrices, by a few matrix products for each Arrow batch. A batch is shifted by a value of each column near its
mean, and two results are merged by the difference of their means, so that columns far from zero lose nothing; a
column that is constant in the rows of a pair has a spread of exactly zero. Tasks return a block for each pair of
tiles, and these are merged ``FAN_IN`` at a time, so that no task gets the blocks of all others.

A task holds 64 bytes for each pair of columns, and as much for each group of ``keys`` that it meets; beyond
``HELD`` groups' blocks are sent on. At most ``4 x`` the cluster's cores tasks read the input, as each returns blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_double

TILE, FAN_IN = 128, 64
#: Pairs of columns, of all groups together, that a task holds.
HELD = 1 << 24
#: Spread by squares below which a pair is summed again around its own first value.
DOUBTFUL = 1e-3


def _again(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The cells of a block of the rows that have both, around their first values."""
    own = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[own], y[own]
    u, v = x - x[0], y - y[0]
    mu, mv = u.mean(), v.mean()
    u, v = u - mu, v - mv
    return len(x), x[0], mu, y[0], mv, u @ u, v @ v, u @ v


def batch(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The block of two tiles of columns (rows x columns, NaN where missing).

    It has n, for each side a value of the column and the mean less that value, both squares, and the products. An
    infinite value makes the products of its pairs NaN.
    """
    inf = [np.isinf(x), np.isinf(y)]
    odd = any(i.any() for i in inf)
    if odd:
        x, y = (np.where(i, np.nan, v) for i, v in zip(inf, (x, y), strict=True))
    masks, shifts, parts = [], [], []
    for v in (x, y):
        has = ~np.isnan(v)
        sums = np.where(has, v, 0.0)
        mean = sums.sum(0) / np.maximum(has.sum(0), 1)
        near = np.where(has, np.abs(v - mean), np.inf).argmin(0)
        shift = np.nan_to_num(v[near, np.arange(v.shape[1])])
        masks.append(has.astype(float))
        shifts.append(shift)
        parts.append(np.where(has, v - shift, 0.0))
    (mx, my), (a, b) = masks, parts
    if mx.all() and my.all():
        n = np.full((x.shape[1], y.shape[1]), float(len(x)))
        sx, sy, qx, qy = (np.broadcast_to(v, n.shape) for v in (a.sum(0)[:, None], b.sum(0)[None, :], (a * a).sum(0)[:, None], (b * b).sum(0)[None, :]))
    else:
        n, sx, sy, qx, qy = mx.T @ my, a.T @ my, mx.T @ b, (a * a).T @ my, mx.T @ (b * b)
    some = np.maximum(n, 1)
    dx, dy = sx / some, sy / some
    hx, hy = (np.broadcast_to(v, n.shape) for v in (shifts[0][:, None], shifts[1][None, :]))
    out = np.stack((n, hx, dx, hy, dy, qx - sx * dx, qy - sy * dy, a.T @ b - sx * dy))
    for i, j in np.argwhere((n > 0) & (((qx > 0) & (out[5] < DOUBTFUL * qx)) | ((qy > 0) & (out[6] < DOUBTFUL * qy)))):
        out[:, i, j] = _again(x[:, i], y[:, j])
    if odd:
        ix, iy = (i.astype(float) for i in inf)
        out[7][ix.T @ (my + iy) + mx.T @ iy > 0] = np.nan
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The block of the rows of two blocks. Means differ by the difference of two values and of two small numbers."""
    n = a[0] + b[0]
    part = b[0] / np.maximum(n, 1)
    hx, lx, hy, ly = (np.where(a[0] > 0, a[k], b[k] if k % 2 else 0.0) for k in (1, 2, 3, 4))
    dx, dy, w = (b[1] - hx) + (b[2] - lx), (b[3] - hy) + (b[4] - ly), a[0] * part
    return np.stack((n, hx, lx + dx * part, hy, ly + dy * part, a[5] + b[5] + dx * dx * w, a[6] + b[6] + dy * dy * w, a[7] + b[7] + dx * dy * w))


def _blocks(keys: list[str], width: int):
    tiles = [(lo, min(lo + TILE, width)) for lo in range(0, width, TILE)]
    pairs = [(a, b) for a in range(len(tiles)) for b in range(a, len(tiles))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        slot, types = TaskContext.get().partitionId(), []

        def sent() -> Iterator[pa.RecordBatch]:
            for key, own in held.items():
                for (a, b), block in zip(pairs, own, strict=True):
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, types, strict=True)), pa.array([slot], pa.int32()), pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([block.tobytes()])], [*keys, "slot", "a", "b", "block"])
            held.clear()

        for rows in batches:
            types = [rows.schema.field(k).type for k in keys]
            values = np.stack([rows[f"_{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(width)], axis=1)
            groups: dict[tuple, list[int]] = {}
            if keys:
                for i, key in enumerate(zip(*(rows[k].to_pylist() for k in keys), strict=True)):
                    groups.setdefault(key, []).append(i)
            elif len(values):
                groups[()] = slice(None)
            for key, at in groups.items():
                own = values[at]
                new = [batch(own[:, slice(*tiles[a])], own[:, slice(*tiles[b])]) for a, b in pairs]
                held[key] = [merged(x, y) for x, y in zip(held[key], new, strict=True)] if key in held else new
                if len(held) * width * width > HELD and len(held) > 1:
                    yield from sent()
        yield from sent()

    return run


def _fold(table: pa.Table) -> pa.Table:
    out = None
    for block in table["block"].to_pylist():
        own = np.frombuffer(block).reshape(8, -1)
        out = own if out is None else merged(out, own)
    return table.slice(0, 1).set_column(table.schema.get_field_index("block"), "block", pa.array([out.tobytes()]))


def _rows(keys: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lo, hi = b["a"][k].as_py() * TILE, b["b"][k].as_py() * TILE
                rows, columns = min(TILE, len(names) - lo), min(TILE, len(names) - hi)
                n, _, _, _, _, xx, yy, xy = np.frombuffer(b["block"][k].as_py()).reshape(8, rows, columns)
                i, j = np.nonzero(lo + np.arange(rows)[:, None] < hi + np.arange(columns))
                n, xx, yy, xy = (v[i, j] for v in (n, xx, yy, xy))
                known = (n > 1) & (xx > 0) & (yy > 0) & np.isfinite(xy)
                r = np.clip(xy / np.sqrt(np.where(known, xx, 1.0)) / np.sqrt(np.where(known, yy, 1.0)), -1, 1)
                i, j = i + lo, j + hi
                own = [pa.repeat(b[c][k], len(i)) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array([names[x] for x in i], pa.string()), pa.array([names[x] for x in j], pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(r, mask=~known)], [*keys, "feature_1", "feature_2", "position_1", "position_2", "r"])

    return run


def pearson(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature_1, feature_2, position_1, position_2, r): Pearson's r of all pairs of ``names``, null where undefined.

    The input is read once, however many columns there are.
    """
    names, own = list(names), [f"_key{i}" for i in range(len(keys))]
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    wide = df.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, own, strict=True)], *[as_double(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)])
    typed = "".join(f"{k} {t}, " for k, t in wide.dtypes[: len(own)])
    blocks = wide.coalesce(tasks).mapInArrow(_blocks(own, len(names)), f"{typed}slot int, a int, b int, block binary")
    slots = tasks
    while slots > 1:
        slots = math.ceil(slots / FAN_IN)
        blocks = blocks.withColumn("slot", (F.col("slot") % slots).cast("int")).groupBy(*own, "a", "b", "slot").applyInArrow(_fold, blocks.schema)
    out = blocks.mapInArrow(_rows(own, names), f"{typed}feature_1 string, feature_2 string, position_1 int, position_2 int, r double")
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, own, strict=True)], "feature_1", "feature_2", "position_1", "position_2", "r")
