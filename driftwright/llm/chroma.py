"""Audio fingerprints from chroma, and the alignment of recordings.

A recording's spectrum is folded into twelve pitch classes for each frame. Sixteen rectangular filters, read
from an integral image over frames and pitch classes, compare two halves of a patch; each response becomes two
bits of Gray code, together an unsigned 32-bit integer for each frame. Recordings are candidates if they share,
at any offset, the steadiest bits of ``KEY_FRAMES`` integers that stand ``KEY_STEP`` frames apart: noise and cuts
between frames flip others first, so pairs of up to ``MOST_ERRORS`` differing bits meet (tests measure it against
all pairs). The offsets at which two recordings agree in their steady bits form a histogram; at its peak the share
of differing bits over the overlap decides.

Null and empty recordings, and those shorter than a filter, have no fingerprint and are classes of their own.
A recording that is shorter than a key has its whole fingerprint as key, so it meets its copies only. Ties between
offsets go to the smallest shift, then to the negative one. Very long recordings are read
in full. Repeated rows are copies. An empty table has an empty result. Columns other than the id and the
media column aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Scratch, connected_components, linked_classes

RATE, FRAME, HOP = 8000, 1024, 512
WIDTH = 8
LEAST_OVERLAP, MOST_ERRORS = 24, 0.15
#: A key takes so many integers, so many frames apart. Another integer makes chance meetings about seven times rarer.
KEY_FRAMES, KEY_STEP = 4, 9
#: Bits by how seldom noise and cuts between frames flip them: signs of pitch comparisons come first.
STEADY = (17, 9, 21, 5, 29, 25, 13, 1, 3, 7, 23, 4, 16, 19, 20, 8)
KEY_BITS = 10


@lru_cache(1)
def pitch_classes() -> np.ndarray:
    """Weight of each spectral bin in each pitch class, from 110 Hz to 3520 Hz."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    use = (hz >= 110) & (hz <= 3520)
    out[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x pitch classes, each frame of unit length."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    out = []
    for lo in range(0, len(frames), 512):
        power = np.abs(np.fft.rfft(frames[lo : lo + 512] * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
        out.append(power @ pitch_classes())
    own = np.concatenate(out)
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)


def filters() -> list[tuple[tuple[int, int, int, int], tuple[int, int, int, int]]]:
    """The two patches (frame, pitch class, frames, pitch classes) that each filter compares, from a rule."""
    out = []
    for k in range(16):
        low, high = (5 * k) % 9, 1 + k % 3
        if k % 2:  # pitch against the pitches above it
            out.append(((0, low, WIDTH, high), (0, low + high if low + 2 * high <= 12 else low - high, WIDTH, high)))
        else:  # earlier against later
            half = 1 + (k // 2) % (WIDTH // 2)
            out.append(((0, low, half, high + 1), (WIDTH - half, low, half, high + 1)))
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """An unsigned 32-bit integer for each frame at which the filters fit."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)
    out = np.zeros(n, np.uint32)
    for patches in filters():
        a, b = (total[at + f + fs, p + ps] - total[at + f, p + ps] - total[at + f + fs, p] + total[at + f, p] for f, p, fs, ps in patches)
        level = np.searchsorted([-0.25, 0.0, 0.25], np.log((1 + a) / (1 + b)))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def steady(own: np.ndarray, bits: int) -> np.ndarray:
    """The integers with their ``bits`` steadiest bits alone."""
    return own & np.uint32(sum(1 << b for b in STEADY[:bits]))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """Offset of ``b`` in ``a``, overlap in frames and share of differing bits, at the histogram's peak."""
    if not len(a) or not len(b):
        return None
    wide, a, b = (a, b), steady(a, len(STEADY)), steady(b, len(STEADY))
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    count = hi - lo
    if not count.sum():
        return None
    # counts of each offset, without listing the pairs of a repeated integer all at once
    histogram = np.zeros(len(a) + len(b), np.int64)
    for step in range(int(count.max())):
        j = np.flatnonzero(count > step)
        histogram += np.bincount(order[lo[j] + step] - j + len(b), minlength=len(histogram))
    best = np.flatnonzero(histogram == histogram.max()) - len(b)
    offset = int(best[np.lexsort((best, np.abs(best)))[0]])
    x, y = wide[0][max(0, offset) :], wide[1][max(0, -offset) :]
    n = min(len(x), len(y))
    return (offset, n, float(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n))) if n else None


def pcm16(media: bytes | None) -> np.ndarray:
    """Samples of 16-bit little-endian PCM at ``RATE``."""
    own = media or b""
    return np.frombuffer(own[: len(own) // 2 * 2], "<i2") / np.float32(32768)


def _fingerprints(decode: Callable[[Any], np.ndarray]):
    @F.pandas_udf(T.BinaryType())
    def pack(media: pd.Series) -> pd.Series:
        # one recording is decoded at a time
        return pd.Series([fingerprint(decode(m)).astype("<u4").tobytes() for m in media], dtype=object)

    return pack


def keys(own: np.ndarray) -> np.ndarray:
    """The distinct keys of a fingerprint; those between whose integers nothing changes count only if there are no others."""
    n = len(own) - (KEY_FRAMES - 1) * KEY_STEP
    if n <= 0:
        parts = own[:, None].astype(np.uint64)
    else:
        parts = np.stack([steady(own[k * KEY_STEP : k * KEY_STEP + n], KEY_BITS) for k in range(KEY_FRAMES)]).astype(np.uint64)
        moves = (parts[1:] != parts[:-1]).any(0)
        parts = parts[:, moves] if moves.any() else parts
    h = np.full(parts.shape[1], len(parts), np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            h = tv.mix(h * np.uint64(31) + part)
    return np.unique(h.astype(np.int64))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(packed: pd.Series) -> pd.Series:
    return pd.Series([keys(np.frombuffer(p, "<u4")) for p in packed], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("shift", T.IntegerType()), T.StructField("overlap", T.IntegerType()), T.StructField("errors", T.DoubleType())]))
def _align(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    rows = [align(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) or (None, 0, 1.0) for a, b in zip(left, right, strict=True)]
    return pd.DataFrame(rows, columns=["shift", "overlap", "errors"])


def classes(df: DataFrame, *, id_: str = "id", media: str | Column = "media", decode: Callable[[Any], np.ndarray] = pcm16, least_overlap: int = LEAST_OVERLAP, most_errors: float = MOST_ERRORS) -> DataFrame:
    """A row for each recording: its class, the class's size, and how it aligns with an anchor of its class.

    ``decode`` makes samples at ``RATE`` of a value of the media column.
    Links join recordings of different fingerprints that overlap by ``least_overlap`` frames or more with at
    most ``most_errors`` of the bits differing; classes are their connected components, named by the least id.
    ``anchor`` is the best aligned of the linked recordings that it was compared with, which are leaders of keys
    and not the whole class; ``offset`` is where the recording begins in it, in frames.
    """
    kept, work = Scratch(df.sparkSession, "recordings"), Scratch(df.sparkSession, "chroma")
    column = F.col(media) if isinstance(media, str) else media
    rows = kept.table(df.select(F.col(id_).alias("id"), _fingerprints(decode)(column).alias("print")).withColumn("node", F.xxhash64("print")), "prints")
    try:
        sound = rows.where(F.length("print") > 0)
        nodes = work.table(sound.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("print").alias("print")), "nodes")
        members = nodes.select(F.explode(_keys("print")).alias("bucket"), "node", F.lit(0.0).alias("rank"))

        def verify(pairs: DataFrame) -> DataFrame:
            a, b = (nodes.select(F.col("node").alias(k), F.col("print").alias(v)) for k, v in (("a", "x"), ("b", "y")))
            both = pairs.join(a, "a").join(b, "b").select("a", "b", _align("x", "y").alias("m")).select("a", "b", "m.*")
            return both.withColumn("similarity", F.lit(None).cast("double")).withColumn("holds", (F.col("overlap") >= least_overlap) & (F.col("errors") <= most_errors))

        linked = linked_classes(members, verify, work)
        if linked:
            both = linked[1].select("a", "b", "shift", "errors").union(linked[1].select(F.col("b").alias("a"), F.col("a").alias("b"), -F.col("shift"), "errors"))
            # seen from b: where it begins in a
            best = both.join(nodes.select(F.col("node").alias("a"), "rep"), "a").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("errors", "rep", "shift")).alias("best"))
            whole = nodes.select("node", "rep", "n").join(linked[0], "node", "left").join(best, "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            none = F.lit(None).cast(T.StructType([T.StructField("errors", T.DoubleType()), nodes.schema["rep"], T.StructField("shift", T.IntegerType())]))
            whole = nodes.select("node", "rep", "n", F.col("node").alias("component"), none.alias("best"))
        whole = work.table(whole, "whole")
        # by itself, so that the join can be split where a class is large
        named = work.table(whole.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size")), "components")
        final = kept.table(whole.join(named, "component").select("node", "class_id", "class_size", F.col("best.rep").alias("anchor"), F.col("best.shift").alias("offset"), F.round("best.errors", 6).alias("bit_error_rate")), "named")
    finally:
        work.drop()
    out = rows.select("id", "node").join(final, "node", "left")
    return out.select("id", F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "anchor", "offset", "bit_error_rate")


@lru_cache(1)
def _tones() -> np.ndarray:
    t = np.arange(FRAME) / RATE
    tones = np.stack([sum(np.sin(2 * np.pi * 220 * h * 2 ** (p / 12) * t) / h for h in (1, 2, 3)) for p in range(12)])
    return (tones / np.abs(tones).max()).astype(np.float32)


def melody(vector: list[float] | None) -> np.ndarray:
    """A recording of a vector: one tone of ``FRAME`` samples for each component, whose size picks the pitch.

    Stands in for stored audio where a table holds none: equal vectors sound alike, close ones nearly.
    """
    v = np.nan_to_num(np.asarray([] if vector is None else [0 if x is None else x for x in vector], np.float64))
    scale = np.sqrt((v**2).mean()) if len(v) else 0
    # the logistic approximation of the normal distribution spreads the pitches evenly
    pitch = np.minimum(11, (12 / (1 + np.exp(-1.702 * v / scale))).astype(int)) if scale else np.zeros(len(v), int)
    return _tones()[pitch].ravel()


def excerpt(parts: list[list[float] | None] | None) -> np.ndarray:
    """The recording of the vector that leads ``parts``; if a second one follows, its two numbers are the first sample and how many."""
    if parts is None or not len(parts):
        return melody(None)
    whole = melody(parts[0])
    if len(parts) == 1:
        return whole
    first, n = (int(x) for x in parts[1])
    return whole[first : first + n]
