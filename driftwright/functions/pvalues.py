"""p-values of the two-sample Kolmogorov-Smirnov statistic, for small tables of statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sample size up to which paths are counted exactly.
EXACT = 10_000


def exact(d: float, n: int, m: int) -> float:
    """Share of the lattice paths from (0, 0) to (n, m) that somewhere reach a distance of ``d``.

    Paths that stay inside are followed from diagonal to diagonal, as probabilities, so no count grows out of
    range: ``inside[i]`` is the chance that a random path is at (i, s - i) and never left the band.
    """
    step = math.gcd(n, m)
    right, up = m // step, n // step  # a step to either side moves the difference by these parts of n * m / step
    h = round(d * right * n)
    if h <= 0:
        return 1.0
    inside, i = np.zeros(n + 1), np.arange(n + 1, dtype=np.float64)
    inside[0] = 1.0
    for s in range(1, n + m + 1):
        # within the band: |right * i - up * (s - i)| < h
        low, high = max(0, s - m, (up * s - h) // (right + up) + 1), min(n, s, -((-up * s - h) // (right + up)) - 1)
        if low > high:
            return 1.0
        at, left = slice(low, high + 1), n + m - s + 1
        new = inside[at] * (m - (s - 1 - i[at]))
        before = inside[max(low, 1) - 1 : high]
        new[max(low, 1) - low :] += before * (n - i[max(low, 1) - 1 : high])
        inside[max(0, low - 1) : min(n, high + 1) + 1] = 0.0
        inside[at] = new / left
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


def asymptotic(d: float, n: int, m: int) -> float:
    """Kolmogorov's limiting distribution."""
    z = math.sqrt(n * m / (n + m)) * d
    if z <= 0:
        return 1.0
    if z < 1.18:
        t = math.exp(-(math.pi**2) / (8 * z * z))
        return max(0.0, 1 - math.sqrt(2 * math.pi) / z * (t + t**9 + t**25 + t**49))
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 20)))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Exact up to ``EXACT`` values a side, else asymptotic."""
    if n <= 0 or m <= 0 or d is None or not math.isfinite(d):
        return float("nan")
    return exact(d, n, m) if max(n, m) <= EXACT else asymptotic(d, n, m)


@F.pandas_udf(T.DoubleType())
def ks_p_values(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_p_value(float(a), int(b), int(c)) for a, b, c in zip(d, n, m, strict=True)], dtype=float)
