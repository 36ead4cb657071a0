"""Smoothing of whole series: splines of a stated closeness, and season and trend by robust local regression.

A series is the rows of a key in order and is smoothed by one call in one task; all work is linear in its length, or in
its length times the width of a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Shares of a window's half width within which a weight is one, and beyond which it is none.
NEAR, FAR = 0.001, 0.999


def _walked(df: DataFrame, keys: Sequence[str], order: str, value: str, names: Sequence[str], walk: Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]]) -> DataFrame:
    """``df`` with columns that ``walk`` makes of each key's places and values in order; null where the value is."""
    place = F.unix_date(order) if dict(df.dtypes)[order] == "date" else F.col(order).cast("double")
    told = df.withColumn("at__", place.cast("double"))
    schema = StructType([*(f for f in df.schema if f.name not in names), *(StructField(n, DoubleType()) for n in names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at__", kind="stable").reset_index(drop=True)
        values = pdf[value].to_numpy(float)
        there = ~np.isnan(values)
        made = walk(pdf["at__"].to_numpy(float)[there], values[there])
        for name, own in zip(names, made):
            column = np.full(len(pdf), np.nan)
            column[there] = own
            pdf[name] = column
        return pdf[schema.names]

    return told.groupBy(*keys).applyInPandas(run, schema)


def solved_band(a: Sequence[float], b: Sequence[float], c: Sequence[float], y: Sequence[float]) -> list[float]:
    """x of a symmetric positive system with diagonals ``a``, ``b`` (next to it) and ``c`` (next but one): LDL' and back."""
    n = len(a)
    d, e, f, z = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n):
        d[i], z[i] = a[i], y[i]
        if i > 0:
            d[i] -= e[i - 1] * e[i - 1] * d[i - 1]
            z[i] -= e[i - 1] * z[i - 1]
        if i > 1:
            d[i] -= f[i - 2] * f[i - 2] * d[i - 2]
            z[i] -= f[i - 2] * z[i - 2]
        if i + 1 < n:
            e[i] = (b[i] - (f[i - 1] * d[i - 1] * e[i - 1] if i > 0 else 0.0)) / d[i]
        if i + 2 < n:
            f[i] = c[i] / d[i]
    x = [z[i] / d[i] for i in range(n)]
    for i in range(n - 2, -1, -1):
        x[i] -= e[i] * x[i + 1] + (f[i] * x[i + 2] if i + 2 < n else 0.0)
    return x


class Spline:
    """The natural cubic spline with a knot at every point that is least curved for its sum of squared residuals."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """``x`` rises; repeated places must have been averaged."""
        self.x, self.y = x, y
        h = np.diff(x)
        self.r0, self.r1 = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
        left, right = 1 / h[:-1], 1 / h[1:]
        q = np.stack([left, -left - right, right])  # a column of second divided differences, point by point
        self.q = q
        self.s0 = (q * q).sum(axis=0)
        self.s1 = q[1, :-1] * q[0, 1:] + q[2, :-1] * q[1, 1:]
        self.s2 = q[2, :-2] * q[0, 2:]
        self.qy = (q * np.stack([y[:-2], y[1:-1], y[2:]])).sum(axis=0)

    def fitted(self, stiffness: float) -> np.ndarray:
        """The values that minimise squared residuals plus ``stiffness`` times the integral of squared curvature."""
        curve = np.array(solved_band((self.r0 + stiffness * self.s0).tolist(), (self.r1 + stiffness * self.s1).tolist(), (stiffness * self.s2).tolist(), self.qy.tolist()))
        out = self.y.copy()
        for k in range(3):
            out[k : k + len(curve)] -= stiffness * self.q[k] * curve
        return out

    def rest(self, stiffness: float) -> float:
        return float(((self.y - self.fitted(stiffness)) ** 2).sum())

    def of_rest(self, s: float) -> np.ndarray:
        """The spline whose squared residuals sum to ``s``; the straight line if even its sum is less, the data if s is 0."""
        slope, at = np.polyfit(self.x - self.x.mean(), self.y, 1)
        line = at + slope * (self.x - self.x.mean())
        if s >= float(((self.y - line) ** 2).sum()):
            return line
        if s <= 0:
            return self.y.copy()
        lo, hi = -30.0, 30.0  # natural logarithms of the stiffness; the sum rises with it
        while self.rest(math.exp(hi)) < s and hi < 300:
            hi += 20
        while self.rest(math.exp(lo)) > s and lo > -300:
            lo -= 20
        for _ in range(200):
            middle = (lo + hi) / 2
            v = self.rest(math.exp(middle))
            if abs(v - s) <= 1e-9 * s or hi - lo < 1e-13:
                break
            lo, hi = (middle, hi) if v < s else (lo, middle)
        return self.fitted(math.exp(middle))


def spline_sum(values: np.ndarray, factor: float | None) -> float:
    """The sum of squares that a spline may leave: as many as there are values, or a factor of the noise that differences
    of neighbours show, for each value."""
    return float(len(values)) if factor is None else factor * float(np.var(np.diff(values))) / 2 * len(values)


def smooth_spline(x: np.ndarray, y: np.ndarray, factor: float | None) -> np.ndarray:
    """Values of the spline at ``x``; series of fewer than four places stay as they are."""
    places, own = np.unique(x, return_inverse=True)
    if len(places) < 4:
        return y.astype(float)
    means = np.bincount(own, y) / np.bincount(own)
    return Spline(places, means).of_rest(spline_sum(means, factor))[own]


def splines(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "spline", factor: float | None = None) -> DataFrame:
    """``df`` with each series' smoothing spline. ``factor``: of the noise that may be left, see ``spline_sum``."""
    return _walked(df, keys, order, value, [out], lambda x, y: [smooth_spline(x, y, factor)])


def loess(y: np.ndarray, width: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Local straight lines through the ``width`` nearest of values at 0, 1, 2..., seen from the places ``at``."""
    n = len(y)
    span = min(width, n)
    left = np.clip(np.ceil(at - (width - 1) / 2).astype(int), 0, n - span)
    j = left[:, None] + np.arange(span)
    half = np.maximum(at - left, left + span - 1 - at) + max(0, (width - n) // 2)
    r = np.abs(j - at[:, None])
    w = np.where(r <= NEAR * half[:, None], 1.0, np.where(r <= FAR * half[:, None], (1 - (r / np.maximum(half, 1e-300)[:, None]) ** 3) ** 3, 0.0))
    if weights is not None:
        w = w * weights[j]
    total = w.sum(axis=1)
    none = total <= 0
    w = w / np.where(none, 1.0, total)[:, None]
    centre = (w * j).sum(axis=1)
    spread = (w * (j - centre[:, None]) ** 2).sum(axis=1)
    sloped = np.sqrt(spread) > NEAR * (n - 1)
    tilt = np.where(sloped, (at - centre) / np.where(spread > 0, spread, 1.0), 0.0)
    w = w * (1 + tilt[:, None] * (j - centre[:, None]))
    return np.where(none, np.nan, (w * y[j]).sum(axis=1))


def _means(v: np.ndarray, n: int) -> np.ndarray:
    sums = np.cumsum(np.append(0.0, v))
    return (sums[n:] - sums[:-n]) / n


def _odd(v: float) -> int:
    n = math.ceil(v)
    return n + 1 - n % 2


def season_and_trend(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(season, trend) by Cleveland and others' procedure: values of a place in the period are smoothed over periods, a low
    pass takes the trend out of them, and what the season leaves is smoothed to the trend; large rests then lose weight."""
    n = len(y)
    low, wide = _odd(period + 1), _odd(1.5 * period / (1 - 1.5 / seasonal))
    trend, season, weights = np.zeros(n), np.zeros(n), None
    for turn in range((outer if robust else 0) + 1):
        for _ in range(inner):
            free, cycles = y - trend, np.zeros(n + 2 * period)
            for k in range(period):
                own = free[k::period]
                at = np.arange(-1.0, len(own) + 1)
                told = loess(own, seasonal, at, None if weights is None else weights[k::period])
                # beyond both ends, and wherever all weights are lost, the nearest values stand in
                gone = np.isnan(told)
                told[gone] = own[np.clip(at[gone].astype(int), 0, len(own) - 1)]
                cycles[k::period][: len(told)] = told
            drift = _means(_means(_means(cycles, period), period), 3)
            season = cycles[period : period + n] - loess(drift, low, np.arange(float(n)))
            smoothed = loess(y - season, wide, np.arange(float(n)), weights)
            trend = np.where(np.isnan(smoothed), y - season, smoothed)
        if robust and turn < outer:
            rest = np.abs(y - season - trend)
            limit = 6 * float(np.median(rest))
            share = rest / limit if limit > 0 else np.zeros(n)
            weights = np.where(share <= NEAR, 1.0, np.where(share <= FAR, (1 - share**2) ** 2, 0.0))
    return season, trend


def deseasonalised(df: DataFrame, keys: Sequence[str], order: str, value: str, period: int, robust: bool = True) -> DataFrame:
    """``df`` with season, trend and rest. A series shorter than two periods, or than 24 values, has itself as the rest."""

    def walk(_: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        if len(y) < max(2 * period, 24):
            none = np.full(len(y), np.nan)
            return [none, none, y.astype(float)]
        season, trend = season_and_trend(y, period, robust=robust)
        return [season, trend, y - season - trend]

    return _walked(df, keys, order, value, ["season", "trend", "rest"], walk)
