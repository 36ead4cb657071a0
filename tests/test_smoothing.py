import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import smoothing


def noisy(n, seed=1, sd=0.5):
    rng = np.random.default_rng(seed)
    return np.sin(np.arange(n) / 6) * 3 + rng.normal(0, sd, n)


def dense_spline(x, y, stiffness):
    """The same minimum from full matrices."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    return np.linalg.solve(np.eye(n) + stiffness * q @ np.linalg.solve(r, q.T), y)


@pytest.mark.parametrize("stiffness", [1e-3, 1.0, 1e4])
def test_spline_equals_the_dense_one(stiffness):
    x = np.cumsum(np.random.default_rng(2).uniform(0.3, 2, 60))
    y = noisy(60)
    assert np.allclose(smoothing.Spline(x, y).fitted(stiffness), dense_spline(x, y, stiffness))


@pytest.mark.parametrize("n,factor", [(30, 1.0), (200, 1.0), (200, 0.2), (1000, 2.0)])
def test_rest_is_the_stated_sum(n, factor):
    y = noisy(n)
    got = smoothing.smooth_spline(np.arange(n, dtype=float), y, factor)
    s = smoothing.spline_sum(y, factor)
    assert math.isclose(((got - y) ** 2).sum(), s, rel_tol=1e-6) and math.isclose(s, factor * np.var(np.diff(y)) / 2 * n)


def test_spline_limits():
    x = np.arange(40.0)
    y = noisy(40)
    line = np.polyval(np.polyfit(x, y, 1), x)
    assert np.allclose(smoothing.Spline(x, y).of_rest(1e9), line) and np.allclose(smoothing.Spline(x, y).of_rest(0), y)
    assert np.allclose(smoothing.smooth_spline(x[:3], y[:3], 1.0), y[:3])
    twice = smoothing.smooth_spline(np.r_[x, x], np.r_[y, y + 1], 0.5)
    assert np.allclose(twice[:40], twice[40:])


def plain_loess(y, width, x, weights=None):
    """One place at a time, with a weighted least squares fit."""
    n = len(y)
    span = min(width, n)
    left = min(max(math.ceil(x - (width - 1) / 2), 0), n - span)
    half = max(x - left, left + span - 1 - x) + max(0, (width - n) // 2)
    w = np.zeros(n)
    for j in range(left, left + span):
        r = abs(j - x)
        w[j] = 1.0 if r <= 0.001 * half else (1 - (r / half) ** 3) ** 3 if r <= 0.999 * half else 0.0
        w[j] *= 1 if weights is None else weights[j]
    if w.sum() <= 0:
        return None
    j, w = np.arange(n), w / w.sum()
    centre = (w * j).sum()
    slope = (w * (j - centre) * y).sum() / spread if math.sqrt(spread := (w * (j - centre) ** 2).sum()) > 0.001 * (n - 1) else 0.0
    return (w * y).sum() + slope * (x - centre)


@pytest.mark.parametrize("n,width", [(30, 7), (30, 29), (9, 15), (60, 13)])
def test_loess_equals_plain_fits(n, width):
    y, at = noisy(n), np.arange(-1.0, n + 1)
    weights = np.random.default_rng(1).uniform(0.1, 1, n)
    for w in (None, weights):
        assert np.allclose(smoothing.loess(y, width, at, w), [plain_loess(y, width, x, w) for x in at])


def plain_stl(y, period, seasonal=7, inner=2, outer=15):
    n, odd = len(y), lambda v: math.ceil(v) + (math.ceil(v) + 1) % 2
    low, wide = odd(period + 1), odd(1.5 * period / (1 - 1.5 / seasonal))
    trend, weights = np.zeros(n), np.ones(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            free, cycles = y - trend, np.zeros(n + 2 * period)
            for k in range(period):
                own, w = free[k::period], weights[k::period]
                for i, x in enumerate(range(-1, len(own) + 1)):
                    v = plain_loess(own, seasonal, x, w)
                    cycles[k + i * period] = own[min(max(x, 0), len(own) - 1)] if v is None else v
            mean = lambda v, m: np.array([v[i : i + m].mean() for i in range(len(v) - m + 1)])
            drift = mean(mean(mean(cycles, period), period), 3)
            season = cycles[period : period + n] - [plain_loess(drift, low, x) for x in range(n)]
            smoothed = [plain_loess(y - season, wide, x, weights) for x in range(n)]
            trend = np.array([(y - season)[i] if v is None else v for i, v in enumerate(smoothed)])
        if turn < outer:
            rest = np.abs(y - season - trend)
            share = rest / (6 * np.median(rest))
            weights = np.where(share <= 0.001, 1, np.where(share <= 0.999, (1 - share**2) ** 2, 0))
    return season, trend


@pytest.mark.parametrize("n,period", [(40, 4), (85, 12)])
def test_season_and_trend_equal_the_plain_version(n, period):
    rng = np.random.default_rng(4)
    y = 0.1 * np.arange(n) + 5 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(0, 0.3, n)
    y[n // 2] += 30
    season, trend = smoothing.season_and_trend(y, period)
    want = plain_stl(y, period)
    assert np.allclose(season, want[0], atol=1e-8) and np.allclose(trend, want[1], atol=1e-8)


def test_an_outlier_stays_in_the_rest():
    n, period = 96, 12
    clean = 0.05 * np.arange(n) + 4 * np.cos(2 * np.pi * np.arange(n) / period)
    y = clean.copy()
    y[50] += 40
    season, trend = smoothing.season_and_trend(y, period)
    assert np.abs(season + trend - clean).max() < 1.5 and (y - season - trend)[50] > 35


def test_by_key(spark):
    rows = [(k, i, float(v)) for k, n in (("a", 60), ("b", 20)) for i, v in enumerate(noisy(n))] + [("a", 60, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = smoothing.deseasonalised(df, ["k"], "t", "v", 6)
    a = got.where("k = 'a' AND v IS NOT NULL").orderBy("t").toPandas()
    assert np.allclose(a["rest"], noisy(60) - sum(smoothing.season_and_trend(noisy(60), 6)))
    assert got.where("k = 'b' AND rest = v AND isnan(trend)").count() + got.where("k = 'b' AND rest = v AND trend IS NULL").count() == 20
    smooth = smoothing.splines(df.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t"))), ["k"], "d", "v", factor=1.0)
    own = smooth.where("k = 'a' AND v IS NOT NULL").orderBy("t").toPandas()["spline"]
    assert np.allclose(own, smoothing.smooth_spline(np.arange(60.0), noisy(60), 1.0))
