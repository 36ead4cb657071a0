"""Distribution functions for p-values, which SQL lacks; vectorised, for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by the continued fraction of Lentz."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: the series, or the continued fraction beyond a + 1."""
    if x <= 0 or a <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h


def t_two_sided(t: float, df: float) -> float:
    return math.nan if math.isnan(t) or not df > 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return math.nan if math.isnan(f) or not (d1 > 0 and d2 > 0) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0)))


def chi2_upper(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else 1 - gamma_inc(df / 2, x / 2)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """The t value with so much below it, by bisection."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1 - t_two_sided(mid, df) / 2 if mid > 0 else t_two_sided(mid, df) / 2
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return (lo + hi) / 2


def studentized_range_upper(q: float, k: int, df: float, points: int = 64) -> float:
    """Upper tail of the studentized range of k means, by Gauss-Legendre integration over scale and location."""
    if not q > 0:
        return 1.0
    x, w = np.polynomial.legendre.leggauss(points)
    z = 8 * x
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))

    def below(width: float) -> float:
        return k * float(np.sum(8 * w * phi * np.clip(cdf(z) - cdf(z - width), 0, 1) ** (k - 1)))

    sd = 1 / math.sqrt(2 * df)
    lo, hi = max(1e-6, 1 - 8 * sd), 1 + 8 * sd
    s = (hi + lo) / 2 + (hi - lo) / 2 * x
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    weight = (hi - lo) / 2 * w * np.exp(log_density)
    return float(min(1.0, max(0.0, 1 - np.sum(weight * np.array([below(q * v) for v in s])))))


def _udf(f, n: int):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns)], dtype="float64")

    if n == 2:
        return F.pandas_udf(lambda a, b: run(a, b), DoubleType(), F.PandasUDFType.SCALAR)
    return F.pandas_udf(lambda a, b, c: run(a, b, c), DoubleType(), F.PandasUDFType.SCALAR)


def t_p_value(t, df):
    """Two-sided p of a t statistic as a column."""
    return _udf(t_two_sided, 2)(t, df)


def f_p_value(f, d1, d2):
    return _udf(f_upper, 3)(f, d1, d2)


def chi2_p_value(x, df):
    return _udf(chi2_upper, 2)(x, df)
