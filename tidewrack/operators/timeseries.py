"""Series: calendars, gaps, resampling, smoothing, correlation over lags. A series is the rows of a key; series are dealt
out by key, and what must walk through one in order does so in a grouped map with numpy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewrack.functions.measures import ratio


def calendar(df: DataFrame, keys: Sequence[str], date: str, step: str) -> DataFrame:
    """Each key's dates from its first to its last in a step such as ``1 day``, ``8 days`` or ``1 month``."""
    ends = df.groupBy(*keys).agg(F.min(date).cast("date").alias("a"), F.max(date).cast("date").alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(date))


def regular(df: DataFrame, keys: Sequence[str], date: str, value: str, step: str) -> DataFrame:
    """The series on a full calendar, null where there was no row."""
    return calendar(df, keys, date, step).join(df.select(*keys, F.col(date).cast("date").alias(date), value), [*keys, date], "left")


def yearly_dates(years: DataFrame, year: str, n: int) -> DataFrame:
    """n dates equally spaced from the first to the last day of each year, numbered from 0."""
    start, end = F.make_date(F.col(year), F.lit(1), F.lit(1)), F.make_date(F.col(year), F.lit(12), F.lit(31))
    told = years.select(year, start.alias("a"), F.datediff(end, start).alias("days"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("nth"))
    return told.select(year, "nth", F.date_add("a", F.floor(F.col("nth") * F.col("days") / (n - 1)).cast("int")).alias("date"))


def binned(df: DataFrame, keys: Sequence[str], bin_, value: str, name: str = "bin") -> DataFrame:
    """Mean and number of values per key and bin, a bin being a column expression."""
    return df.groupBy(*keys, bin_.alias(name)).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def gaps(df: DataFrame, keys: Sequence[str], date: str, value: str, step: int) -> DataFrame:
    """Missing dates between rows that lie more than ``step`` days apart, with the mean of the rows around."""
    w = Window.partitionBy(*keys).orderBy(date)
    told = df.select(*keys, date, F.col(value).alias("v0"), F.lead(date).over(w).alias("next"), F.lead(value).over(w).alias("v1"))
    told = told.where(F.datediff("next", date) > step)
    days = F.sequence(F.date_add(date, step), F.date_sub("next", 1), F.expr(f"interval {step} days"))
    return told.select(*keys, F.explode(days).alias(date), ((F.col("v0") + F.col("v1")) / 2).alias(value))


def _grouped(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, walk) -> DataFrame:
    """``df`` with a column that ``walk`` makes of each key's values in order."""
    schema = StructType([*(f for f in df.schema if f.name != out), StructField(out, DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf[out] = walk(pdf[value].to_numpy(dtype=float))
        return pdf[schema.names]

    return df.groupBy(*keys).applyInPandas(run, schema)


class NextBelow:
    """Finds the first value at or below a limit from some place on, in a tree of minima."""

    def __init__(self, values: np.ndarray):
        """Missing values are never found."""
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.low = np.full(2 * self.size, np.inf)
        self.low[self.size : self.size + len(values)] = np.where(np.isnan(values), np.inf, values)
        for level in range(self.size.bit_length() - 2, -1, -1):
            own = slice(1 << level, 2 << level)
            below = self.low[2 << level : 4 << level]
            self.low[own] = np.minimum(below[::2], below[1::2])

    def find(self, start: int, limit: float) -> int | None:
        if start >= self.size or math.isnan(limit):
            return None
        found = lambda k: self.low[k] <= limit and self.low[k] < np.inf
        k = start + self.size
        while not found(k):  # up, as long as nothing to the right of a node is left
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if found(2 * k) else 2 * k + 1
        return k - self.size


def corrections(values: np.ndarray, threshold: float | None = 1.5, last: float | None = None) -> tuple[np.ndarray, int]:
    """Each value that is missing, or above ``threshold`` times the corrected one before it, replaced by the mean of that one
    and the next acceptable value, or by that one if none follows; and how many are certain whatever follows the values.
    Without ``last``, the corrected one before them, the first value stays."""
    out, certain, tree = values.copy(), len(values), None
    for i in range(len(out)):
        before = last if i == 0 else out[i - 1]
        if before is None:
            continue
        limit = np.inf if threshold is None else threshold * before
        if np.isnan(out[i]) or out[i] > limit:
            tree = tree or NextBelow(values)
            at = tree.find(i + 1, limit)
            if at is None:
                certain = min(certain, i)
            out[i] = before if at is None else (before + values[at]) / 2
    return out, certain


def correct_sequence(values: np.ndarray, threshold: float | None = 1.5) -> np.ndarray:
    """``corrections`` of a whole series."""
    return corrections(values, threshold)[0]


def corrected(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, threshold: float | None = 1.5) -> DataFrame:
    return _grouped(df, keys, order, value, out, lambda v: correct_sequence(v, threshold))


def whittaker(values: np.ndarray, lam: float = 5.0, p: float = 0.1, rounds: int = 1) -> np.ndarray:
    """Asymmetric Whittaker smoother: squared residuals weighted p above the curve and 1 - p below, plus lam times squared
    second differences. The system has five diagonals and is solved as such, in time linear in the series' length."""
    n = len(values)
    if n < 3:
        return values.astype(float).copy()
    d0, d1, d2 = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, a in enumerate((1.0, -2.0, 1.0)):
        d0[k : n - 2 + k] += a * a
    d1[0 : n - 2] += -2
    d1[1 : n - 1] += -2
    d2[0 : n - 2] += 1
    w, z = np.ones(n), values.astype(float).copy()
    for _ in range(rounds):
        a, b, c = w + lam * d0, lam * d1, lam * d2
        # LDL' of a symmetric band of width two, forward then back
        d, e, f, y = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n):
            d[i] = a[i] - (e[i - 1] ** 2 * d[i - 1] if i > 0 else 0) - (f[i - 2] ** 2 * d[i - 2] if i > 1 else 0)
            if i + 1 < n:
                e[i] = (b[i] - (f[i - 1] * d[i - 1] * e[i - 1] if i > 0 else 0)) / d[i]
            if i + 2 < n:
                f[i] = c[i] / d[i]
            y[i] = w[i] * values[i] - (e[i - 1] * y[i - 1] if i > 0 else 0) - (f[i - 2] * y[i - 2] if i > 1 else 0)
        z = y / d
        for i in range(n - 2, -1, -1):
            z[i] -= e[i] * z[i + 1] + (f[i] * z[i + 2] if i + 2 < n else 0)
        w = np.where(values >= z, p, 1 - p)
    return z


def smoothed(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, lam: float = 5.0, p: float = 0.1, rounds: int = 1) -> DataFrame:
    return _grouped(df, keys, order, value, out, lambda v: whittaker(v, lam, p, rounds))


def cross_correlation(a: DataFrame, b: DataFrame, index: str, value: str, most: int) -> DataFrame:
    """(lag, cc) for lags up to ``most``: products of two centred series, one moved by the lag, over n and both deviations.

    Both series have the same index 0..n-1; each row meets 2 * most + 1 others.
    """
    def centred(df: DataFrame, name: str) -> DataFrame:
        m = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n"))
        return df.crossJoin(F.broadcast(m)).select(F.col(index).alias(f"{name}i"), (F.col(value) - F.col("m")).alias(name), F.col("s").alias(f"{name}s"), F.col("n").alias(f"{name}n"))  # one row

    x = centred(a, "x").withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("yi", F.col("xi") - F.col("lag"))
    told = x.join(centred(b, "y"), "yi").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("sum"), F.first("xs").alias("xs"), F.first("ys").alias("ys"), F.first("xn").alias("n"))
    return told.select("lag", ratio(F.col("sum"), F.col("xs") * F.col("ys") * F.col("n")).alias("cc"))


def leads(lag, first: str, second: str):
    """Which of two series leads by a lag, as text."""
    by = F.concat(F.lit(" leads "), F.lit(second), F.lit(" by "), F.abs(lag).cast("string"))
    back = F.concat(F.lit(second), F.lit(" leads "), F.lit(first), F.lit(" by "), F.abs(lag).cast("string"))
    return F.when(lag > 0, F.concat(F.lit(first), by)).when(lag < 0, back).otherwise("no lead")


def autocorrelations(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """(keys..., lag, r, q): autocorrelation at each lag and the Ljung-Box sum up to it."""
    own = Window.partitionBy(*keys)
    told = df.select(*keys, F.col(order).alias("o"), (F.col(value) - F.avg(value).over(own)).alias("v"))
    w = own.orderBy("o")
    moved = told.select(*keys, "v", *(F.lag("v", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    sums = moved.groupBy(*keys).agg(F.sum(F.col("v") * F.col("v")).alias("s0"), F.count("v").alias("n"), *(F.sum(F.col("v") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)))
    long = sums.select(*keys, "n", F.posexplode(F.array(*(ratio(F.col(f"s{k}"), F.col("s0")) for k in range(1, lags + 1)))).alias("at", "r"))
    upto = own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("n").cast("double")
    return long.select(*keys, (F.col("at") + 1).alias("lag"), "r", (n * (n + 2) * F.sum(F.col("r") * F.col("r") / (n - F.col("at") - 1)).over(upto)).alias("q"))


def recurrences(df: DataFrame, keys: Sequence[str], order: str, value: str, size: int = 5, quantile: float = 0.1) -> DataFrame:
    """(keys..., i, j, d, recurrent) for i < j: Euclidean distances of runs of ``size`` values, and whether they are among
    the closest share of the key's."""
    w = Window.partitionBy(*keys).orderBy(order)
    told = df.select(*keys, (F.row_number().over(w) - 1).alias("i"), F.array(*(F.lead(value, k).over(w) if k else F.col(value) for k in range(size))).alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    a, b = told, told.withColumnsRenamed({"i": "j", "v": "u"})
    square = F.aggregate(F.zip_with("v", "u", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, list(keys)).where("i < j").select(*keys, "i", "j", F.sqrt(square).alias("d"))
    radius = pairs.groupBy(*keys).agg(F.percentile("d", F.lit(quantile)).alias("radius"))
    return pairs.join(radius, list(keys)).select(*keys, "i", "j", "d", (F.col("d") <= F.col("radius")).alias("recurrent"))


def split_by_time(df: DataFrame, keys: Sequence[str], order: str, share: float = 0.8) -> DataFrame:
    """``df`` with ``train``: whether a row is among the first share of its series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("train", F.row_number().over(w) <= F.floor(F.count("*").over(Window.partitionBy(*keys)) * share))


def seasonal_forecast(df: DataFrame, keys: Sequence[str], order: str, value: str, period: int, horizon: int, mode: str = "season") -> DataFrame:
    """(keys..., step, forecast) for the next steps: last value, mean, or mean of the same place in the period."""
    w = Window.partitionBy(*keys).orderBy(order)
    told = df.where(F.col(value).isNotNull()).withColumn("at", F.row_number().over(w) - 1)
    ends = told.groupBy(*keys).agg(F.max("at").alias("last_at"), F.max_by(value, "at").alias("last"), F.avg(value).alias("mean"))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("place", F.pmod(F.col("last_at") + F.col("step"), F.lit(period)))
    if mode != "season":
        return steps.select(*keys, "step", F.col(mode).alias("forecast"))
    places = told.groupBy(*keys, F.pmod("at", F.lit(period)).alias("place")).agg(F.avg(value).alias("forecast"))
    return steps.join(places, [*keys, "place"], "left").select(*keys, "step", F.coalesce("forecast", "mean").alias("forecast"))
