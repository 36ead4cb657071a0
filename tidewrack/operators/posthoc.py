"""Tests after a fit: pairs of groups, contrasts of coefficients, residuals, and the choice of a transform."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import box_cox, ratio, shifted_log, yeo_johnson
from tidewrack.functions.special import chi2_upper, f_upper, studentized_range_upper, t_quantile, t_two_sided
from tidewrack.lineage import written
from tidewrack.operators import powers
from tidewrack.operators.statistics import Fit, least_squares
from tidewrack.operators.windows import running_total, running_totals


def mean_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, rank): mean ranks over all rows, ties sharing theirs, and the tie term on each row."""
    v = df.where(F.col(value).isNotNull())
    counted = v.groupBy(value).agg(F.count("*").alias("t"))
    ranks = running_total(counted, value, "t").select(value, (F.col("upto") - (F.col("t") - 1) / 2).alias("rank"))
    t = F.col("t").cast("double")
    ties = counted.agg(F.sum(t * t * t - t).alias("ties"), F.sum("t").alias("all"))
    return v.join(ranks, value).groupBy(group).agg(F.count("*").alias("n"), F.avg("rank").alias("rank")).crossJoin(F.broadcast(ties))  # one row


def dunn(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group1, group2, z, p): differences of mean ranks, p by the number of pairs."""
    m = mean_ranks(df, group, value)
    a = m.select(F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("rank").alias("r1"), "ties", F.col("all").cast("double").alias("all"))
    b = m.select(F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("rank").alias("r2"))
    pairs = a.join(b, F.col("group1") < F.col("group2"))
    spread = (F.col("all") * (F.col("all") + 1) / 12 - F.col("ties") / (12 * (F.col("all") - 1))) * (1 / F.col("n1") + 1 / F.col("n2"))
    told = pairs.select("group1", "group2", ratio(F.col("r1") - F.col("r2"), F.sqrt(spread)).alias("z"))
    rows = [(r["group1"], r["group2"], r["z"]) for r in told.collect()]  # pairs of groups
    return df.sparkSession.createDataFrame([(a, b, z, min(1.0, len(rows) * math.erfc(abs(z) / math.sqrt(2)))) for a, b, z in rows], "group1 string, group2 string, z double, p double")


def tukey(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group1, group2, diff, q, p) of Tukey's honest significant differences, from the groups' moments."""
    rows = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss")).orderBy(group).collect()
    k, n = len(rows), sum(r["n"] for r in rows)
    within = sum(r["ss"] for r in rows) / max(1, n - k)
    out = []
    for a, b in combinations(rows, 2):
        diff = b["m"] - a["m"]
        q = abs(diff) / math.sqrt(within / 2 * (1 / a["n"] + 1 / b["n"])) if within else math.inf
        out.append((str(a[group]), str(b[group]), float(diff), float(q), studentized_range_upper(q, k, n - k)))
    return df.sparkSession.createDataFrame(out, "group1 string, group2 string, diff double, q double, p double")


def holm(p: Sequence[float]) -> list[float]:
    """p-values with Holm's correction."""
    order, out, most = sorted(range(len(p)), key=lambda i: p[i]), [0.0] * len(p), 0.0
    for k, i in enumerate(order):
        most = max(most, min(1.0, (len(p) - k) * p[i]))
        out[i] = most
    return out


def marginal_means(fit: Fit, levels: Mapping[str, Mapping[str, float]], alpha: float = 0.05) -> list[tuple[str, float, float, float, float]]:
    """(level, mean, se, low, high) of a fit at rows of terms, one for each level."""
    t = t_quantile(1 - alpha / 2, fit.df_residual)
    out = []
    for level, row in levels.items():
        x = np.array([row.get(term, 0.0) for term in fit.terms])
        mean, se = float(x @ fit.coefficients), float(math.sqrt(max(0.0, x @ fit.covariance @ x)))
        out.append((level, mean, se, mean - t * se, mean + t * se))
    return out


def contrasts(fit: Fit, levels: Mapping[str, Mapping[str, float]]) -> list[tuple[str, str, float, float, float, float, float]]:
    """(level1, level2, diff, se, t, p, p_holm) of all pairs of levels."""
    rows = []
    for a, b in combinations(levels, 2):
        x = np.array([levels[a].get(k, 0.0) - levels[b].get(k, 0.0) for k in fit.terms])
        diff, se = float(x @ fit.coefficients), float(math.sqrt(max(0.0, x @ fit.covariance @ x)))
        t = diff / se if se else math.nan
        rows.append((a, b, diff, se, t, t_two_sided(t, fit.df_residual)))
    return [(*r, p) for r, p in zip(rows, holm([r[5] for r in rows]))]


def wald(fit: Fit, terms: Sequence[str]) -> tuple[float, int, float]:
    """F, its degrees of freedom and p of some coefficients being zero together."""
    at = [fit.terms.index(t) for t in terms]
    b = fit.coefficients[at]
    f = float(b @ np.linalg.pinv(fit.covariance[np.ix_(at, at)]) @ b) / len(at)
    return f, len(at), f_upper(f, len(at), fit.df_residual)


def breusch_pagan(df: DataFrame, terms: Mapping[str, Column], y: str) -> tuple[float, float]:
    """Statistic n R² of squared residuals on the same terms, and p."""
    fit = least_squares(df, dict(terms), y)
    fitted = sum((float(b) * c for b, c in zip(fit.coefficients, terms.values())), F.lit(0.0))
    aux = least_squares(df.withColumn("e2__", F.pow(F.col(y) - fitted, F.lit(2.0))), dict(terms), "e2__")
    lm = aux.n * aux.r2
    return lm, chi2_upper(lm, len(terms) - 1)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation, for 4 to 5000 values."""
    x = np.sort(values[~np.isnan(values)])
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    # fixed values: Royston's polynomials
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u) + m[-1] / math.sqrt(mm)
    a = np.empty(n)
    if n > 5:
        next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u) + m[-2] / math.sqrt(mm)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = next_, -next_
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n <= 11:
        g, mu = -2.273 + 0.459 * n, 0.5440 - 0.39978 * n + 0.025054 * n**2 - 6.714e-4 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        inner = g - math.log(max(1 - w, 1e-300))
        if inner <= 0:
            return w, 0.0
        z = (-math.log(inner) - mu) / sd
    else:
        k = math.log(n)
        mu, sd = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
        z = (math.log(max(1 - w, 1e-300)) - mu) / sd
    return w, 0.5 * math.erfc(z / math.sqrt(2))


#: Parts that a key's rows are dealt to before the chosen ones meet.
PARTS = 256


def shapiro(df: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str], most: int = 5000) -> DataFrame:
    """(keys..., w, p, n) of each key; of a key with more rows, ``most`` chosen by a hash of their ids, as the test allows."""
    # the first of each of many parts of a key, then the first of those, so that no task sorts a whole key
    order = [F.xxhash64(*ids), *ids]
    told = df.where(F.col(value).isNotNull()).withColumn("part__", F.pmod(F.xxhash64(F.lit("part"), *ids), F.lit(PARTS)))
    for w in (Window.partitionBy(*keys, "part__").orderBy(*order), Window.partitionBy(*keys).orderBy(*order)):
        told = told.withColumn("nth__", F.row_number().over(w)).where(F.col("nth__") <= most)
    chosen = told.select(*keys, value)
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "w double, p double, n long"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *shapiro_wilk(pdf[value].to_numpy(float)), len(pdf))], columns=[*keys, "w", "p", "n"])

    return chosen.groupBy(*keys).applyInPandas(run, schema)


def box_cox_lambda(df: DataFrame, value: str, lo: float = -2.0, hi: float = 2.0, rounds: int = 3, points: int = 21) -> float:
    """The lambda of the largest likelihood, by grids that narrow; each grid is one pass over the value alone."""
    own = written(df.select(F.col(value).cast("double").alias("x")).where("x > 0"))
    n, mean, logs = own.agg(F.count("*"), F.avg("x"), F.sum(F.ln("x"))).first()
    for _ in range(rounds):
        grid = np.linspace(lo, hi, points)
        spread = powers.variances(own, powers.box_cox, {"x": grid}, {"x": mean})["x"] if n else [None] * points
        score = [-n / 2 * math.log(v) + (g - 1) * logs if v and v > 0 else -math.inf for g, v in zip(grid, spread)]
        k = int(np.argmax(score))
        lo, hi = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    return float((lo + hi) / 2)


def transforms(value: str, least: float) -> dict[str, Column]:
    """Candidate transforms of a value, shifted where it isn't positive."""
    x = F.col(value)
    up = x - least + 1 if least <= 0 else x
    return {"none": x, "log": F.ln(up), "log10": F.log10(up), "log1p": F.log1p(up), "sqrt": F.sqrt(up), "cbrt": F.cbrt(x), "square": x * x, "reciprocal": ratio(F.lit(1.0), up), "yeo_johnson_0": yeo_johnson(x, 0.0), "yeo_johnson_half": yeo_johnson(x, 0.5)}


def least_skewed(df: DataFrame, value: str) -> list[tuple[str, float]]:
    """(transform, |skewness|), best first; one pass after the minimum."""
    least = df.agg(F.min(value)).first()[0]
    made = transforms(value, float(least))
    row = df.agg(*(F.abs(F.skewness(c)).alias(k) for k, c in made.items())).first()
    return sorted(((k, float(row[k])) for k in made if row[k] is not None), key=lambda r: (r[1], r[0]))


def candidates(df: DataFrame, value: str) -> dict[str, Column]:
    """Transforms to choose from: as it is, logarithms shifted or of one more, roots, Box and Cox's power, and z."""
    x = F.col(value).cast("double")
    low, mean, sd = df.agg(F.min(x), F.avg(x), F.stddev_samp(x)).first()
    more = F.when(x > -1, F.log1p(x))
    told = {"raw": x, "log_shift": shifted_log(x, F.lit(low)), "log1p": more, "log10_shift": shifted_log(x, F.lit(low)) / math.log(10), "log10p": more / math.log(10), "sqrt": F.when(x >= 0, F.sqrt(x)), "sqrt_shift": F.sqrt(x if low is not None and low >= 0 else x - (low or 0.0)), "cube_root": F.cbrt(x)}
    if low is not None and low > 0:
        told["box_cox"] = box_cox(x, box_cox_lambda(df, value))
    if sd:
        told["z"] = (x - mean) / sd
    return told


def most_normal(df: DataFrame, value: str, ids: Sequence[str]) -> DataFrame:
    """(transform, p, skewness, nth): candidates by the p of Shapiro and Wilk's test, the largest first, then by the size of
    their skewness. The test is of at most 5000 rows, the same for all, chosen by a hash of ``ids``."""
    made = candidates(df, value)
    long = df.select(*ids, *(c.alias(k) for k, c in made.items())).unpivot(list(ids), list(made), "transform", "v")
    skew = long.groupBy("transform").agg(F.abs(F.skewness("v")).alias("skewness"), F.count("v").alias("n"))
    told = shapiro(long, ["transform"], "v", ids).select("transform", "p").join(skew, "transform")
    told = told.select("transform", F.when((F.col("n") < 5) | F.isnan("p"), 0.0).otherwise(F.col("p")).alias("p"), F.coalesce("skewness", F.lit(math.inf)).alias("skewness"))
    return told.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("p"), "skewness", "transform")))  # a row for each candidate


def decomposed(df: DataFrame, keys: Sequence[str], order: str, value: str, period: int) -> DataFrame:
    """``df`` with trend (centred moving average over a period), season (mean departure at each place in it) and rest."""
    w = Window.partitionBy(*keys).orderBy(order)
    half = period // 2
    around = w.rowsBetween(-half, half)
    if period % 2:
        trend = F.avg(value).over(around)
    else:
        ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        trend = (F.sum(value).over(w.rowsBetween(-half + 1, half - 1)) + ends) / period
    told = df.withColumns({"at__": F.row_number().over(w) - 1, "trend": F.when(F.count(value).over(around) == 2 * half + 1, trend)})
    told = told.withColumn("place__", F.pmod("at__", F.lit(period))).withColumn("off__", F.col(value) - F.col("trend"))
    places = told.groupBy(*keys, "place__").agg(F.avg("off__").alias("season"))
    centre = Window.partitionBy(*keys)
    places = places.withColumn("season", F.col("season") - F.avg("season").over(centre))
    return told.join(places, [*keys, "place__"]).withColumn("rest", F.col("off__") - F.col("season")).drop("at__", "place__", "off__")


def autoregression(values: np.ndarray, lags: Sequence[int], horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant first) of a series on its own lags by least squares, and the values that follow."""
    most = max(lags)
    y = values[most:]
    x = np.column_stack([np.ones(len(y)), *(values[most - k : len(values) - k] for k in lags)])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    out = list(values)
    for _ in range(horizon):
        out.append(float(b[0] + sum(c * out[-k] for c, k in zip(b[1:], lags))))
    return b, np.array(out[len(values) :])


def autoregressive_forecast(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int] = (1, 7), horizon: int = 18, test: float = 0.2) -> DataFrame:
    """(keys..., step, forecast, mae, mape): forecasts of each series with errors on its last part, held back; no rows for a
    series too short for its lags."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "step int, forecast double, mae double, mape double"])
    names = [*keys, "step", "forecast", "mae", "mape"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        v = v[~np.isnan(v)]
        cut = len(v) - int(len(v) * test)
        if cut <= max(lags) + len(lags) + 1 or cut == len(v):
            return pd.DataFrame(columns=names)
        _, back = autoregression(v[:cut], lags, len(v) - cut)
        error = np.abs(back - v[cut:])
        mape = float(np.mean(error / np.where(v[cut:] == 0, np.nan, np.abs(v[cut:])))) if (v[cut:] != 0).all() else math.nan
        _, ahead = autoregression(v, lags, horizon)
        return pd.DataFrame([(*key, i + 1, float(f), float(error.mean()), mape) for i, f in enumerate(ahead)], columns=names)

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


#: More groups than these are refused: every pair is a sum of the one pass.
MOST_GROUPS = 50
#: Below as many values in both groups, and without ties, p is exact.
EXACT = 50


def exact_rank_sums(n: int, m: int) -> np.ndarray:
    """How likely each value of the rank-sum statistic of two samples is if they are alike."""
    ways = np.zeros(n * m + 1, dtype=object)  # whole numbers of any size
    ways[0] = 1
    for k in range(1, n + 1):  # times (1 - x^(m + k)), over (1 - x^k)
        ways[m + k :] = ways[m + k :] - ways[: max(0, len(ways) - m - k)]
        for start in range(k):
            ways[start::k] = np.cumsum(ways[start::k])
    total = int(ways.sum())
    return np.array([int(v) / total for v in ways])


def rank_sum_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group1, group2, w, z, p, p_bonferroni) of each two groups by Wilcoxon's rank sums.

    Distinct values are counted by group, and running totals of these counts tell for every pair how often one group's value
    is above the other's, ties counting half: no pair is ranked on its own. z has a correction for continuity.
    """
    told = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"))
    names = sorted(r["g"] for r in told.select("g").distinct().limit(MOST_GROUPS + 1).collect())
    if len(names) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    schema = "group1 string, group2 string, w double, z double, p double, p_bonferroni double"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    counts = told.groupBy("v").agg(*(F.count_if(F.col("g") == name).alias(f"n{i}") for i, name in enumerate(names)))
    upto = running_totals(counts, "v", {f"n{i}": f"c{i}" for i in range(len(names))})
    pairs = list(combinations(range(len(names)), 2))
    above = [F.sum(F.col(f"n{a}") * (F.col(f"c{b}") - F.col(f"n{b}") / 2)) for a, b in pairs]
    both = lambda a, b: F.col(f"n{a}") + F.col(f"n{b}")
    ties = [F.sum((F.pow(both(a, b).cast("double"), F.lit(3.0)) - both(a, b))) for a, b in pairs]
    row = upto.agg(*above, *ties, *(F.sum(f"n{i}") for i in range(len(names)))).first()
    size, rows = row[2 * len(pairs) :], []
    for k, (a, b) in enumerate(pairs):
        n, m, w, t = size[a], size[b], float(row[k]), float(row[len(pairs) + k])
        off = w - n * m / 2
        sd = math.sqrt(max(0.0, n * m / 12 * ((n + m + 1) - t / ((n + m) * (n + m - 1)))))
        z = (off - math.copysign(0.5, off) * (off != 0)) / sd if sd else math.nan
        if n < EXACT and m < EXACT and not t:
            chance = exact_rank_sums(n, m)
            p = min(1.0, 2 * float(chance[: int(w) + 1].sum() if off <= 0 else chance[int(w) :].sum()))
        else:
            p = math.erfc(abs(z) / math.sqrt(2)) if not math.isnan(z) else math.nan
        rows.append((names[a], names[b], w, z, p, min(1.0, p * len(pairs)) if not math.isnan(p) else math.nan))
    return df.sparkSession.createDataFrame(rows, schema)
