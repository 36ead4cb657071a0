"""Regression and tests from distributed aggregates: a pass over the rows makes sums of products, and only matrices as
large as the number of terms reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import ratio
from tidewrack.functions.special import chi2_p_value, f_p_value, t_p_value, t_quantile, t_two_sided
from tidewrack.operators.windows import counted_upto, quantiles, running_total


def simple_regression(df: DataFrame, keys: Sequence[str], x: str, y: str, p_values: bool = True) -> DataFrame:
    """slope, intercept, r2, n (and p of the slope) of y on x per key, rows with both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))
    if not p_values:
        return fit
    t = F.sqrt(ratio(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    return fit.withColumn("p", t_p_value(t, (F.col("n") - 2).cast("double")))


def power_law(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """ln y on ln x over positive values: slope, intercept, r2, n, standard error of the slope and what a confidence
    band needs (mean and sum of squares of ln x, residual variance)."""
    logs = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    fit = logs.groupBy(*keys).agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2"), F.count("*").alias("n"), F.avg("lx").alias("mean_lx"), F.regr_sxx("ly", "lx").alias("sxx"), F.regr_syy("ly", "lx").alias("syy"))
    fit = fit.withColumn("variance", ratio((1 - F.col("r2")) * F.col("syy"), (F.col("n") - 2).cast("double")))
    return fit.withColumn("se_slope", F.sqrt(ratio(F.col("variance"), F.col("sxx")))).drop("syy")


def power_band(df: DataFrame, keys: Sequence[str], x: str, y: str, points: int = 101, alpha: float = 0.05) -> DataFrame:
    """(keys..., x, fit, se, low, high): ``power_law`` at equal steps from the least to the largest x, the error of its mean
    (of the logarithm) and the limits of the mean."""
    fit = power_law(df, keys, x, y)
    ends = df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys).agg(F.min(x).alias("lo__"), F.max(x).alias("hi__"))
    told = fit.join(ends, list(keys)) if keys else fit.crossJoin(F.broadcast(ends))  # one row
    told = told.withColumn("at__", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    told = told.withColumn("x", F.col("lo__") + (F.col("hi__") - F.col("lo__")) * F.col("at__") / (points - 1))
    mean = F.col("intercept") + F.col("slope") * F.ln("x")
    se = F.sqrt(F.col("variance") * (1 / F.col("n") + F.pow(F.ln("x") - F.col("mean_lx"), F.lit(2.0)) / F.col("sxx")))

    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        told = {int(v): t_quantile(1 - alpha / 2, int(v)) for v in df.unique() if v > 0}
        return df.map(lambda v: told.get(int(v), math.nan))

    t = quantile(F.col("n") - 2)
    return told.select(*keys, "x", F.exp(mean).alias("fit"), se.alias("se"), F.exp(mean - t * se).alias("low"), F.exp(mean + t * se).alias("high"))


def correlations(df: DataFrame, keys: Sequence[str], xs: Sequence[str], ys: Sequence[str], p_values: bool = False) -> DataFrame:
    """(keys..., x, y, r, n) of each pair of columns, over rows that have both; one pass over the table."""
    pairs = [(x, y) for x in xs for y in ys if x != y]
    both = {(x, y): F.col(x).isNotNull() & F.col(y).isNotNull() for x, y in pairs}
    made = df.groupBy(*keys).agg(*(F.struct(F.corr(x, y).alias("r"), F.count_if(both[x, y]).alias("n")).alias(f"{x}|{y}") for x, y in pairs))
    told = made.unpivot(list(keys), [f"{x}|{y}" for x, y in pairs], "pair", "v") if keys else made.withColumn("__", F.lit(0)).unpivot(["__"], [f"{x}|{y}" for x, y in pairs], "pair", "v").drop("__")
    told = told.select(*keys, F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), "v.r", "v.n")
    if not p_values:
        return told
    t = F.col("r") * F.sqrt(ratio((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r")))
    return told.withColumn("p", t_p_value(t, (F.col("n") - 2).cast("double")))


def errors(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """(predictor, mae, rmse, n) against the target."""
    long = df.unpivot([target], [F.col(p).cast("double").alias(p) for p in predictors], "predictor", "value").withColumn("e", F.col("value") - F.col(target))
    return long.groupBy("predictor").agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count("e").alias("n"))


@dataclass
class Fit:
    """Least squares of named terms; ``covariance`` is classic or robust."""

    terms: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    n: int
    rss: float
    tss: float

    @property
    def df_residual(self) -> int:
        return self.n - len(self.terms)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss else math.nan

    def aic(self) -> float:
        return self.n * (math.log(2 * math.pi * self.rss / self.n) + 1) + 2 * len(self.terms)

    def bic(self) -> float:
        return self.aic() + (math.log(self.n) - 2) * len(self.terms)

    def table(self) -> list[tuple[str, float, float, float, float]]:
        """(term, coefficient, standard error, t, p) of each term."""
        se = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        t = np.divide(self.coefficients, se, out=np.full_like(se, np.nan), where=se > 0)
        return [(k, float(b), float(s), float(v), t_two_sided(float(v), self.df_residual)) for k, b, s, v in zip(self.terms, self.coefficients, se, t)]


def _gram(df: DataFrame, terms: dict[str, Column], y: str) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    names = list(terms)
    told = df.select(F.col(y).cast("double").alias("y__"), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values()))).na.drop()
    k = len(names)
    row = told.agg(
        F.count("*"), F.sum("y__"), F.sum(F.col("y__") * F.col("y__")), *(F.sum(F.col(f"x{i}") * F.col("y__")) for i in range(k)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)),
    ).first()
    n, sy, syy = row[0], row[1] or 0.0, row[2] or 0.0
    xy, xx, at = np.array([v or 0.0 for v in row[3 : 3 + k]], float), np.zeros((k, k)), 3 + k
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[at] or 0.0
            at += 1
    return xx, xy, n, syy, sy


def least_squares(df: DataFrame, terms: dict[str, Column], y: str, robust: str | None = None) -> Fit:
    """Ordinary least squares; ``robust`` is None, HC0, HC1, HC2 or HC3 (a second pass for the middle of the sandwich).

    ``terms`` are named column expressions, with ``F.lit(1)`` for the intercept. Rows with a null are left out.
    """
    xx, xy, n, syy, sy = _gram(df, terms, y)
    inverse = np.linalg.pinv(xx)
    b = inverse @ xy
    rss = max(0.0, float(syy - b @ xy))
    names = list(terms)
    cov = inverse * rss / max(1, n - len(names))
    if robust:
        xs = [c.cast("double") for c in terms.values()]
        told = df.select(F.col(y).cast("double").alias("y__"), *(c.alias(f"x{i}") for i, c in enumerate(xs))).na.drop()
        fitted = sum((float(v) * F.col(f"x{i}") for i, v in enumerate(b)), F.lit(0.0))
        lever = sum((float(inverse[i, j]) * F.col(f"x{i}") * F.col(f"x{j}") for i in range(len(xs)) for j in range(len(xs))), F.lit(0.0))
        e2 = F.pow(F.col("y__") - fitted, F.lit(2.0))
        weight = {"HC0": e2, "HC1": e2 * (n / max(1, n - len(xs))), "HC2": e2 / (1 - lever), "HC3": e2 / F.pow(1 - lever, F.lit(2.0))}[robust]
        row = told.agg(*(F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(len(xs)) for j in range(len(xs)))).first()
        cov = inverse @ np.array(row, float).reshape(len(xs), len(xs)) @ inverse
    return Fit(names, b, cov, n, rss, float(syy - sy * sy / n) if n else 0.0)


def anova(df: DataFrame, groups: dict[str, dict[str, Column]], y: str) -> list[tuple[str, int, float, float, float, float]]:
    """Type II-like table: for each group of terms (term, df, sum of squares, F, p, partial eta squared), its sum of
    squares being what the residuals grow by when only it is left out. One pass: reduced fits are parts of one Gram matrix."""
    from tidewrack.functions.special import f_upper

    terms = {"(intercept)": F.lit(1)} | {f"{g}:{k}": c for g, own in groups.items() for k, c in own.items()}
    xx, xy, n, syy, _ = _gram(df, terms, y)
    names = list(terms)

    def rss(keep: list[int]) -> tuple[float, int]:
        a = xx[np.ix_(keep, keep)]
        return max(0.0, float(syy - xy[keep] @ np.linalg.pinv(a) @ xy[keep])), int(np.linalg.matrix_rank(a))

    full, rank = rss(list(range(len(names))))
    out = []
    for g in groups:
        less, lower = rss([i for i, t in enumerate(names) if not t.startswith(f"{g}:")])
        ss, d = max(0.0, less - full), rank - lower
        f = (ss / d) / (full / (n - rank)) if d and full else math.nan
        out.append((g, d, ss, f, f_upper(f, d, n - rank), ss / (ss + full) if ss + full else math.nan))
    return out


def vif(df: DataFrame, columns: Sequence[str], with_constant: bool = True) -> dict[str, float]:
    """Variance inflation factors: the diagonal of the inverse correlation matrix, or of the uncentred one."""
    terms = {c: F.col(c) for c in columns} | ({"(intercept)": F.lit(1)} if with_constant else {})
    xx, _, n, _, _ = _gram(df, terms, columns[0])
    k = len(columns)
    m = xx[:k, :k] - np.outer(xx[:k, k], xx[:k, k]) / n if with_constant else xx
    d = np.sqrt(np.maximum(np.diag(m), 1e-300))
    return dict(zip(columns, map(float, _inflation(m / np.outer(d, d)))))


def _inflation(correlation: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse; infinite where the matrix has none."""
    if np.linalg.cond(correlation) > 1e12:
        values, vectors = np.linalg.eigh(correlation)
        free = values < values.max() * 1e-12
        tied = (np.abs(vectors[:, free]) > 1e-6).any(axis=1)
        return np.where(tied, np.inf, np.diag(np.linalg.pinv(correlation)))
    return np.diag(np.linalg.inv(correlation))


def vif_filter(df: DataFrame, columns: Sequence[str], most: float = 10.0) -> list[str]:
    """Columns left when the one with the largest factor goes until none is above ``most``; one pass over the rows."""
    xx, _, n, _, _ = _gram(df, {c: F.col(c) for c in columns} | {"(intercept)": F.lit(1)}, columns[0])
    k = len(columns)
    m = xx[:k, :k] - np.outer(xx[:k, k], xx[:k, k]) / n
    left = list(range(k))
    while len(left) > 1:
        a = m[np.ix_(left, left)]
        d = np.sqrt(np.maximum(np.diag(a), 1e-300))
        factors = _inflation(a / np.outer(d, d))
        if factors.max() <= most:
            break
        del left[int(factors.argmax())]
    return [columns[i] for i in left]


def selected(df: DataFrame, columns: Sequence[str], y: str, by: str = "aic", p_out: float = 0.05) -> list[str]:
    """Backward elimination on one Gram matrix: by p-value, or while leaving a column out lowers AIC or BIC."""
    xx, xy, n, syy, sy = _gram(df, {"(intercept)": F.lit(1)} | {c: F.col(c) for c in columns}, y)
    left = list(range(1, len(columns) + 1))

    def fit(keep: list[int]) -> Fit:
        at = [0, *keep]
        inverse = np.linalg.pinv(xx[np.ix_(at, at)])
        b = inverse @ xy[at]
        rss = max(1e-300, float(syy - b @ xy[at]))
        return Fit([str(i) for i in at], b, inverse * rss / max(1, n - len(at)), n, rss, float(syy - sy * sy / n))

    while left:
        now = fit(left)
        if by == "p":
            worst = max(now.table()[1:], key=lambda r: -1 if math.isnan(r[4]) else r[4])
            if not worst[4] > p_out:
                break
            left.remove(int(worst[0]))
        else:
            score = lambda f: f.bic() if by == "bic" else f.aic()
            best = min(left, key=lambda i: score(fit([k for k in left if k != i])))
            if score(fit([k for k in left if k != best])) >= score(now):
                break
            left.remove(best)
    return [columns[i - 1] for i in left]


def penalised(df: DataFrame, columns: Sequence[str], y: str, alpha: float, kind: str = "ridge", standardise: bool = True, rounds: int = 10_000) -> dict[str, float]:
    """Coefficients with a penalty: ``ridge`` adds alpha times their squares to the sum of squares, ``lasso`` alpha times their
    sizes to half the mean of squares. Columns are centred, and scaled by their population deviation if asked. One pass
    over the rows; the rest is on the columns' products."""
    xx, xy, n, _, sy = _gram(df, {c: F.col(c) for c in columns} | {"(intercept)": F.lit(1)}, y)
    k = len(columns)
    means = xx[:k, k] / max(n, 1)
    m, v = xx[:k, :k] - n * np.outer(means, means), xy[:k] - means * sy
    sd = np.sqrt(np.maximum(np.diag(m) / max(n, 1), 0)) if standardise else np.ones(k)
    sd = np.where(sd > 0, sd, 1.0)
    m, v = m / np.outer(sd, sd), v / sd
    if kind == "ridge":
        return dict(zip(columns, map(float, np.linalg.solve(m + alpha * np.eye(k), v))))
    if kind != "lasso":
        raise ValueError(f"kind is ridge or lasso, not {kind}")
    b = np.zeros(k)
    for _ in range(rounds):
        before = b.copy()
        for j in range(k):
            if m[j, j] > 0:
                free = v[j] - m[j] @ b + m[j, j] * b[j]
                b[j] = np.sign(free) * max(0.0, abs(free) - n * alpha) / m[j, j]
        if np.abs(b - before).max() <= 1e-12 * max(1.0, np.abs(b).max()):
            break
    return dict(zip(columns, map(float, b)))


def one_way(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (f, df1, df2, p) of a one-way analysis of variance, from each group's moments."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("a"), F.sum(F.col("n") * F.col("m")).alias("b"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    f = ratio((F.col("a") - F.col("b") * F.col("b") / F.col("n")) / d1, ratio(F.col("within"), d2))
    return t.select(f.alias("f"), d1.alias("df1"), d2.alias("df2")).withColumn("p", f_p_value("f", "df1", "df2"))


def levene(df: DataFrame, group: str, value: str, trim: float | None = None) -> DataFrame:
    """Equality of variances: one-way analysis of absolute deviations from the groups' medians, or with ``trim`` from means
    without that share of rows at each end."""
    v = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    centres = group_medians(v, group, value) if trim is None else _trimmed_means(v, group, value, trim)
    return one_way(v.join(centres, group).select(group, F.abs(F.col(value) - F.col("m__")).alias("deviation")), group, "deviation")


def group_medians(v: DataFrame, group: str, value: str) -> DataFrame:
    """(group, m__): exact medians from counts of distinct values."""
    return quantiles(v, [group], value, [0.5]).select(group, F.col("q")[0].alias("m__"))


def _trimmed_means(v: DataFrame, group: str, value: str, trim: float) -> DataFrame:
    told = counted_upto(v, [group], value)
    k = F.floor(F.col("n") * trim)
    kept = F.greatest(F.lit(0), F.least("upto", F.col("n") - k) - F.greatest(F.col("upto") - F.col("t"), k))
    return told.groupBy(group).agg((F.sum(kept * F.col(value)) / F.sum(kept)).alias("m__"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (h, df, p), with mean ranks for ties and their correction.

    Ranks come from counts of distinct values and their running sum.
    """
    v = df.where(F.col(value).isNotNull())
    counted = v.groupBy(value).agg(F.count("*").alias("t"))
    ranks = running_total(counted, value, "t").select(value, "t", (F.col("upto") - (F.col("t") - 1) / 2).alias("rank"))
    ties = counted.agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    sums = v.join(ranks, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("m"))
    told = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("k")).crossJoin(F.broadcast(ties))  # one row
    n = F.col("n").cast("double")
    h = ratio(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    return told.select(h.alias("h"), (F.col("k") - 1).cast("double").alias("df")).withColumn("p", chi2_p_value("h", "df"))


def welch_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group1, group2, t, df, p) of Welch's test for each pair of groups, p with the correction of Bonferroni."""
    m = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a = m.select(F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("m").alias("m1"), (F.col("v") / F.col("n")).alias("e1"))
    b = m.select(F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("m").alias("m2"), (F.col("v") / F.col("n")).alias("e2"))
    pairs = a.join(b, F.col("group1") < F.col("group2"))
    e = F.col("e1") + F.col("e2")
    told = pairs.select("group1", "group2", ratio(F.col("m1") - F.col("m2"), F.sqrt(e)).alias("t"), ratio(e * e, F.col("e1") * F.col("e1") / (F.col("n1") - 1) + F.col("e2") * F.col("e2") / (F.col("n2") - 1)).alias("df"))
    many = told.count()
    return told.withColumn("p", F.least(t_p_value("t", "df") * F.lit(float(many)), F.lit(1.0)))


def ordered_pairs_rising(values: np.ndarray) -> tuple[int, int]:
    """(pairs of which the later value is larger, pairs of which it is smaller), in time n log² n.

    Values are ranked; from the highest bit of the ranks down, pairs are told apart at the bit at which they differ first.
    """
    distinct, rank = np.unique(values, return_inverse=True)
    n, rising = len(values), 0
    same = np.bincount(rank)
    for bit in range(max(1, len(distinct) - 1).bit_length() - 1, -1, -1):
        order = np.argsort(rank >> (bit + 1), kind="stable")  # rows of one prefix together, in order of time
        group, high = (rank >> (bit + 1))[order], (rank >> bit & 1)[order]
        zeros = np.cumsum(1 - high)
        first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        before = np.repeat(zeros[first] - (1 - high[first]), np.diff(np.append(first, n)))
        rising += int(((zeros - before) * high).sum())
    return rising, n * (n - 1) // 2 - int((same * (same - 1) // 2).sum()) - rising


#: Values of a series up to which its slopes are listed; the median slope of a longer one is closed in on.
LISTED = 2000


def median_slope(t: np.ndarray, y: np.ndarray) -> float:
    """The median slope of all pairs of points, for rising ``t``. How many slopes are below one is how many pairs fall once
    that slope is taken out, so that halving an interval finds the middle ones without listing them."""
    n = len(y)
    if n < 2:
        return math.nan
    if n <= LISTED:
        i, j = np.triu_indices(n, 1)
        return float(np.median((y[j] - y[i]) / (t[j] - t[i])))
    pairs = n * (n - 1) // 2
    steps = np.diff(y) / np.diff(t)  # no slope of a pair is beyond those of neighbours

    def kth(k: int) -> float:
        lo, hi = float(steps.min()), float(steps.max())
        for _ in range(200):
            middle = (lo + hi) / 2
            if middle in (lo, hi):
                break
            rising, _ = ordered_pairs_rising(y - middle * t)
            lo, hi = (lo, middle) if pairs - rising > k else (middle, hi)  # slopes at or below the middle
        return hi

    return (kth((pairs - 1) // 2) + kth(pairs // 2)) / 2


def kendall(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Per series: Kendall's S and tau, variance, z and p of the trend test (Mann-Kendall) and the Theil-Sen slope.

    A series is walked through in one task; its pairs are counted, not made.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(order).cast("double").alias("t__"), F.col(value).cast("double").alias("y__"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def walk(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("t__", kind="stable")
        t, y = own["t__"].to_numpy(float), own["y__"].to_numpy(float)
        rising, falling = ordered_pairs_rising(y)
        return pd.DataFrame([(*key, float(rising - falling), len(y) * (len(y) - 1) // 2, median_slope(t, y))], columns=[*keys, "s", "n_pairs", "slope"])

    sums = v.groupBy(*keys).applyInPandas(walk, f"{kinds}, s double, n_pairs long, slope double").where("n_pairs > 0")
    v = v.withColumnRenamed("y__", value)
    t = F.col("t").cast("double")
    ties = v.groupBy(*keys, value).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(t * (t - 1) * (2 * t + 5)).alias("ties"), F.sum(t * (t - 1) / 2).alias("tied"))
    n = F.col("n").cast("double")
    told = sums.join(ties, list(keys)).withColumn("variance", (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18)
    z = ratio(F.col("s") - F.signum("s"), F.sqrt("variance"))
    told = told.withColumn("tau", ratio(F.col("s"), F.sqrt((F.col("n_pairs") - F.col("tied")) * F.col("n_pairs")))).withColumn("z", z)
    return told.select(*keys, "n", "s", "tau", "variance", "z", "slope")


def residual_tests(df: DataFrame, keys: Sequence[str], residual: str, order: str) -> DataFrame:
    """Durbin-Watson and Jarque-Bera of each series' residuals."""
    told = df.select(*keys, F.col(residual).alias("e"), F.lag(residual).over(Window.partitionBy(*keys).orderBy(order)).alias("b"))
    return told.groupBy(*keys).agg(
        ratio(F.sum(F.pow(F.col("e") - F.col("b"), F.lit(2.0))), F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"),
        (F.count("e") / 6 * (F.pow(F.skewness("e"), F.lit(2.0)) + F.pow(F.kurtosis("e"), F.lit(2.0)) / 4)).alias("jarque_bera"),
    )


def regression_text(df: DataFrame, group: str, x: str, y: str, digits: int = 2) -> DataFrame:
    """(group, equation): the line fitted over all rows as text, the same for every group."""
    fit = df.agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"))
    told = df.select(group).distinct().crossJoin(F.broadcast(fit))  # one row
    return told.select(group, F.format_string(f"y = %.{digits}fx + %.{digits}f", "a", "b").alias("equation"))
