"""Seasonal ARIMA with exogenous columns: order search, backtest and forecasts of many series.

A series is one row with an array of values. Orders are searched in rounds: each round lists the untried neighbours of
every series' best order so far, one row for each, and Spark deals these fits out, so that neither a long search nor a
slow series keeps others waiting. The best order is the one of least corrected Akaike criterion.

A fit maximises the conditional likelihood of the differenced series, its values before the first being at their mean.
Autoregressive and moving-average polynomials are kept stationary and invertible by optimising their partial
correlations; regression coefficients are solved for at every step, as residuals are linear in them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import ratio
from tidewrack.lineage import settled

#: A series is searched and fitted from this many values on.
LEAST = 24
#: Largest p, q, P, Q, and their largest sum.
MOST, MOST_SUM = 2, 8
#: Where the search begins: (p, q, P, Q).
BEGINNINGS = ((0, 0, 0, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))
#: The statistic of stationarity above which a series is differenced once more (5 %).
STATIONARY = 0.463

ORDER = "p int, d int, q int, sp int, sd int, sq int, m int, constant boolean"
ORDER_COLUMNS = ["p", "d", "q", "sp", "sd", "sq", "m", "constant"]


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    sp: int = 0
    sd: int = 0
    sq: int = 0
    m: int = 1
    constant: bool = True

    @property
    def sizes(self) -> tuple[int, int, int, int]:
        return self.p, self.q, self.sp, self.sq


def differences(v: np.ndarray, order: Order) -> np.ndarray:
    """Differenced ``order.d`` times, and ``order.sd`` times over a season."""
    for _ in range(order.sd):
        v = v[order.m :] - v[: -order.m]
    return np.diff(v, order.d, axis=0) if order.d else v


def coefficients(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from free numbers, taken as partial correlations (Durbin and Levinson)."""
    a = np.zeros(0)
    for r in np.tanh(partial):
        a = np.append(a - r * a[::-1], r)
    return a


def polynomials(free: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """(1, -phi...) and (1, theta...) with the seasonal factors multiplied in."""
    parts, at = [], 0
    for size in order.sizes:
        parts.append(coefficients(free[at : at + size]))
        at += size

    def product(short: np.ndarray, long: np.ndarray) -> np.ndarray:
        seasonal = np.zeros(len(long) * order.m + 1)
        seasonal[0] = 1
        seasonal[order.m :: order.m] = -long
        return np.convolve(np.append(1, -short), seasonal)

    return product(parts[0], parts[2]), product(parts[1], parts[3])


def innovations(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """What each value of ``w`` (or of each of its columns) adds to what those before it foretell; zero before the first."""
    n = len(w)
    filter_ = [*ar[:n].tolist(), *[0.0] * (n - len(ar))]  # the quotient of both polynomials
    lags = [(k, float(ma[k])) for k in range(1, min(len(ma), n)) if ma[k]]
    for t in range(1, n):
        drawn = filter_[t]
        for k, c in lags:
            if k > t:
                break
            drawn -= c * filter_[t - k]
        filter_[t] = drawn
    if w.ndim == 1:
        return np.convolve(w, filter_)[:n]
    return np.column_stack([np.convolve(w[:, k], filter_)[:n] for k in range(w.shape[1])])


@dataclass
class Fitted:
    order: Order
    free: np.ndarray
    beta: np.ndarray
    sigma2: float
    aicc: float
    n: int


def _solved(free: np.ndarray, order: Order, w: np.ndarray, z: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of squared innovations and regression coefficients at some polynomials."""
    ar, ma = polynomials(free, order)
    both = innovations(np.column_stack([w, z]), ar, ma)
    e, beta = both[:, 0], np.zeros(z.shape[1])
    if z.shape[1]:
        beta = np.linalg.lstsq(both[:, 1:], e, rcond=None)[0]
        e = e - both[:, 1:] @ beta
    return float(e @ e), beta


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.4, rounds: int = 60, tolerance: float = 1e-7) -> np.ndarray:
    """The point of least ``f`` by the downhill simplex; ``rounds`` for each dimension."""
    n = len(start)
    if not n:
        return start
    points = [start, *(start + step * np.eye(n)[k] for k in range(n))]
    values = [f(x) for x in points]
    for _ in range(rounds * n):
        rank = np.argsort(values, kind="stable")
        points, values = [points[k] for k in rank], [values[k] for k in rank]
        if values[-1] - values[0] <= tolerance * (abs(values[0]) + 1e-300):
            break
        centre = np.mean(points[:-1], axis=0)
        moved = [centre + k * (centre - points[-1]) for k in (1.0, 2.0, 0.5, -0.5)]
        v = f(moved[0])
        if v < values[0]:
            w = f(moved[1])
            points[-1], values[-1] = (moved[1], w) if w < v else (moved[0], v)
        elif v < values[-2]:
            points[-1], values[-1] = moved[0], v
        else:
            x = moved[2] if v < values[-1] else moved[3]
            w = f(x)
            if w < min(v, values[-1]):
                points[-1], values[-1] = x, w
            else:
                points = [points[0], *((x + points[0]) / 2 for x in points[1:])]
                values = [values[0], *(f(x) for x in points[1:])]
    return points[int(np.argmin(values))]


def fit(y: np.ndarray, x: np.ndarray, order: Order) -> Fitted | None:
    """A model of ``y`` with the columns of ``x``; None where the series is too short for its order."""
    w, z = differences(y, order), differences(x, order)
    if order.constant:
        z = np.column_stack([z, np.ones(len(w))])
    k = sum(order.sizes) + z.shape[1] + 1
    n = len(w)
    if n <= k + 2 or order.m > 1 and n < 2 * order.m:
        return None
    free = simplex(lambda v: _solved(v, order, w, z)[0], np.full(sum(order.sizes), 0.1))
    ss, beta = _solved(free, order, w, z)
    sigma2 = max(ss / n, 1e-12)
    return Fitted(order, free, beta, sigma2, n * (math.log(2 * math.pi * sigma2) + 1) + 2 * k + 2 * k * (k + 1) / (n - k - 1), n)


def forecast(fitted: Fitted, y: np.ndarray, x: np.ndarray, x_next: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The next values and the standard deviations of their errors."""
    order = fitted.order
    ar, ma = polynomials(fitted.free, order)
    own = fitted.beta[: x.shape[1]]
    mean = float(fitted.beta[-1]) if order.constant else 0.0
    level = y - x @ own
    e = innovations(differences(level, order) - mean, ar, ma)
    whole = ar
    for times, lag in ((order.d, 1), (order.sd, order.m)):
        for _ in range(times):
            whole = np.convolve(whole, np.r_[1, np.zeros(lag - 1), -1])
    shift, past, errors = mean * ar.sum(), list(level), [*e, *np.zeros(steps)]
    begin = len(e)
    for h in range(steps):
        drawn = sum(ma[k] * errors[begin + h - k] for k in range(1, len(ma)) if begin + h - k >= 0)
        past.append(shift + drawn - sum(whole[k] * past[-k] for k in range(1, min(len(whole), len(past) + 1))))
    psi = np.zeros(steps)
    for j in range(steps):
        psi[j] = (ma[j] if j < len(ma) else 0.0) - sum(whole[k] * psi[j - k] for k in range(1, min(j, len(whole) - 1) + 1))
    return np.array(past[len(level) :]) + x_next @ own, np.sqrt(fitted.sigma2 * np.cumsum(psi**2))


def unsettled(v: np.ndarray) -> float:
    """The statistic of level stationarity of Kwiatkowski and others, with a triangular window over 3 sqrt(n) / 13 lags."""
    e = v - v.mean()
    n, lags = len(e), int(3 * math.sqrt(len(e)) / 13)
    s2 = e @ e / n + 2 / n * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * s2)) if s2 > 0 else 0.0


def box_cox_by_likelihood(y: np.ndarray) -> float | None:
    """The power of the largest likelihood, between -1 and 2; None where a value isn't positive."""
    if not (y > 0).all() or np.ptp(y) == 0:
        return None
    logs, best = np.log(y).sum(), None
    lo, hi = -1.0, 2.0
    for _ in range(4):
        grid = np.linspace(lo, hi, 13)
        score = [-len(y) / 2 * math.log(max(float(np.var(_powered(y, g))), 1e-300)) + (g - 1) * logs for g in grid]
        k = int(np.argmax(score))
        best, lo, hi = float(grid[k]), float(grid[max(0, k - 1)]), float(grid[min(12, k + 1)])
    return best


def _powered(y: np.ndarray, power: float | None) -> np.ndarray:
    return y if power is None else np.log(y) if abs(power) < 1e-9 else (y**power - 1) / power


def _unpowered(v: np.ndarray, power: float | None) -> np.ndarray:
    if power is None:
        return v
    return np.exp(v) if abs(power) < 1e-9 else np.maximum(v * power + 1, 1e-12) ** (1 / power)


def _parts(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    y = np.asarray(row["y"], float)
    x = np.array([np.asarray(c, float) for c in row["x"]]).reshape(len(row["x"]), len(y)).T
    return _powered(y, None if pd.isna(row["power"]) else row["power"]), x


def _order_of(row: pd.Series) -> Order:
    return Order(*(int(row[c]) for c in ORDER_COLUMNS[:-1]), bool(row["constant"]))


def _fits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        told = []
        for _, row in rows.iterrows():
            got = fit(*_parts(row), _order_of(row))
            told.append((math.inf, [], [], math.nan) if got is None or not math.isfinite(got.aicc) else (got.aicc, got.free.tolist(), got.beta.tolist(), got.sigma2))
        yield pd.concat([rows[["job", *ORDER_COLUMNS]].reset_index(drop=True), pd.DataFrame(told, columns=["aicc", "free", "beta", "sigma2"])], axis=1)


_FIT = f"job string, {ORDER}, aicc double, free array<double>, beta array<double>, sigma2 double"


def _prepared(m: int, box_cox: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            powers, ds = [], []
            for y in rows["y"]:
                y = np.asarray(y, float)
                power = box_cox_by_likelihood(y) if box_cox else None
                v = differences(_powered(y, power), Order(0, 0, 0, 0, 1 if m > 1 and len(y) > 2 * m else 0, 0, m))
                d = 0
                while d < 2 and len(v) > 10 and unsettled(v) > STATIONARY:
                    v, d = np.diff(v), d + 1
                powers.append(power)
                ds.append(d)
            yield rows.assign(power=pd.Series(powers, index=rows.index, dtype="float64"), d=ds)

    return run


def _neighbours() -> Column:
    """Orders one step from a row's: each of p, q, P, Q by one, p and q or P and Q together, and the constant in or out."""
    moves = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)]
    told = [F.struct(*((F.col(c) + s * v).alias(c) for c, v in zip(("p", "q", "sp", "sq"), move)), F.col("constant").alias("constant")) for move in moves for s in (1, -1)]
    return F.array(*told, F.struct("p", "q", "sp", "sq", (~F.col("constant")).alias("constant")))


def _allowed(seasonal: Column) -> Column:
    within = [F.col(c).between(0, MOST) for c in ("p", "q")] + [F.when(seasonal, F.col(c).between(0, MOST)).otherwise(F.col(c) == 0) for c in ("sp", "sq")]
    both = within[0]
    for c in within[1:]:
        both = both & c
    return both & (F.col("p") + F.col("q") + F.col("sp") + F.col("sq") <= MOST_SUM)


def searched(jobs: DataFrame, m: int, box_cox: bool = False, rounds: int = 30) -> DataFrame:
    """``jobs`` (job, y, x: arrays) with power, the order and parameters of the best model; jobs of fewer than ``LEAST``
    values are left out. A series too short for its season gets a model without one."""
    ready = jobs.where(F.size("y") >= LEAST)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema)
    ready = settled(ready.mapInPandas(_prepared(m, box_cox), f"{fields}, power double, d int"))
    seasonal = (F.size("y") > 3 * m) if m > 1 else F.lit(False)
    asked = ready.select("job", "d", seasonal.alias("seasonal"), F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("p", "q", "sp", "sq"), b))) for b in BEGINNINGS))).alias("o"))
    asked = asked.select("job", "d", "seasonal", "o.*", F.lit(True).alias("constant")).where(_allowed(F.col("seasonal")) | (~F.col("seasonal") & (F.col("sp") + F.col("sq") == 0)))
    tried = None
    for _ in range(rounds):
        orders = asked.select("job", "p", "d", "q", "sp", F.when(F.col("seasonal"), 1).otherwise(0).alias("sd"), "sq", F.when(F.col("seasonal"), m).otherwise(1).alias("m"), "constant").distinct()
        dealt = ready.select("job", "y", "x", "power").join(orders, "job").repartition(_width(ready), "job", *ORDER_COLUMNS)
        found = dealt.mapInPandas(_fits, _FIT)
        tried = settled(found if tried is None else tried.unionByName(found))
        best = Window.partitionBy("job").orderBy("aicc", *ORDER_COLUMNS)
        ahead = tried.withColumn("nth", F.row_number().over(best)).where("nth = 1").withColumn("seasonal", F.col("m") > 1)
        asked = ahead.select("job", "d", "seasonal", F.explode(_neighbours()).alias("o")).select("job", "d", "seasonal", "o.*").where(_allowed(F.col("seasonal")))
        asked = settled(asked.join(tried.select("job", "p", "q", "sp", "sq", "constant"), ["job", "p", "q", "sp", "sq", "constant"], "left_anti"))
        if asked.isEmpty():
            break
    chosen = tried.withColumn("nth", F.row_number().over(best)).where("nth = 1 AND aicc < double('inf')").drop("nth")
    return ready.drop("d").join(chosen, "job")


def _width(df: DataFrame) -> int:
    return max(2, df.sparkSession.sparkContext.defaultParallelism)


def with_order(jobs: DataFrame, order: Order) -> DataFrame:
    """``jobs`` with the parameters of one given order, in place of a search."""
    given = jobs.select("*", F.lit(None).cast("double").alias("power"), *(F.lit(getattr(order, a)).alias(c) for a, c in zip(("p", "d", "q", "sp", "sd", "sq", "m", "constant"), ORDER_COLUMNS)))
    fitted = given.select("job", "y", "x", "power", *ORDER_COLUMNS).repartition(_width(jobs), "job").mapInPandas(_fits, _FIT).where("aicc < double('inf')")
    return jobs.withColumn("power", F.lit(None).cast("double")).join(fitted, "job")


def forecasts(models: DataFrame, future: str | None = None, steps: str = "steps") -> DataFrame:
    """``models`` with forecast, lower and upper (arrays): as many steps as a column says; ``future`` has the exogenous
    columns' arrays for them. Limits are of 95 %."""
    told = models.withColumn("x_next", F.col(future) if future else F.array().cast("array<array<double>>")).withColumn("steps", F.col(steps))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema if f.name not in ("x_next",))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            made = []
            for _, row in rows.iterrows():
                y, x = _parts(row)
                h = int(row["steps"])
                ahead = np.array([np.asarray(c, float) for c in row["x_next"]]).reshape(len(row["x_next"]), h).T if len(row["x_next"]) else np.zeros((h, 0))
                got, sd = forecast(Fitted(_order_of(row), np.asarray(row["free"], float), np.asarray(row["beta"], float), row["sigma2"], row["aicc"], len(y)), y, x, ahead, h)
                power = None if pd.isna(row["power"]) else row["power"]
                made.append([_unpowered(got + k * sd, power).tolist() for k in (0.0, -1.959963984540054, 1.959963984540054)])
            yield rows.drop(columns=["x_next"]).assign(**{c: [r[k] for r in made] for k, c in enumerate(("forecast", "lower", "upper"))})

    return told.mapInPandas(run, f"{fields}, forecast array<double>, lower array<double>, upper array<double>")


def as_rows(df: DataFrame, keys: Sequence[str], order: str, value: str, exogenous: Sequence[str] = ()) -> DataFrame:
    """(keys..., y, x): each series as one row, ordered; rows without the value or one of the columns are left out."""
    told = df.where(F.col(value).isNotNull()).na.drop(subset=list(exogenous)) if exogenous else df.where(F.col(value).isNotNull())
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(exogenous)))))
    columns = [F.col(f"rows.x{k}") for k in range(len(exogenous))]
    return told.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.col("rows.y").alias("y"), (F.array(*columns) if columns else F.array().cast("array<array<double>>")).alias("x"))


def exogenous_ahead(series: DataFrame, steps: int, mode: str, m: int, order: Order | None = None, box_cox: bool = False) -> DataFrame:
    """``series`` (job, y, x) with x_ahead: each exogenous column's next values, by a model of its own (``sarima``), its
    last value (``last``) or its mean (``mean``); ``none`` takes the columns away."""
    if mode == "none":
        return series.withColumn("x", F.array().cast("array<array<double>>")).withColumn("x_ahead", F.col("x"))
    if mode in ("last", "mean"):
        last = lambda c: F.element_at(c, -1)
        mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.size(c)
        return series.withColumn("x_ahead", F.transform("x", lambda c: F.array_repeat((last if mode == "last" else mean)(c), steps)))
    if mode != "sarima":
        raise ValueError(f"mode is sarima, last, mean or none, not {mode}")
    each = series.select("job", F.posexplode("x").alias("nth", "y"))
    jobs = each.select(F.concat_ws("|", "job", F.col("nth").cast("string")).alias("job"), "y", F.array().cast("array<array<double>>").alias("x"), F.col("job").alias("of"), "nth", F.lit(steps).alias("steps"))
    models = searched(jobs, m, box_cox) if order is None else with_order(jobs, order)
    told = forecasts(models).groupBy(F.col("of").alias("job")).agg(F.sort_array(F.collect_list(F.struct("nth", "forecast"))).alias("f")).select("job", F.col("f.forecast").alias("x_ahead"))
    joined = series.join(told, "job", "left")
    return joined.withColumn("x_ahead", F.coalesce("x_ahead", F.array().cast("array<array<double>>"))).where(F.size("x_ahead") == F.size("x"))


def _errors(test: Column, forecast: Column) -> tuple[Column, Column]:
    pairs = F.zip_with(test, forecast, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mean = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, v: s + v) / F.size(test)
    return mean(lambda r: F.abs(r["a"] - r["b"])), mean(lambda r: 100 * ratio(F.abs(r["a"] - r["b"]), F.greatest(F.lit(1e-8), F.abs(r["a"]))))


def sarimax(df: DataFrame, keys: Sequence[str], order_by: str, value: str, exogenous: Sequence[str] = (), m: int = 12, steps: int = 12, mode: str = "sarima", box_cox: bool = False, order: Order | None = None, share: float = 0.8) -> DataFrame:
    """(keys..., step, forecast, lower, upper, p, d, q, sp, sd, sq, m, mae, mape): models by search, or of a given order.

    Errors are of a model of the first ``share`` of a series on the rest, with the rest's own exogenous values; null where
    that part is too short. Series of fewer than ``LEAST`` values have no rows.
    """
    series = as_rows(df, keys, order_by, value, exogenous).withColumn("job", F.to_json(F.struct(*keys)) if keys else F.lit("all"))
    series = settled(series.where(F.size("y") >= LEAST))
    if mode == "none":
        series = series.withColumn("x", F.array().cast("array<array<double>>"))
    cut, rest = F.col("cut"), F.col("rest")
    sized = series.withColumn("cut", F.floor(F.size("y") * share).cast("int")).withColumn("rest", F.size("y") - F.col("cut"))
    back = sized.select(
        F.concat(F.lit("back|"), "job").alias("job"), F.slice("y", F.lit(1), cut).alias("y"), F.transform("x", lambda c: F.slice(c, F.lit(1), cut)).alias("x"), F.col("job").alias("of"),
        rest.alias("steps"), F.transform("x", lambda c: F.slice(c, cut + 1, rest)).alias("x_ahead"), F.slice("y", cut + 1, rest).alias("test"),
    )
    whole = exogenous_ahead(series.select("job", "y", "x"), steps, mode, m, order, box_cox)
    whole = whole.select(F.concat(F.lit("all|"), "job").alias("job"), "y", "x", F.col("job").alias("of"), F.lit(steps).alias("steps"), "x_ahead", F.lit(None).cast("array<double>").alias("test"))
    jobs = back.unionByName(whole)
    models = searched(jobs, m, box_cox) if order is None else with_order(jobs.where(F.size("y") >= LEAST), order)
    told = settled(forecasts(models, "x_ahead"))
    mae, mape = _errors(F.col("test"), F.col("forecast"))
    errors = told.where(F.col("test").isNotNull()).select(F.col("of").alias("job"), mae.alias("mae"), mape.alias("mape"))
    ahead = told.where(F.col("test").isNull()).select(F.col("of").alias("job"), *ORDER_COLUMNS, F.posexplode(F.arrays_zip("forecast", "lower", "upper")).alias("at", "v"))
    named = series.select("job", *keys)
    return named.join(ahead, "job").join(errors, "job", "left").select(*keys, (F.col("at") + 1).alias("step"), "v.forecast", "v.lower", "v.upper", *(c for c in ORDER_COLUMNS if c != "constant"), "mae", "mape")
