import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import arima
from tidewrack.operators.arima import Order


def simulated(n, phi=(), theta=(), seed=1, sd=1.0):
    e = np.random.default_rng(seed).normal(0, sd, n + 200)
    y = np.zeros(n + 200)
    for t in range(len(y)):
        y[t] = e[t] + sum(c * y[t - k] for k, c in enumerate(phi, 1) if t >= k) + sum(c * e[t - k] for k, c in enumerate(theta, 1) if t >= k)
    return y[200:]


@pytest.mark.parametrize("order", [Order(2, 0, 1), Order(1, 1, 2, 1, 1, 1, 6), Order(0, 0, 0), Order(0, 0, 2, 2, 0, 2, 4)])
def test_likelihood_equals_the_dense_one(order):
    """Innovations solve a triangular system; its determinant is one, so that the sum of squares is the likelihood."""
    rng = np.random.default_rng(3)
    w, free = rng.normal(size=60), rng.normal(size=sum(order.sizes))
    ar, ma = arima.polynomials(free, order)
    lower = lambda c: sum(v * np.eye(60, k=-k) for k, v in enumerate(c) if k < 60)
    assert np.allclose(arima.innovations(w, ar, ma), np.linalg.solve(lower(ma), lower(ar) @ w))


def test_polynomials_are_stationary_and_multiply():
    ar, ma = arima.polynomials(np.array([0.5, -1.0, 0.3, 0.8]), Order(2, 0, 1, 1, 0, 0, 4))
    assert (np.abs(np.roots(ar)) < 1).all() and len(ar) == 7 and np.allclose(ma, [1, -math.tanh(0.3)])


def test_known_parameters_come_back():
    got = arima.fit(simulated(1500, (0.6, -0.3), (0.4,)), np.zeros((1500, 0)), Order(2, 0, 1))
    ar, ma = arima.polynomials(got.free, got.order)
    assert np.allclose(ar[1:], [-0.6, 0.3], atol=0.12) and abs(ma[1] - 0.4) < 0.12 and abs(got.sigma2 - 1) < 0.1


def test_exogenous_coefficients_come_back():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = 3 + x @ [2.0, -1.0] + simulated(400, (0.7,), seed=6)
    got = arima.fit(y, x, Order(1, 0, 0))
    assert np.allclose(got.beta, [2, -1, 3], atol=0.4)


def test_no_worse_than_a_grid():
    y = simulated(120, (0.5,), (0.3,), seed=9)
    order = Order(1, 0, 1)
    got = arima.fit(y, np.zeros((120, 0)), order)
    z = np.ones((120, 1))
    grid = min(arima._solved(np.array([a, b]), order, y, z)[0] for a in np.linspace(-2, 2, 41) for b in np.linspace(-2, 2, 41))
    assert got.sigma2 * 120 <= grid * (1 + 1e-6)


def test_forecasts_of_known_models():
    walk = np.cumsum(simulated(200, seed=2))
    got = arima.fit(walk, np.zeros((200, 0)), Order(0, 1, 0, constant=False))
    ahead, sd = arima.forecast(got, walk, np.zeros((200, 0)), np.zeros((5, 0)), 5)
    assert np.allclose(ahead, walk[-1]) and np.allclose(sd, math.sqrt(got.sigma2) * np.sqrt(np.arange(1, 6)))
    season = np.tile([1.0, 5.0, 2.0, 9.0], 12)
    got = arima.fit(season, np.zeros((48, 0)), Order(0, 0, 0, 0, 1, 0, 4, False))
    assert np.allclose(arima.forecast(got, season, np.zeros((48, 0)), np.zeros((6, 0)), 6)[0], [1, 5, 2, 9, 1, 5])
    ar = simulated(300, (0.8,), seed=4) + 10
    got = arima.fit(ar, np.zeros((300, 0)), Order(1, 0, 0))
    phi, mean = -arima.polynomials(got.free, got.order)[0][1], got.beta[-1]
    assert np.allclose(arima.forecast(got, ar, np.zeros((300, 0)), np.zeros((4, 0)), 4)[0], [mean + phi**h * (ar[-1] - mean) for h in range(1, 5)])


def test_box_cox_and_back():
    y = np.exp(simulated(300, seed=8) * 0.4 + 2)
    power = arima.box_cox_by_likelihood(y)
    assert abs(power) < 0.25 and np.allclose(arima._unpowered(arima._powered(y, power), power), y) and arima.box_cox_by_likelihood(np.array([1.0, 0.0])) is None


def _rows(spark, series, x=None):
    rows = [(k, t, float(v), None if x is None else float(x[k][t])) for k, own in series.items() for t, v in enumerate(own)]
    return spark.createDataFrame(rows, "k string, t int, v double, x double")


def test_search_ends_where_no_neighbour_is_better(spark):
    series = {"ar": simulated(120, (0.7,), seed=11), "short": simulated(20, seed=1), "season": np.tile([0.0, 3, 1, -2], 30) + simulated(120, seed=12)}
    jobs = arima.as_rows(_rows(spark, series), ["k"], "t", "v").withColumn("job", F.col("k"))
    got = {r["job"]: r for r in arima.searched(jobs, 4).collect()}
    assert set(got) == {"ar", "season"}
    for name, r in got.items():
        y, d, sd, m = np.asarray(series[name]), r["d"], r["sd"], r["m"]
        best = (r["p"], r["q"], r["sp"], r["sq"])
        near = [tuple(a + s * b for a, b in zip(best, v)) for v in ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)) for s in (1, -1)]
        for p, q, sp, sq in near:
            if min(p, q, sp, sq) >= 0 and max(p, q, sp, sq) <= arima.MOST:
                other = arima.fit(y, np.zeros((len(y), 0)), Order(p, d, q, sp, sd, sq, m, r["constant"]))
                assert other is None or other.aicc >= r["aicc"] - 1e-6


def test_sarimax_end_to_end(spark):
    rng = np.random.default_rng(2)
    x = {k: np.sin(np.arange(72) / 3) + rng.normal(0, 0.1, 72) for k in "ab"}
    series = {k: 5 + 2 * x[k] + np.tile([0, 1, 0, -1], 18) + simulated(72, (0.4,), seed=7 + i, sd=0.2) for i, k in enumerate("ab")}
    df = _rows(spark, series, x)
    for mode in ("last", "mean", "none", "sarima"):
        got = arima.sarimax(df, ["k"], "t", "v", ["x"], m=4, steps=5, mode=mode, order=Order(1, 0, 0, 0, 1, 1, 4)).collect()
        assert sorted((r["k"], r["step"]) for r in got) == [(k, s) for k in "ab" for s in range(1, 6)]
        assert all(r["lower"] < r["forecast"] < r["upper"] and r["mae"] > 0 for r in got)
        if mode != "none":
            assert all(r["mae"] < 0.6 for r in got)
    first = next(r for r in arima.sarimax(df, ["k"], "t", "v", ["x"], m=4, steps=5, mode="mean", order=Order(1, 0, 0, 0, 1, 1, 4)).collect() if r["k"] == "a" and r["step"] == 3)
    y, z = np.asarray(series["a"]), x["a"].reshape(-1, 1)
    fitted = arima.fit(y, z, Order(1, 0, 0, 0, 1, 1, 4))
    assert math.isclose(first["forecast"], arima.forecast(fitted, y, z, np.full((5, 1), z.mean()), 5)[0][2], rel_tol=1e-9)
    back = arima.fit(y[:57], z[:57], Order(1, 0, 0, 0, 1, 1, 4))
    ahead = arima.forecast(back, y[:57], z[:57], z[57:], 15)[0]
    assert math.isclose(first["mae"], np.abs(ahead - y[57:]).mean(), rel_tol=1e-9) and math.isclose(first["mape"], 100 * np.abs((ahead - y[57:]) / y[57:]).mean(), rel_tol=1e-9)


def test_a_series_too_short_for_a_season_gets_none(spark):
    df = _rows(spark, {"a": simulated(30, (0.5,), seed=3) + 20})
    got = arima.sarimax(df, ["k"], "t", "v", m=12, steps=3).collect()
    assert len(got) == 3 and {r["m"] for r in got} == {1} and {r["sd"] for r in got} == {0}


def test_no_rows_from_no_rows(spark):
    assert arima.sarimax(_rows(spark, {"a": [1.0] * 5}), ["k"], "t", "v", m=4, steps=2).count() == 0
