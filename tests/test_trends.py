import numpy as np
import pytest

from tidewrack.operators import statistics


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 200])
@pytest.mark.parametrize("ties", [True, False])
def test_pairs_are_counted(n, ties):
    rng = np.random.default_rng(n)
    y = rng.integers(0, 5, n).astype(float) if ties else rng.normal(size=n)
    i, j = np.triu_indices(n, 1)
    assert statistics.ordered_pairs_rising(y) == (int((y[j] > y[i]).sum()), int((y[j] < y[i]).sum()))


@pytest.mark.parametrize("n", [3, 40, 151, 152])
@pytest.mark.parametrize("ties", [True, False])
def test_median_slope_without_listing(monkeypatch, n, ties):
    rng = np.random.default_rng(n)
    t = np.cumsum(rng.integers(1, 4, n)).astype(float)
    y = rng.integers(0, 4, n).astype(float) if ties else 0.3 * t + rng.normal(size=n)
    i, j = np.triu_indices(n, 1)
    want = np.median((y[j] - y[i]) / (t[j] - t[i]))
    assert np.isclose(statistics.median_slope(t, y), want)
    monkeypatch.setattr(statistics, "LISTED", 2)
    assert np.isclose(statistics.median_slope(t, y), want, atol=1e-9)


def test_a_long_series(spark):
    rng = np.random.default_rng(5)
    y = 0.01 * np.arange(5000) + rng.normal(size=5000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)] + [("b", 1, 2.0)], "k string, t int, v double")
    rows = statistics.kendall(df, ["k"], "t", "v").collect()
    i, j = np.triu_indices(5000, 1)
    assert len(rows) == 1 and rows[0]["s"] == np.sign(y[j] - y[i]).sum() and np.isclose(rows[0]["slope"], np.median((y[j] - y[i]) / (j - i)), atol=1e-9)
