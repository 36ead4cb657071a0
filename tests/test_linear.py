import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import linear


def sample(n=300, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.choice(list("xyz"), n, p=[0.5, 0.3, 0.2]), rng.choice(["k", "l"], n, p=[0.7, 0.3])
    c, e = rng.normal(2, 1, n), rng.normal(size=n)
    y = (a == "y") * 1.0 + (b == "l") * 0.5 + 0.4 * c + (a == "z") * c * 1.2 + rng.normal(0, 1, n)
    return a, b, c, e, y


@pytest.fixture(scope="module")
def data(spark):
    a, b, c, e, y = sample()
    rows = [(str(p), str(q), float(r), float(s), float(t)) for p, q, r, s, t in zip(a, b, c, e, y)] + [(None, "k", 1.0, 1.0, 1.0), ("x", "k", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, c double, e double, y double").withColumn("flat", F.lit(2.0)).withColumn("one", F.lit("only"))
    return linear.cells(df, ["a", "b", "one"], ["c", "e", "flat"], "y")


def coded(values, coding):
    levels = sorted(set(values))
    if coding == "sum":
        return [(values == v).astype(float) - (values == levels[-1]) for v in levels[:-1]]
    return [(values == v).astype(float) for v in levels[1:]]


def design(term, coding):
    a, b, c, e, _ = sample()
    columns = [np.ones(len(a))]
    for name in term:
        made = coded({"a": a, "b": b}[name], coding) if name in "ab" else [{"c": c, "e": e}[name]]
        columns = [x * z for x in columns for z in made]
    return columns


def rss(terms, coding):
    y = sample()[-1]
    x = np.column_stack([np.ones(len(y)), *(col for t in terms for col in design(t, coding))])
    return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()), x.shape[1]


TERMS = [("a",), ("b",), ("c",), ("a", "b"), ("a", "c")]


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_types_equal_dense_models(data, kind):
    coding, n = "sum" if kind == 3 else "treatment", 300
    full, k = rss(TERMS, coding)
    got = linear.anova(data, TERMS, kind)
    for i, (term, effect) in enumerate(zip(TERMS, got)):
        if kind == 1:
            less, more = TERMS[:i], TERMS[: i + 1]
        elif kind == 2:
            less = [t for t in TERMS if t != term and not set(term) < set(t)]
            more = [*less, term]
        else:
            less, more = [t for t in TERMS if t != term], TERMS
        (r0, k0), (r1, k1) = rss(less, coding), rss(more, coding)
        assert effect.df == k1 - k0 and math.isclose(effect.ss, r0 - r1, rel_tol=1e-8, abs_tol=1e-8)
        assert math.isclose(effect.f, (r0 - r1) / (k1 - k0) / (full / (n - k)), rel_tol=1e-8) and math.isclose(effect.eta2, effect.ss / (effect.ss + full))
    assert got[-1].df == n - k and math.isclose(got[-1].ss, full, rel_tol=1e-10)


def test_constant_columns_and_single_levels_are_left_out(data):
    assert list(data.levels) == ["a", "b"] and data.covariates == ["c", "e"] and data.n == 300


def test_interactions_are_kept_only_if_significant(data):
    mains, crossed = linear.terms_of(data, "fxf")
    model, found = linear.with_interactions_if_any(data, mains, crossed)
    assert ("a", "c") in found and model == [*mains, *crossed]
    assert linear.with_interactions_if_any(data, mains, crossed, p=1e-30) == (mains, [])
    left = linear.backward(data, model, found)
    assert {("a",), ("c",), ("a", "c")} <= set(left) and ("e",) not in left


def test_criterion_and_hierarchy(data):
    mains, crossed = linear.terms_of(data)
    left = linear.backward_by_criterion(data, mains, crossed, "bic")
    assert ("a", "c") in left and ("a",) in left and ("c",) in left and ("e",) not in left
    n = 300
    score = lambda ts: n * math.log(rss(ts, "treatment")[0] / n) + math.log(n) * rss(ts, "treatment")[1]
    free = [t for t in left if len(t) > 1 or not any(len(o) > 1 and t[0] in o for o in left)]
    assert all(score([o for o in left if o != t]) >= score(left) for t in free)


def test_inflation(data):
    terms = [("a",), ("c",), ("a", "c")]
    x = np.column_stack([np.ones(300), *(col for t in terms for col in design(t, "sum"))])
    want = []
    for j in range(1, x.shape[1]):
        others = np.delete(x, j, axis=1)
        r = x[:, j] - others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        want.append(((x[:, j] - x[:, j].mean()) ** 2).sum() / (r @ r))
    got = linear.term_inflation(data, terms)
    assert np.allclose([got[("a",)], got[("c",)], got[("a", "c")]], [max(want[:2]), want[2], max(want[3:])])
    assert linear.backward_by_criterion(data, [("a",), ("c",)], [("a", "c")], "aic", most_inflation=1.01)  # ends


def test_forward(data):
    got = linear.forward(data, ["e", "c"])
    assert [c for c, _ in got] == ["c"]
    assert [c for c, _ in linear.forward(data, ["e", "c"], p_enter=1.1)] == ["c", "e"]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (-4.0, 5.0)], "x double, z double")
    rows = lambda mode: [tuple(r) for r in linear.scaled(df, ["x", "z"], mode).collect()]
    assert rows("none") == [(1, 5), (3, 5), (-4, 5)] and np.allclose(rows("mean"), [(1, 0), (3, 0), (-4, 0)])
    sd = np.std([1, 3, -4])
    assert np.allclose(rows("zscore"), [(1 / sd, 0), (3 / sd, 0), (-4 / sd, 0)])
    assert np.allclose(rows("log"), [(math.log(1 + 1 + 5), math.log(6)), (math.log(9), math.log(6)), (math.log(2), math.log(6))])


@pytest.mark.parametrize("lags,piece", [(1, 100_000), (5, 100_000), (5, 20), (17, 17)])
def test_errors_equal_the_dense_sandwich(spark, monkeypatch, lags, piece):
    monkeypatch.setattr(linear, "PIECE", piece)
    rng = np.random.default_rng(3)
    n = 150
    x, e = rng.normal(size=n), np.convolve(rng.normal(size=n + 4), np.ones(5), "valid")
    y, at = 1 + 2 * x + e, rng.permutation(n) * 3
    df = spark.createDataFrame([(int(t), float(a), float(b)) for t, a, b in zip(at, x, y)], "t long, x double, y double")
    got = linear.autocorrelated(df, {"one": F.lit(1), "x": F.col("x")}, "y", "t", lags)
    d = np.column_stack([np.ones(n), x])[np.argsort(at)]
    inverse = np.linalg.inv(d.T @ d)
    u = d * (y[np.argsort(at)] - d @ inverse @ d.T @ y[np.argsort(at)])[:, None]
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    assert np.allclose(got.covariance, inverse @ s @ inverse)


def test_lag_rules():
    assert [linear.lag_rule(n) for n in (1, 100, 60_000)] == [1, 4, 17] and linear.lag_rule(60_000, math.floor) == 16
