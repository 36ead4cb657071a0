import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import dissimilarity, filters, learning, ordination, posthoc, statistics, windows
from tidewrack.sources import tables as sources


def test_penalties_equal_their_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.2] + 3
    y = x @ [1.0, 0.5, -4.0] + rng.normal(size=120)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = statistics.penalised(df, ["a", "b", "c"], "y", 2.5)
    assert np.allclose(list(got.values()), np.linalg.solve(z.T @ z + 2.5 * np.eye(3), z.T @ (y - y.mean())))
    raw = statistics.penalised(df, ["a", "b", "c"], "y", 0.0, standardise=False)
    assert np.allclose(list(raw.values()), np.linalg.lstsq(np.column_stack([x, np.ones(120)]), y, rcond=None)[0][:3])
    for alpha in (0.01, 0.3, 5.0):
        b = np.array(list(statistics.penalised(df, ["a", "b", "c"], "y", alpha, "lasso").values()))
        slope = z.T @ (y - y.mean() - z @ b) / 120
        assert all(abs(g - alpha * np.sign(v)) < 1e-8 if v else abs(g) <= alpha + 1e-8 for g, v in zip(slope, b))
    assert alpha == 5.0 and not b.any()


def test_band_of_a_power_law(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(1, 50, 40)
    y = 3 * x**-0.5 * np.exp(rng.normal(0, 0.2, 40))
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("g", -1.0, 2.0)], "k string, x double, y double")
    rows = statistics.power_band(df, ["k"], "x", "y", 5).orderBy("x").collect()
    d = np.column_stack([np.ones(40), np.log(x)])
    inverse = np.linalg.inv(d.T @ d)
    b = inverse @ d.T @ np.log(y)
    s2 = ((np.log(y) - d @ b) ** 2).sum() / 38
    for r, at in zip(rows, np.linspace(x.min(), x.max(), 5)):
        v = np.array([1, math.log(at)])
        se = math.sqrt(s2 * v @ inverse @ v)
        assert math.isclose(r["x"], at) and math.isclose(r["fit"], math.exp(v @ b)) and math.isclose(r["se"], se)
        assert math.isclose(r["low"], math.exp(v @ b - 2.0243941639 * se), rel_tol=1e-6) and math.isclose(r["high"], math.exp(v @ b + 2.0243941639 * se), rel_tol=1e-6)


def test_the_most_normal_transform_comes_first(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.exp(rng.normal(2, 0.7, 400)))], "id int, v double")
    rows = posthoc.most_normal(df, "v", ["id"]).orderBy("nth").collect()
    assert rows[0]["transform"] in ("box_cox", "log_shift", "log10_shift", "log1p", "log10p") and rows[0]["p"] > 0.05
    assert {r["transform"] for r in rows} == {"raw", "log_shift", "log1p", "log10_shift", "log10p", "sqrt", "sqrt_shift", "cube_root", "box_cox", "z"}
    assert [r["p"] for r in rows] == sorted((r["p"] for r in rows), reverse=True) and rows[-1]["p"] < 1e-6
    shifted = posthoc.most_normal(df.withColumn("v", F.col("v") - 20), "v", ["id"]).collect()
    assert "box_cox" not in {r["transform"] for r in shifted} and len(shifted) == 9


def test_scaling_by_quartiles(spark):
    v = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame([("a", x) for x in v] + [("flat", 3.0), ("flat", 3.0), (None, 1.0), (None, 2.0)], "k string, v double")
    got = windows.robust_scaled(df, ["k"], "v", "z")
    assert sorted(r["z"] for r in got.where("k = 'a'").collect()) == [(x - 4) / 6 for x in v]
    assert all(r["z"] is None for r in got.where("k = 'flat'").collect()) and got.where("k IS NULL").count() == 2


@pytest.mark.parametrize("metric", ["braycurtis", "manhattan", "canberra", "jaccard", "sorensen", "cosine", "euclidean"])
def test_metrics(spark, metric):
    m = np.array([[1.0, 0, 3, 2], [0, 2, 1, 0], [4, 0, 0, 0], [0, 0, 0, 5]])
    df = spark.createDataFrame([(f"s{i}", f"t{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "s string, t string, x double")
    got = {(r["i"], r["j"]): r["d"] for r in dissimilarity.by_name(df, "s", "t", "x", metric).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = m[i], m[j]
            some = (a + b) > 0
            want = {
                "braycurtis": np.abs(a - b).sum() / (a + b).sum(), "manhattan": np.abs(a - b).sum(), "canberra": (np.abs(a - b)[some] / (a + b)[some]).sum(), "jaccard": 1 - ((a > 0) & (b > 0)).sum() / some.sum(),
                "sorensen": 1 - 2 * ((a > 0) & (b > 0)).sum() / ((a > 0).sum() + (b > 0).sum()), "cosine": 1 - a @ b / math.sqrt((a @ a) * (b @ b)), "euclidean": np.sqrt(((a - b) ** 2).sum()),
            }[metric]
            assert math.isclose(got[f"s{i}", f"s{j}"], want, abs_tol=1e-12)
    with pytest.raises(ValueError):
        dissimilarity.by_name(df, "s", "t", "x", "none")


def test_correspondence_scores_equal_the_dense_ones(spark):
    rng = np.random.default_rng(4)
    y, x = rng.poisson(4, size=(15, 6)).astype(float), rng.normal(size=(15, 2))
    cells = spark.createDataFrame([(f"s{i:02d}", f"t{j}", float(y[i, j])) for i in range(15) for j in range(6)], "s string, t string, x double")
    env = spark.createDataFrame([(f"s{i:02d}", *map(float, x[i])) for i in range(15)], "s string, a double, b double")
    sites, taxa, inertia, loadings = ordination.correspondence_scores(cells, env, "s", "t", "x", ["a", "b"])
    p = y / y.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    q = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    xc = (x - r @ x) * np.sqrt(r)[:, None]
    u, s, vt = np.linalg.svd(xc @ np.linalg.lstsq(xc, q, rcond=None)[0], full_matrices=False)
    assert np.allclose(inertia, s[:2] ** 2)
    got = sites.orderBy("s").toPandas()[["cca1", "cca2"]].to_numpy()
    want = u[:, :2] / np.sqrt(r)[:, None]
    turn = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * turn) and np.allclose(r @ got**2, 1)
    assert np.allclose(taxa.orderBy("t").toPandas()[["cca1", "cca2"]].to_numpy(), (vt[:2] / np.sqrt(c)).T * turn)
    for k, (_, *row) in enumerate(loadings):
        assert np.allclose(row, [(r * (x[:, k] - r @ x[:, k]) * got[:, a]).sum() / math.sqrt(r @ (x[:, k] - r @ x[:, k]) ** 2) for a in range(2)])


def test_columns_that_are_mostly_numbers(spark):
    df = spark.createDataFrame([("1", "x", None, 1), ("2", "3", None, 2), ("y", "z", None, 3)], "a string, b string, c string, d int")
    assert filters.mostly_numbers(df) == ["a", "d"] and filters.mostly_numbers(df, 0.3) == ["a", "b", "d"]


def test_grid_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(i, *map(float, r), float(3 * r[0] - r[1])) for i, r in enumerate(x)], "id int, a double, b double, y double")
    best, told = learning.grid_search(learning.folds(df, ["id"], 3), ["a", "b"], learning.linear("y"), {"regParam": [0.0, 5.0]}, "y", 3)
    assert told[0][1] < 1e-3 < told[1][1] and np.allclose(best.stages[-1].coefficients, [3, -1], atol=1e-4)


def test_models_are_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "a double, y double")
    model = learning.fit(df, ["a"], learning.linear("y"))
    learning.save(model, str(tmp_path / "m"))
    again = learning.load(str(tmp_path / "m"))
    assert [r["prediction"] for r in again.transform(df).collect()] == [r["prediction"] for r in model.transform(df).collect()]


def test_features(spark):
    df = spark.createDataFrame([("a", "2020-01-01", 1.0, None), ("a", "2020-02-01", 2.0, 4.0), ("a", "2021-03-01", 3.0, 6.0)], "k string, d string, y double, x double").withColumn("d", F.to_date("d"))
    rows = learning.features(df, "k", "d", "y", ["x"]).orderBy("d").collect()
    assert [(r["lag_1"], r["month"], r["year"], r["x"]) for r in rows] == [(1.0, 2, 2020, 4.0), (2.0, 3, 2021, 6.0)]


def test_the_first_row_with_a_role(spark):
    df = spark.createDataFrame([(0, "X", "Y", "L"), (1, "x", None, "f"), (2, " a ", "mean", "A"), (3, "A", "A", "A")], "row int, p string, q string, r string")
    assert sources.columns_with_role(df, "A") == ["p", "r"] and sources.columns_with_role(df, "A", [2]) == ["p", "q", "r"] and sources.columns_with_role(df, "Z") == []


def test_small_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    sources.write_json(df, str(tmp_path / "j"))
    assert sorted((r["n"], r["t"]) for r in spark.read.schema(df.schema).json(str(tmp_path / "j")).collect()) == [(1, "a"), (2, None)]
    assert [tuple(r) for r in sources.report({"rows": 2, "mean": 1.5}, spark).collect()] == [("rows", "2"), ("mean", "1.5")]
    assert filters.has_rows(df) and not filters.has_rows(df.where("n > 5"))
