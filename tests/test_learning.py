import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidewrack.operators import attributions, learning, posthoc, recipes


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = np.where(x[:, 0] > 0, 3.0, 0.0) + x[:, 1] * (x[:, 0] > 0.5) + rng.normal(0, 0.1, 300)
    return spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(300)], "id int, a double, b double, c double, y double").cache()


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_tree_values_add_up_and_equal_all_orders(rows, kind):
    columns = ["a", "b", "c"]
    model = learning.fit(rows, columns, learning.forest("y", 4, 4) if kind == "forest" else learning.boosted("y", 4, 3))
    got = attributions.tree_attributions(model, rows, columns, ["id"]).toPandas().set_index("id").sort_index()
    said = model.transform(rows).select("id", "prediction", *columns).toPandas().set_index("id").sort_index()
    assert np.allclose(got["prediction"], said["prediction"]) and np.allclose(got[columns].sum(axis=1) + got["base"], said["prediction"])
    own = attributions.leaves(model)

    def known(x, some):
        total = 0.0
        for leaf in own:
            v = leaf.value
            for c, low, high, share in zip(leaf.columns, leaf.above, leaf.upto, leaf.share):
                v *= float(low < x[c] <= high) if c in some else share
            total += v
        return total

    for i in range(0, 300, 60):
        x = said.loc[i, columns].to_numpy()
        assert math.isclose(known(x, ()), got.loc[i, "base"], rel_tol=1e-9)
        for c in range(3):
            others = [o for o in range(3) if o != c]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (known(x, (*s, c)) - known(x, s)) for n in range(3) for s in combinations(others, n))
            assert math.isclose(got.loc[i, columns[c]], want, rel_tol=1e-7, abs_tol=1e-9)


def test_tree_importance(rows):
    model = learning.fit(rows, ["a", "b", "c"], learning.forest("y", 4, 4))
    told = {r["variable"]: r["mean_abs"] for r in attributions.importance(attributions.tree_attributions(model, rows, ["a", "b", "c"], ["id"]), ["a", "b", "c"]).collect()}
    assert told["a"] > 3 * max(told["b"], told["c"])


def test_recipe_steps(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.exponential(2, 500), rng.normal(5, 3, 500), np.full(500, 7.0)])
    df = spark.createDataFrame([(*map(float, r), i) for i, r in enumerate(x)], "a double, b double, flat double, id int")
    told = recipes.Recipe(["a", "b", "flat"], ["yeo_johnson", "center", "scale", "range"])
    got = told.fit(df).transform(df).toPandas()
    assert got[["a", "b"]].min().min() == 0 and got[["a", "b"]].max().max() == 1 and abs(got["a"].skew()) < 0.3 < 1 < abs(df.toPandas()["a"].skew())
    assert set(got.columns) == {"a", "b", "flat", "id"}
    new = told.transform(spark.createDataFrame([(float(x[0, 0]), float(x[0, 1]), 7.0, 0)], df.schema)).first()
    assert math.isclose(new["a"], got["a"][0])
    with pytest.raises(ValueError):
        recipes.Recipe(["a"], ["unknown"]).fit(df)


def test_components_of_a_share(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 2)) * [5, 2]
    x = np.column_stack([base @ [1, 0], base @ [0.8, 0.6], base @ [-0.6, 0.8]]) + rng.normal(0, 0.1, (400, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    recipe = recipes.Recipe(["a", "b", "c"], ["pca"], share=0.9)
    got = recipe.fit(df).transform(df).toPandas()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.9)) + 1
    assert list(got.columns) == [f"pc{i + 1}" for i in range(k)] and np.allclose(got.var(), values[:k])


def test_mixed_sources_come_apart(spark):
    t = np.arange(2000)
    rng = np.random.default_rng(4)
    sources = np.column_stack([np.sign(np.sin(t / 7)), rng.laplace(size=2000), rng.uniform(-1, 1, 2000)])
    x = sources @ np.array([[1, 0.5, 0.3], [0.2, 1, -0.4], [0.6, -0.3, 1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    recipe = recipes.Recipe(["a", "b", "c"], ["ica"])
    got = recipe.fit(df).transform(df).toPandas().to_numpy()
    match = np.abs(np.corrcoef(got.T, sources.T)[:3, 3:])
    assert (match.max(axis=0) > 0.97).all() and sorted(match.argmax(axis=0)) == [0, 1, 2]


def test_exact_rank_sums():
    """Against all ways to choose."""
    for n, m in ((1, 1), (3, 4), (5, 2)):
        counts = np.zeros(n * m + 1)
        for own in combinations(range(n + m), n):
            counts[sum(own) - n * (n - 1) // 2] += 1
        assert np.allclose(posthoc.exact_rank_sums(n, m), counts / counts.sum())
    assert abs(posthoc.exact_rank_sums(49, 49).sum() - 1) < 1e-12


def test_rank_sums_of_pairs(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=12), "b": rng.normal(1, 1, 15), "c": np.round(rng.normal(size=60))}
    df = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own] + [(None, 1.0), ("a", None)], "g string, v double")
    got = {(r["group1"], r["group2"]): r for r in posthoc.rank_sum_pairs(df, "g", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), r in got.items():
        a, b = groups[x], groups[y]
        w = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
        assert r["w"] == w and math.isclose(r["p_bonferroni"], min(1, 3 * r["p"]))
        if "c" not in (x, y):
            chance = posthoc.exact_rank_sums(len(a), len(b))
            assert math.isclose(r["p"], min(1, 2 * min(chance[: int(w) + 1].sum(), chance[int(w) :].sum())))
        else:
            both, n, m = np.r_[a, b], len(a), len(b)
            t = sum(c**3 - c for c in np.unique(both, return_counts=True)[1])
            sd = math.sqrt(n * m / 12 * (n + m + 1 - t / ((n + m) * (n + m - 1))))
            z = (w - n * m / 2 - 0.5 * np.sign(w - n * m / 2)) / sd
            assert math.isclose(r["z"], z) and math.isclose(r["p"], math.erfc(abs(z) / math.sqrt(2)))


def test_one_group_has_no_pairs(spark):
    assert posthoc.rank_sum_pairs(spark.createDataFrame([("a", 1.0)], "g string, v double"), "g", "v").count() == 0


@pytest.mark.parametrize("name,times", [("transform_choice", 1), ("preprocessed_columns", 2), ("variable_importance", 1), ("tree_attributions", 1), ("cross_validated_models", 1), ("grid_of_settings", 1)])
def test_observations_are_joined_once(spark, monkeypatch, name, times):
    """What is read over and over is a table, not the join again. Preprocessed columns are read once to learn and once to be told."""
    import importlib

    from tidewrack.plans import base, catalog

    seen = spark.sparkContext.accumulator(0)

    def told(v):
        seen.add(1)
        return v

    def counted(spark, d):
        return base.observations(spark, d).withColumn("biovolume", F.udf(told, "double").asNondeterministic()("biovolume"))

    monkeypatch.setattr(importlib.import_module(catalog.QUERIES[name].__module__), "observations", counted)
    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES[name](spark, sf).count()
    assert 0 < seen.value <= times * spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_dealt_values(spark):
    """Ranks of two hashes inside buckets; rows that share their ids are told apart by their values, so that reruns agree."""
    rng = np.random.default_rng(6)
    data = [(i // 2, float(a), float(b), float(2 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(data, "id int, a double, b double, y double")
    model = learning.fit(df, ["a", "b"], learning.linear("y"))
    told = [dict(learning.permutation_importance(model, d, ["a", "b"], "y", ["id"])) for d in (df, df.orderBy(F.desc("a")), df.repartition(7))]
    assert all(math.isclose(told[0][c], t[c], rel_tol=1e-9) for t in told for c in "ab")
    hashed = df.select("*", F.pmod(F.xxhash64("id"), F.lit(64)).alias("k"), F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit("a")).alias("ha")).toPandas()
    off = []
    for _, own in hashed.groupby("k"):
        to, of = own.sort_values(["h", "y", "b", "a"])["a"].to_numpy(), own.sort_values(["ha", "y", "b", "a"])["a"].to_numpy()
        off += (2 * (of - to)).tolist()
    assert math.isclose(told[0]["a"], math.sqrt(np.mean(np.square(off))), rel_tol=1e-6)


def test_variances_of_powers(spark):
    from tidewrack.operators import powers

    rng = np.random.default_rng(7)
    x = [*map(float, np.round(rng.normal(3, 4, 3000), 1)), None]
    df = spark.createDataFrame([(v, 7.0) for v in x], "x double, flat double").repartition(3)
    grid = [-3.0, -1e-3, 0.0, 0.5, 2.0, 3.0]
    got = powers.variances(df, powers.yeo_johnson, {"x": grid, "flat": grid}, {"x": float(np.mean(x[:-1])), "flat": 7.0})
    values = np.array(x[:-1])
    for g, v in zip(grid, got["x"]):
        up = np.log1p(np.abs(values)) if g == 0 else ((np.abs(values) + 1) ** g - 1) / g
        down = -np.log1p(np.abs(values)) if g == 2 else -((np.abs(values) + 1) ** (2 - g) - 1) / (2 - g)
        assert math.isclose(v, np.var(np.where(values >= 0, up, down)), rel_tol=1e-8)
    assert got["flat"] == [0.0] * len(grid)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """6000 rows of 60 kinds; one of the kinds has a tenth of them."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 5, 6000), rng.integers(0, 4, 6000)
    a[:600], b[:600] = 2, 3
    y = np.where(a > 2, 5.0, 1.0) + b * (a < 2) - 0.5 * b + rng.normal(0, 2, 6000)
    df = learning.folds(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, y))], "id int, a double, b double, y double"), ["id"], 3)
    path = str(tmp_path_factory.mktemp("repeated") / "t")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _trees(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.stages[-1].trees]


def test_fits_to_counted_rows_are_fits_to_rows(repeated):
    ridge, lasso = learning.linear("y", ridge=0.7), learning.linear("y", 0.1, 0.2)
    whole = learning.forest("y", 3, 3).setBootstrap(False).setFeatureSubsetStrategy("onethird")
    boosted = learning.boosted("y", 4, 2)
    models = [learning.linear("y"), ridge, lasso, whole, boosted]
    counted = learning.Counted(repeated, ["a", "b"], "y", models, ["id"], 50.0)
    assert counted.rows.count() < 400 and counted.rows.agg(F.max("n__")).first()[0] <= 25 and math.isclose(counted.rows.agg(F.sum("n__")).first()[0], 6000)
    for fold in (None, 1):
        seen = repeated if fold is None else repeated.where(F.col("fold") != fold)
        for model in models:
            got, want = counted.fit(model, fold), learning.fit(seen, ["a", "b"], model)
            said = [[r["prediction"] for r in m.transform(repeated.orderBy("id")).collect()] for m in (got, want)]
            assert np.allclose(*said, rtol=1e-9)
            if model in (ridge, lasso):
                assert np.allclose(got.stages[-1].coefficients, want.stages[-1].coefficients, rtol=1e-9) and np.abs(want.stages[-1].coefficients).max() > 0.1


def test_forests_of_counted_rows(repeated, tmp_path):
    """Each tree is the one that Spark grows from the rows that its bootstrap drew."""
    model = learning.forest("y", 4, 3)
    counted = learning.Counted(repeated, ["a", "b"], "y", [model], ["id"], 50.0)
    got = counted.fit(model, 0)
    assert len(_trees(got)) == 4 == len(set(_trees(got))) and got.stages[-1].getNumTrees == 4 and got.stages[-1].numFeatures == 2
    one = learning.forest("y", 1, 3).setBootstrap(False).setFeatureSubsetStrategy("onethird")
    drawn = repeated.select("*", *(F.xxhash64("id", "fold", "a", "b", "y", F.lit(0), F.lit(t)).alias(f"h{t}") for t in range(4)))
    seeds = np.random.default_rng(0).integers(1 << 62, size=4).tolist()
    for t, seed in enumerate(seeds):
        rows = drawn.withColumn("times", learning._drawn(f"h{t}", 1.0)).where("fold != 0").withColumn("again", F.explode(F.expr("CASE WHEN times > 0 THEN sequence(1, times) END")))
        said = [[r["prediction"] for r in m.transform(repeated.orderBy("id")).collect()] for m in (learning.fit(rows, ["a", "b"], one.copy({one.seed: seed})), learning.PipelineModel([got.stages[0], got.stages[-1].trees[t]]))]
        assert np.allclose(*said, rtol=1e-9)
    learning.save(got, str(tmp_path / "m"))
    again = learning.load(str(tmp_path / "m"))
    assert _trees(again) == _trees(got) and dict(learning.forest_importance(again, ["a", "b"])).keys() == {"a", "b"}
    assert np.allclose(attributions.tree_attributions(got, repeated, ["a", "b"], ["id"]).orderBy("id").toPandas()["prediction"], [r["prediction"] for r in got.transform(repeated.orderBy("id")).collect()])


def test_draws_follow_poissons_law(spark):
    for rate in (1.0, 0.3):
        n = 200000
        got = dict(spark.range(n).select(F.xxhash64("id").alias("h")).groupBy(learning._drawn("h", rate).alias("k")).count().collect())
        for k in range(5):
            p = math.exp(-rate) * rate**k / math.factorial(k)
            assert abs(got.get(k, 0) / n - p) < 5 * math.sqrt(p / n) + 1e-5


def _read(df, y):
    """``df`` with a count of how often ``y`` is asked for."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def told(v):
        seen.add(1)
        return v

    return df.withColumn(y, F.udf(told, "double").asNondeterministic()(y)), seen


@pytest.mark.parametrize("kind", ["forest", "line"])
def test_rows_that_repeat_are_read_once_for_a_grid(repeated, monkeypatch, kind):
    """One pass for all settings, folds and bootstraps; a line that is the best is fitted once more, to the rows (it reads them twice)."""
    model, grid = (learning.forest("y", 3, 2), {"maxDepth": [1, 3], "featureSubsetStrategy": ["all", "onethird"]}) if kind == "forest" else (learning.linear("y"), {"regParam": [0.0, 0.5], "elasticNetParam": [0.0, 1.0]})
    df, seen = _read(repeated, "y")
    best, told = learning.grid_search(df, ["a", "b"], model, grid, "y", 3, ids=["id"])
    assert 6000 <= seen.value <= (1 if kind == "forest" else 3) * 6000
    monkeypatch.setattr(learning, "REPEATS", math.inf)
    own, want = learning.grid_search(repeated, ["a", "b"], model, grid, "y", 3)
    assert [s for s, _ in told] == [s for s, _ in want]
    for (setting, g), (_, w) in zip(told, want):  # a few trees of one column each are as it was drawn
        assert math.isclose(g, w, rel_tol={"all": 0.005, "onethird": 0.15}.get(setting.get("featureSubsetStrategy"), 1e-9))
    if kind == "line":
        assert np.allclose(best.stages[-1].coefficients, own.stages[-1].coefficients) and best.stages[-1].summary.numInstances == 6000


def test_what_needs_single_rows_gets_them(repeated):
    """Settings that count or draw rows, and measures that aren't squares."""
    assert not any(map(learning._needs_counts, (learning.forest("y").setMinInstancesPerNode(5), learning.boosted("y").setSubsamplingRate(0.5), learning.boosted("y").setLossType("absolute"), LinearRegression(labelCol="y", loss="huber"), learning.linear("y").setWeightCol("b"))))
    grid = {"minInstancesPerNode": [1, 3000]}
    model = learning.forest("y", 1, 2).setBootstrap(False).setFeatureSubsetStrategy("all")
    for metric in ("rmse", "mae"):
        _, told = learning.grid_search(repeated, ["a", "b"], model, grid, "y", 3, metric)
        for (setting, m), least in zip(told, grid["minInstancesPerNode"]):
            own = [learning.scores(learning.fit(repeated.where(F.col("fold") != f), ["a", "b"], model.copy({model.minInstancesPerNode: least})).transform(repeated.where(F.col("fold") == f)), "y")[metric] for f in range(3)]
            assert setting == {"minInstancesPerNode": least} and math.isclose(m, np.mean(own), rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("kind", ["forest", "line"])
def test_a_missing_target_is_refused(repeated, kind):
    df = repeated.withColumn("y", F.when(F.col("id") != 5, F.col("y")))
    model = learning.forest("y", 2, 2) if kind == "forest" else learning.linear("y")
    with pytest.raises(Exception):
        learning.grid_search(df, ["a", "b"], model, {"maxDepth": [1]} if kind == "forest" else {"regParam": [0.0]}, "y", 3)


def test_models_are_validated_at_once(repeated, monkeypatch):
    """A pass to count rows and one for each fold's scores, of all models."""
    models = {"line": learning.linear("y"), "ridge": learning.linear("y", ridge=1.0), "forest": learning.forest("y", 3, 3), "boosted": learning.boosted("y", 3, 2)}
    df, seen = _read(repeated, "y")
    got = learning.cross_validated(df, ["a", "b"], models, "y", 3, ["id"])
    assert 6000 <= seen.value <= 4 * 6000
    monkeypatch.setattr(learning, "REPEATS", math.inf)
    want = learning.cross_validated(repeated, ["a", "b"], models, "y", 3)
    assert [r[:2] for r in got] == [r[:2] for r in want] == [(name, fold) for name in models for fold in range(3)]
    for g, w in zip(got, want):
        assert np.allclose(g[2:], w[2:], rtol=0.15 if g[0] == "forest" else 1e-9)
