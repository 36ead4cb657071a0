import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import dissimilarity, ordination


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(18, 3)) + np.repeat([[0, 0, 0], [1.5, 0, 0], [0, 0.5, 0]], [8, 6, 4], axis=0)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    groups = np.repeat(["a", "b", "c"], [8, 6, 4])
    pairs = spark.createDataFrame([(f"s{i:02d}", f"s{j:02d}", float(d[i, j])) for i, j in combinations(range(18), 2)], "i string, j string, d double").repartition(3)
    sites = spark.createDataFrame([(f"s{i:02d}", g) for i, g in enumerate(groups)], "site string, grp string")
    return d, groups, pairs, sites


def f_of(d, labels):
    """Between-group mean square of deviations of distances, one pair at a time."""
    pairs = list(combinations(range(len(labels)), 2))
    grand = np.mean([d[i, j] for i, j in pairs])
    between = 0.0
    for g in set(labels):
        own = [d[i, j] for i, j in pairs if labels[i] == labels[j] == g]
        if own:
            between += sum(x == g for x in labels) * (np.mean(own) - grand) ** 2
    total = sum((d[i, j] - grand) ** 2 for i, j in pairs) + len(labels) * grand**2 / 2
    return between / (len(set(labels)) - 1), total - between, len(labels) - len(set(labels))


def plain(d, labels, n_perm):
    names = sorted(set(labels))
    codes = np.array([names.index(x) for x in labels])
    first, within, left = f_of(d, labels)
    fs = [f_of(d, list(codes_))[0] / (within / left) for codes_ in dissimilarity.permuted(codes, n_perm, 0)]
    return fs[0], (sum(f >= fs[0] - 1e-12 for f in fs[1:]) + 1) / (n_perm + 1)


def test_permanova_equals_a_loop_over_the_same_permutations(table):
    d, groups, pairs, sites = table
    got = dissimilarity.permanova(pairs, sites, 99).first()
    assert np.allclose([got["f"], got["p"]], plain(d, list(groups), 99))


def test_each_two_groups(table):
    d, groups, pairs, sites = table
    rows = {(r["group1"], r["group2"]): r for r in dissimilarity.pairwise_permanova(pairs, sites, 49).collect()}
    assert set(rows) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), r in rows.items():
        own = [i for i, g in enumerate(groups) if g in (a, b)]
        codes = np.array([0 if g == a else 1 if g == b else -1 for g in groups])
        first, within, left = f_of(d[np.ix_(own, own)], [groups[i] for i in own])
        fs = [f_of(d[np.ix_(own, own)], list(labels[own]))[0] / (within / left) for labels in dissimilarity.permuted(codes, 49, 0)]
        p = (sum(f >= fs[0] - 1e-12 for f in fs[1:]) + 1) / 50
        assert math.isclose(r["f"], fs[0]) and math.isclose(r["p"], p) and math.isclose(r["p_adjusted"], min(1.0, 3 * p))


def test_permdisp_equals_a_loop(table):
    d, groups, pairs, sites = table
    got = dissimilarity.permdisp(pairs, sites, 99).first()
    codes = np.array([{"a": 0, "b": 1, "c": 2}[g] for g in groups])
    spread = lambda labels: np.var([d[np.ix_(labels == k, labels == k)].sum() / np.sum(codes == k) ** 2 for k in range(3)])
    vs = [spread(labels) for labels in dissimilarity.permuted(codes, 99, 0)]
    assert math.isclose(got["dispersion"], vs[0]) and math.isclose(got["p"], (sum(v >= vs[0] - 1e-15 for v in vs[1:]) + 1) / 100)


def test_one_group_and_no_pairs(spark, table):
    _, _, pairs, sites = table
    assert dissimilarity.permanova(pairs, sites.where("grp = 'a'")).count() == 0
    got = dissimilarity.permanova(pairs.where("d < 0"), sites, 5).first()
    assert math.isnan(got["f"])


def _stations(n=60, seed=2):
    rng = np.random.default_rng(seed)
    x, t = rng.normal(size=(n, 2)), rng.normal(size=n)
    y = np.column_stack([x[:, 0] + t, 0.5 * x[:, 0] - t, rng.normal(size=n)]) + rng.normal(size=(n, 3))
    return y, x, t


def _frame(spark):
    y, x, t = _stations()
    return spark.createDataFrame([(i, *map(float, (*y[i], *x[i], t[i]))) for i in range(60)], "id int, a double, b double, c double, u double, v double, t double")


def _residual(m, t):
    c = np.column_stack([np.ones(len(t)), t])
    return m - c @ np.linalg.lstsq(c, m, rcond=None)[0]


def _values(y, x, axes=2):
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return np.linalg.svd(fitted, compute_uv=False)[:axes] ** 2 / (len(y) - 1)


def test_redundancy_and_its_permutations_equal_a_loop(spark):
    df = _frame(spark)
    fit = ordination.redundancy(df, ["a", "b", "c"], ["u", "v"], ["t"])
    y, x, t = _stations()
    y, x = _residual(y, t), _residual(x, t)
    assert np.allclose(fit.values(fit.sxy), _values(y, x)) and math.isclose(fit.total, (y**2).sum() / 59)
    got = ordination.redundancy_permutations(df, fit, ["id"], 99)
    order = [r["id"] for r in df.select("id", F.xxhash64(F.lit(0), "id").alias("at")).orderBy("at").collect()]
    y, x = y[order], x[order]
    rng = np.random.default_rng([0, 0])
    drawn = [y, *(y[rng.permutation(60)] for _ in range(99))]
    f = [(v.sum() / 2) / (((y**2).sum() / 59 - v.sum()) / 57) for v in (_values(m, x) for m in drawn)]
    share = lambda many: (sum(m >= many[0] - 1e-12 for m in many[1:]) + 1) / 100
    assert np.allclose(got["global"][0], (f[0], share(f)))
    for a in range(2):
        own = [_values(m, x)[a] for m in drawn]
        assert np.allclose(got["axes"][a], (own[0], share(own)))
        added = [_values(m, x).sum() - _values(m, x[:, [1 - a]], 2).sum() for m in drawn]
        assert np.allclose(got["terms"][a], (added[0], share(added)))
    assert got["global"][0][1] <= 0.05 and got["terms"][0][1] < got["terms"][1][1]


def test_many_parts_still_find_what_is_there(spark, monkeypatch):
    monkeypatch.setattr(ordination, "SWAPPED", 10)
    df = _frame(spark)
    fit = ordination.redundancy(df, ["a", "b", "c"], ["u", "v"], ["t"])
    got = ordination.redundancy_permutations(df, fit, ["id"], 99)
    assert np.isclose(got["global"][0][0], fit.f(fit.values(fit.sxy))) and got["global"][0][1] <= 0.05 < got["terms"][1][1]


def test_scores_lie_on_the_axes(spark):
    df = _frame(spark)
    fit = ordination.redundancy(df, ["a", "b", "c"], ["u", "v"], ["t"])
    rows = ordination.redundancy_scores(df, fit).orderBy("id").toPandas()
    y, x, t = _stations()
    y, x = _residual(y, t), _residual(x, t)
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(rows[["rda1", "rda2"]].to_numpy(), fitted @ fit.loadings())
    assert np.allclose(rows[["rda1", "rda2"]].var(), fit.values(fit.sxy))
    scores, loadings, values = rows[["rda1", "rda2"]].to_numpy(), fit.loadings(), fit.values(fit.sxy)
    assert np.allclose(ordination.biplot(scores, loadings, values, "scaling1")[0] ** 2, scores**2 / values)
    assert np.allclose(ordination.biplot(scores, loadings, values, "scaling1", "vegan")[0], scores)


def test_ranks_are_of_the_values_that_are_correlated(spark):
    """A value that comes out otherwise each time it is worked out, as sums of doubles may, keeps all its rows."""
    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()
    rows = spark.range(200).select(draw("id").alias("x")).withColumn("y", F.col("x") * 3)
    got = ordination.associations(rows, ["x"], ["y"], "spearman").first()
    assert got["value"] is not None and math.isclose(got["value"], 1.0)
