import numpy as np

from tidewrack.operators import niche


def test_null_model_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    sites, taxa = range(14), "abcd"
    x = rng.uniform(-2, 2, 14)
    y = {t: rng.poisson(np.exp(2 - (x - m) ** 2)) for t, m in zip(taxa, (-1, -0.5, 0.5, 1))}
    rows = [(f"s{i:02d}", t, float(x[i]), float(y[t][i])) for i in sites for t in taxa] + [("s00", "rare", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "site string, taxon string, x double, y double")
    got = niche.null_model(df, "site", "taxon", "x", "y", 20).first()
    draws = {t: np.random.default_rng([0, *t.encode()]) for t in taxa}
    means = []
    for run in range(21):
        spans = []
        for t in taxa:
            _, b, c = niche.fit_curve(x, draws[t].permutation(y[t].astype(float)) if run else y[t].astype(float), 25)
            top, width, _ = niche.optimum(b, c)
            if not np.isnan(top):
                spans.append((top - width / 2, top + width / 2))
        own = [max(0.0, min(p[1], q[1]) - max(p[0], q[0])) / (p[1] - p[0]) for p in spans for q in spans if p is not q and p[1] > p[0]]
        means.append(np.mean(own) if own else 0.0)
    assert np.isclose(got["observed"], means[0]) and np.isclose(got["mean"], np.mean(means[1:])) and np.isclose(got["sd"], np.std(means[1:], ddof=1))
    assert np.isclose(got["p_right"], (sum(m >= means[0] for m in means[1:]) + 1) / 21) and got["runs"] == 20
