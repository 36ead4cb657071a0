"""Plans of the tests after a fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.lineage import written
from tidewrack.operators import arima, posthoc, smoothing, statistics
from tidewrack.plans.base import OBS, SERIES, observations, query, rounded, series


@query(f"""WITH {OBS}, r AS (SELECT phylum, rank() OVER (ORDER BY density) + (count(*) OVER (PARTITION BY density) - 1) / 2.0 AS rk FROM obs), m AS (SELECT phylum, count(*) AS n, avg(rk) AS r FROM r GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs),
    c AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM obs GROUP BY density)) SELECT a.phylum AS group1, b.phylum AS group2, round((a.r - b.r) / sqrt((n.n * (n.n + 1) / 12 - ties / (12 * (n.n - 1))) * (1.0 / a.n + 1.0 / b.n)), 5) AS z FROM m a JOIN m b ON a.phylum < b.phylum CROSS JOIN n CROSS JOIN c""")
def dunn_test(spark, d):
    """Q19."""
    return posthoc.dunn(observations(spark, d), "phylum", "density").select("group1", "group2", F.round("z", 5).alias("z"))


@query(f"""WITH {OBS}, g AS (SELECT phylum, count(*) AS n, avg(density) AS m, var_pop(density) * count(*) AS ss FROM obs GROUP BY 1), w AS (SELECT sum(ss) / (sum(n) - count(*)) AS w FROM g)
    SELECT a.phylum AS group1, b.phylum AS group2, round(b.m - a.m, 5) AS diff, round(abs(b.m - a.m) / sqrt(w / 2 * (1.0 / a.n + 1.0 / b.n)), 5) AS q FROM g a JOIN g b ON a.phylum < b.phylum CROSS JOIN w""")
def tukey_test(spark, d):
    """Q14."""
    return posthoc.tukey(observations(spark, d), "phylum", "density").select("group1", "group2", F.round("diff", 5).alias("diff"), F.round("q", 5).alias("q"))


def _fit(spark, d):
    obs = observations(spark, d)
    first, *sites = [r[0] for r in obs.select("site").distinct().orderBy("site").limit(1000).collect()]  # the model's own terms
    terms = {"(intercept)": F.lit(1), "tax": F.col("tax")} | {s: F.when(F.col("site") == s, 1.0).otherwise(0.0) for s in sites}
    levels = {first: {"(intercept)": 1.0, "tax": 0.04}} | {s: {"(intercept)": 1.0, "tax": 0.04, s: 1.0} for s in sites}
    return obs, terms, levels, statistics.least_squares(obs, terms, "density", "HC3")


@query(f"""WITH {OBS}, g AS (SELECT site, count(*) AS n, avg(tax) AS mx, avg(density) AS my, regr_sxx(density, tax) AS sxx, regr_sxy(density, tax) AS sxy FROM obs GROUP BY 1),
    w AS (SELECT sum(sxx) AS wxx, sum(sxy) / sum(sxx) AS b FROM g),
    e AS (SELECT obs.site, tax - mx AS dx, n, (density - my - b * (tax - mx)) / (1 - 1.0 / n - (tax - mx) ** 2 / wxx) AS e FROM obs JOIN g ON obs.site = g.site CROSS JOIN w),
    p AS (SELECT a.site AS level1, c.site AS level2, a.my - c.my - b * (a.mx - c.mx) AS diff, (a.mx - c.mx) / wxx AS tilt FROM g a JOIN g c ON a.site < c.site CROSS JOIN w),
    v AS (SELECT level1, level2, max(diff) AS diff, sqrt(sum((e * (CASE WHEN site = level1 THEN 1.0 / n WHEN site = level2 THEN -1.0 / n ELSE 0 END - tilt * dx)) ** 2)) AS se FROM p CROSS JOIN e GROUP BY 1, 2)
    SELECT level1, level2, round(diff, 5) AS diff, round(se, 5) AS se, round(diff / se, 4) AS t FROM v""")
def marginal_contrasts(spark, d):
    """Q13: differences of sites' means at one tax, with HC3 errors."""
    *_, levels, fit = _fit(spark, d)
    rows = [(a, b, round(diff, 5), round(se, 5), round(t, 4)) for a, b, diff, se, t, *_ in posthoc.contrasts(fit, levels)]
    return spark.createDataFrame(rows, "level1 string, level2 string, diff double, se double, t double")


@query()
def marginal_means(spark, d):
    """Q13: sites' means at one tax with their limits, and p of all contrasts by Holm's rule."""
    *_, levels, fit = _fit(spark, d)
    rows = [(s, None, m, se, low, high, None) for s, m, se, low, high in posthoc.marginal_means(fit, levels)]
    rows += [(a, b, diff, se, None, None, p) for a, b, diff, se, _, _, p in posthoc.contrasts(fit, levels)]
    return rounded(spark.createDataFrame(rows, "level1 string, level2 string, estimate double, se double, low double, high double, p_holm double"))


@query()
def residual_diagnostics(spark, d):
    """Q15-Q17, Q29: joint test, normality, heteroscedasticity and order of residuals."""
    obs, terms, levels, fit = _fit(spark, d)
    fitted = sum((float(b) * c for b, c in zip(fit.coefficients, terms.values())), F.lit(0.0))
    told = obs.select("site", "ord", "line", (F.col("density") - fitted).alias("e"))
    shape = posthoc.shapiro(told.withColumn("all", F.lit("all")), ["all"], "e", ["ord", "line"]).first()
    order = statistics.residual_tests(told.withColumn("at", F.col("ord") * 10 + F.col("line")), ["site"], "e", "at").agg(F.avg("durbin_watson"), F.sum("jarque_bera")).first()
    f, _, p = posthoc.wald(fit, list(terms)[2:])
    lm, lm_p = posthoc.breusch_pagan(obs, terms, "density")
    rows = [("wald", f, p), ("shapiro_wilk", shape["w"], shape["p"]), ("breusch_pagan", lm, lm_p), ("durbin_watson", order[0], None), ("jarque_bera", order[1], None)]
    return spark.createDataFrame([(n, float(s), None if q is None else float(q)) for n, s, q in rows], "test string, statistic double, p double")


@query()
def transform_choice(spark, d):
    """Candidates by skewness, and the lambda of Box and Cox."""
    obs = written(observations(spark, d).select("biovolume"))
    rows = posthoc.least_skewed(obs, "biovolume") + [("box_cox_lambda", posthoc.box_cox_lambda(obs, "biovolume"))]
    return spark.createDataFrame([(k, round(v, 4)) for k, v in rows], "transform string, value double")


@query(f"""WITH {SERIES}, t AS (SELECT kind, day, value, row_number() OVER (PARTITION BY kind ORDER BY day) - 1 AS ix, CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END AS trend FROM series WINDOW w AS (PARTITION BY kind ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    p AS (SELECT kind, ix % 7 AS place, avg(value - trend) AS s FROM t GROUP BY 1, 2), c AS (SELECT kind, place, s - avg(s) OVER (PARTITION BY kind) AS season FROM p)
    SELECT t.kind, CAST(day AS VARCHAR) AS day, round(trend, 5) AS trend, round(season, 5) AS season, round(value - trend - season, 5) AS rest FROM t JOIN c ON t.kind = c.kind AND t.ix % 7 = c.place""")
def seasonal_parts(spark, d):
    """T6, by moving averages."""
    got = posthoc.decomposed(series(spark, d).select("kind", "day", "value"), ["kind"], "day", "value", 7)
    return got.select("kind", F.col("day").cast("string").alias("day"), *(F.round(c, 5).alias(c) for c in ("trend", "season", "rest")))


@query()
def autoregressive_forecasts(spark, d):
    """T7, T8, by lags of a day and a week."""
    return rounded(posthoc.autoregressive_forecast(series(spark, d), ["kind"], "day", "value"), 4)


_MONTHS = f"""{OBS}, monthly AS (SELECT site, (year - 1970) * 12 + month AS month, avg(density) AS y, avg(discount) AS x0, avg(tax) AS x1 FROM obs GROUP BY 1, 2)"""


def _monthly(spark, d):
    """(site, month, y, x0, x1): monthly means of density, discount and tax."""
    month = (F.col("year") - 1970) * 12 + F.col("month")
    return observations(spark, d).groupBy("site", month.alias("month")).agg(F.avg("density").alias("y"), F.avg("discount").alias("x0"), F.avg("tax").alias("x1"))


@query()
def sarimax_by_search(spark, d):
    """Orders by corrected AIC, 80/20 backtest, exogenous columns by models of their own."""
    return rounded(arima.sarimax(_monthly(spark, d), ["site"], "month", "y", ["x0"], m=12, steps=12))


@query()
def sarimax_of_one_order(spark, d):
    """(1,1,1)(1,1,1,6) over two-month means of log density, 18 steps, back from the logarithm."""
    two = F.floor(F.col("month") / 2).alias("two")
    logs = _monthly(spark, d).groupBy("site", two).agg(F.avg(F.log10(F.col("y") + 1)).alias("y"), F.avg("x0").alias("x0"))
    order = arima.Order(1, 1, 1, 1, 1, 1, 6, constant=False)
    got = arima.sarimax(logs, ["site"], "two", "y", ["x0"], m=6, steps=18, order=order)
    return rounded(got.select("site", "step", *((F.pow(F.lit(10.0), c) - 1).alias(c) for c in ("forecast", "lower", "upper")), "mae", "mape"))


@query(f"""WITH {_MONTHS}, e AS (SELECT site, arg_max(x0, month) AS l0, arg_max(x1, month) AS l1, avg(x0) AS m0, avg(x1) AS m1 FROM monthly GROUP BY 1)
    SELECT site, CAST(step AS INTEGER) AS step, round(l0, 6) AS last0, round(l1, 6) AS last1, round(m0, 6) AS mean0, round(m1, 6) AS mean1 FROM e CROSS JOIN generate_series(1, 4) AS g(step)""")
def exogenous_projections(spark, d):
    """The modes ``last`` and ``mean``."""
    rows = arima.as_rows(_monthly(spark, d), ["site"], "month", "y", ["x0", "x1"]).withColumnRenamed("site", "job")
    told = None
    for mode in ("last", "mean"):
        got = arima.exogenous_ahead(rows, 4, mode, 12).select(F.col("job").alias("site"), F.posexplode(F.arrays_zip(F.col("x_ahead")[0].alias("a"), F.col("x_ahead")[1].alias("b"))).alias("at", "v"))
        got = got.select("site", (F.col("at") + 1).alias("step"), F.round("v.a", 6).alias(f"{mode}0"), F.round("v.b", 6).alias(f"{mode}1"))
        told = got if told is None else told.join(got, ["site", "step"])
    return told


@query()
def smoothing_splines(spark, d):
    """Splines that leave as much as differences of neighbours show as noise."""
    return rounded(smoothing.splines(series(spark, d).select("kind", "day", "value"), ["kind"], "day", "value", factor=1.0))


@query()
def robust_seasonal_parts(spark, d):
    """Season, trend and rest of monthly means by robust local regression."""
    return rounded(smoothing.deseasonalised(_monthly(spark, d).select("site", "month", "y"), ["site"], "month", "y", 12))
