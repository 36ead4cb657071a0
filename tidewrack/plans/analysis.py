"""Regression, tests, time series and raster plans."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewrack.functions import calendar
from tidewrack.operators import geometry, linear, posthoc, raster, statistics, tables, timeseries, windows
from tidewrack.plans.base import OBS, PIXELS, SERIES, observations, pixels, query, rounded, series, table


@query(f"""WITH {OBS} SELECT site, round(regr_slope(biovolume, density), 4) AS slope, round(regr_intercept(biovolume, density), 3) AS intercept, round(regr_r2(biovolume, density), 6) AS r2, count(*) AS n FROM obs GROUP BY 1""")
def simple_regression(spark, d):
    """Q1, Q26."""
    got = statistics.simple_regression(observations(spark, d), ["site"], "density", "biovolume", p_values=False)
    return got.select("site", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query()
def regression_p_values(spark, d):
    """Q1 with p."""
    return rounded(statistics.simple_regression(observations(spark, d), ["phylum"], "tax", "density"))


@query(f"""WITH {OBS}, l AS (SELECT phylum, ln(biovolume) AS x, ln(density) AS y FROM obs WHERE biovolume > 0 AND density > 0) SELECT phylum, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(regr_r2(y, x), 5) AS r2, count(*) AS n,
    round(sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (count(*) - 2) / regr_sxx(y, x)), 6) AS se_slope FROM l GROUP BY 1""")
def size_density(spark, d):
    """Q2, V3."""
    return statistics.power_law(observations(spark, d), ["phylum"], "biovolume", "density").select("phylum", *(F.round(c, 5).alias(c) for c in ("slope", "intercept", "r2")), "n", F.round("se_slope", 6).alias("se_slope"))


@query(f"""WITH {OBS} SELECT site, 'density' AS x, 'tax' AS y, round(corr(density, tax), 5) AS r, count(*) AS n FROM obs GROUP BY 1 UNION ALL SELECT site, 'density', 'discount', round(corr(density, discount), 5), count(*) FROM obs GROUP BY 1
    UNION ALL SELECT site, 'biovolume', 'tax', round(corr(biovolume, tax), 5), count(*) FROM obs GROUP BY 1 UNION ALL SELECT site, 'biovolume', 'discount', round(corr(biovolume, discount), 5), count(*) FROM obs GROUP BY 1""")
def correlations(spark, d):
    """Q21, Q22: all pairs in one pass."""
    return rounded(statistics.correlations(observations(spark, d), ["site"], ["density", "biovolume"], ["tax", "discount"]), 5)


@query("""SELECT 'l_quantity' AS predictor, round(avg(abs(l_quantity - l_linenumber)), 6) AS mae, round(sqrt(avg((l_quantity - l_linenumber) ** 2)), 6) AS rmse, count(*) AS n FROM lineitem UNION ALL
    SELECT 'l_tax', round(avg(abs(l_tax - l_linenumber)), 6), round(sqrt(avg((l_tax - l_linenumber) ** 2)), 6), count(*) FROM lineitem""")
def prediction_errors(spark, d):
    """Q24, L11."""
    return rounded(statistics.errors(table(spark, d, "lineitem"), "l_linenumber", ["l_quantity", "l_tax"]))


_NORMAL = f"""WITH {OBS}, v AS (SELECT density AS y, discount AS a, tax AS b FROM obs), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM v),
    s AS (SELECT sum((a - ma) ** 2) AS saa, sum((b - mb) ** 2) AS sbb, sum((a - ma) * (b - mb)) AS sab, sum((a - ma) * (y - my)) AS say, sum((b - mb) * (y - my)) AS sby, max(ma) AS ma, max(mb) AS mb, max(my) AS my FROM v CROSS JOIN m),
    k AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM s)"""


@query(f"{_NORMAL} SELECT '(intercept)' AS term, round(my - ba * ma - bb * mb, 4) AS coefficient FROM k UNION ALL SELECT 'discount', round(ba, 4) FROM k UNION ALL SELECT 'tax', round(bb, 4) FROM k")
def multiple_regression(spark, d):
    """Q3: normal equations from one pass; the rows of the answer are the terms."""
    fit = statistics.least_squares(observations(spark, d), {"(intercept)": F.lit(1), "discount": F.col("discount"), "tax": F.col("tax")}, "density", "HC1")
    return spark.createDataFrame([(t, round(b, 4)) for t, b, *_ in fit.table()], "term string, coefficient double")


@query()
def robust_regression(spark, d):
    """Q3: coefficient table with HC3 errors."""
    fit = statistics.least_squares(observations(spark, d), {"(intercept)": F.lit(1), "discount": F.col("discount"), "size": F.col("size")}, "density", "HC3")
    return spark.createDataFrame(fit.table(), "term string, coefficient double, se double, t double, p double")


@query("""WITH v AS (
        SELECT row_number() OVER (ORDER BY event_id) AS t, hour(ts) - avg(hour(ts)) OVER () AS a, user_id - avg(user_id) OVER () AS b, value - avg(value) OVER () AS y FROM events
    ), s AS (
        SELECT sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab, sum(a * y) AS say, sum(b * y) AS sby, count(*) AS n FROM v
    ), k AS (
        SELECT *, saa * sbb - sab * sab AS det, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM s
    ), u AS (
        SELECT t, a * (y - ba * a - bb * b) AS ua, b * (y - ba * a - bb * b) AS ub FROM v CROSS JOIN k
    ), rules AS (
        SELECT 'floored' AS rule, CAST(greatest(1, floor(4 * (n / 100.0) ** (2.0 / 9))) AS BIGINT) AS lags FROM s UNION ALL SELECT 'rounded', CAST(greatest(1, round(4 * (n / 100.0) ** (2.0 / 9))) AS BIGINT) FROM s
    ), crossed AS (
        SELECT rule, lags, lag, sum(x.ua * z.ua) AS aa, sum(x.ub * z.ub) AS bb2, sum(x.ua * z.ub + x.ub * z.ua) / 2 AS ab
        FROM (SELECT rule, lags, unnest(generate_series(0, lags)) AS lag FROM rules) l JOIN u x ON true JOIN u z ON z.t = x.t - l.lag GROUP BY 1, 2, 3
    ), middle AS (
        SELECT rule, lags, sum(w * aa) AS maa, sum(w * bb2) AS mbb, sum(w * ab) AS mab FROM (SELECT *, CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / (lags + 1.0)) END AS w FROM crossed) GROUP BY 1, 2
    )
    SELECT rule, lags, 'hour' AS term, round(ba, 6) AS coefficient, round(sqrt(sbb * sbb * maa - 2 * sbb * sab * mab + sab * sab * mbb) / det, 6) AS se FROM middle CROSS JOIN k
    UNION ALL SELECT rule, lags, 'user', round(bb, 6), round(sqrt(sab * sab * maa - 2 * sab * saa * mab + saa * saa * mbb) / det, 6) FROM middle CROSS JOIN k""")
def autocorrelated_errors(spark, d):
    """Q3, Q4: errors for correlation along the events' order, lags by both rules."""
    events = table(spark, d, "events")
    terms, rows = {"(intercept)": F.lit(1), "hour": F.hour("ts"), "user": F.col("user_id")}, []
    n = events.count()
    for rule, by in (("floored", math.floor), ("rounded", round)):
        fit = linear.autocorrelated(events, terms, "value", "event_id", rule=by)
        rows += [(rule, linear.lag_rule(n, by), t, round(b, 6), round(se, 6)) for t, b, se, *_ in fit.table()[1:]]
    return spark.createDataFrame(rows, "rule string, lags long, term string, coefficient double, se double")


def _logs(spark, d):
    return observations(spark, d).where("density > 0 and biovolume > 0").withColumns({"ld": F.ln("density"), "lb": F.ln("biovolume")})


@query(f"""WITH {OBS}, v AS (SELECT site, ln(density) AS y, ln(biovolume) AS x FROM obs WHERE density > 0 AND biovolume > 0
    ), g AS (
        SELECT site, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM v GROUP BY 1
    ), w AS (
        SELECT count(*) AS k, sum(n) AS n, sum(sxx) AS wxx, sum(sxy) AS wxy, sum(syy) AS wyy, sum(syy - sxy * sxy / sxx) AS full_rss, sum(sxy / sxx) ** 2 / sum(1 / sxx) AS ss3_lb FROM g
    ), o AS (
        SELECT regr_syy(y, x) AS tss, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS lb_rss FROM v
    ), i AS (
        SELECT my - sxy / sxx * mx AS a, 1 / (1.0 / n + mx * mx / sxx) AS weight FROM g
    ), h AS (
        SELECT sum(weight * a * a) - sum(weight * a) ** 2 / sum(weight) AS ss3_site FROM i
    ), s AS (
        SELECT *, wyy - wxy * wxy / wxx AS add_rss FROM w CROSS JOIN o CROSS JOIN h
    ), r AS (
        SELECT 1 AS kind, 'site' AS term, k - 1 AS df, tss - wyy AS ss, full_rss, n - 2 * k AS left_df FROM s UNION ALL SELECT 1, 'lb', 1, wyy - add_rss, full_rss, n - 2 * k FROM s UNION ALL SELECT 1, 'site:lb', k - 1, add_rss - full_rss, full_rss, n - 2 * k FROM s
        UNION ALL SELECT 2, 'site', k - 1, lb_rss - add_rss, full_rss, n - 2 * k FROM s UNION ALL SELECT 2, 'lb', 1, wyy - add_rss, full_rss, n - 2 * k FROM s UNION ALL SELECT 2, 'site:lb', k - 1, add_rss - full_rss, full_rss, n - 2 * k FROM s
        UNION ALL SELECT 3, 'site', k - 1, ss3_site, full_rss, n - 2 * k FROM s UNION ALL SELECT 3, 'lb', 1, ss3_lb, full_rss, n - 2 * k FROM s UNION ALL SELECT 3, 'site:lb', k - 1, add_rss - full_rss, full_rss, n - 2 * k FROM s
    )
    SELECT CAST(kind AS INTEGER) AS kind, term, CAST(df AS BIGINT) AS df, round(ss, 5) AS ss, round(ss / df / (full_rss / left_df), 5) AS f, round(ss / (ss + full_rss), 6) AS eta2 FROM r
    UNION ALL SELECT kind, 'residual', CAST(max(left_df) AS BIGINT), round(max(full_rss), 5), NULL, NULL FROM r GROUP BY kind""")
def analysis_of_covariance(spark, d):
    """Q5, Q7, Q8: types I to III of log density on site, log biovolume and their interaction."""
    data = linear.cells(_logs(spark, d), ["site"], ["lb"], "ld")
    mains, crossed = linear.terms_of(data)
    rows = [(kind, e.term, e.df, round(e.ss, 5), *(None if math.isnan(v) else round(v, n) for v, n in ((e.f, 5), (e.eta2, 6)))) for kind in (1, 2, 3) for e in linear.anova(data, [*mains, *crossed], kind)]
    return spark.createDataFrame(rows, "kind int, term string, df long, ss double, f double, eta2 double")


@query()
def two_way_anova(spark, d):
    """Q6: two factors and their interaction, type II."""
    data = linear.cells(observations(spark, d), ["site", "phylum"], [], "density")
    rows = [(e.term, e.df, round(e.ss, 4), None if math.isnan(e.f) else round(e.f, 5), None if math.isnan(e.p) else round(e.p, 5)) for e in linear.anova(data, [("site",), ("phylum",), ("site", "phylum")], 2)]
    return spark.createDataFrame(rows, "term string, df int, ss double, f double, p double")


@query()
def chosen_terms(spark, d):
    """Q11, V4-V6, V8: interactions kept if any is significant, then terms left by p and by both criteria."""
    obs = linear.scaled(_logs(spark, d), ["lb", "tax"], "zscore")
    data = linear.cells(obs, ["site", "phylum"], ["lb", "tax"], "ld")
    mains, crossed = linear.terms_of(data, "fxf")
    model, found = linear.with_interactions_if_any(data, mains, crossed)
    rows = [("kept", t) for t in model] + [("by p", t) for t in linear.backward(data, model, found)]
    for by in ("aic", "bic"):
        rows += [(f"by {by}", t) for t in linear.backward_by_criterion(data, mains, crossed, by, 10.0)]
    return spark.createDataFrame([(rule, ":".join(t)) for rule, t in rows], "rule string, term string")


@query()
def forward_selection(spark, d):
    """Q12: of each step, the covariate of least p."""
    obs = observations(spark, d).withColumn("y", F.col("biovolume") + 500 * F.col("density"))
    data = linear.cells(obs.withColumn("size", F.col("size").cast("double")), [], ["discount", "tax", "size", "density"], "y")
    return spark.createDataFrame([(i + 1, c) for i, (c, _) in enumerate(linear.forward(data, ["discount", "tax", "size", "density"]))], "step int, variable string")


@query()
def variance_inflation(spark, d):
    """Q9."""
    obs = observations(spark, d).withColumn("mix", F.col("density") * 2 + F.col("tax"))
    got, left = statistics.vif(obs, ["density", "tax", "discount", "mix"]), statistics.vif_filter(obs, ["density", "tax", "discount", "mix"])
    return spark.createDataFrame([(c, min(v, 1e9), c in left) for c, v in got.items()], "variable string, vif double, kept boolean")


@query()
def stepwise_selection(spark, d):
    """Q10."""
    obs = observations(spark, d).withColumn("y", F.col("biovolume") + 500 * F.col("density"))
    names = ["discount", "tax", "size", "density"]
    return spark.createDataFrame([(how, c) for how in ("p", "aic", "bic") for c in statistics.selected(obs, names, "y", how)], "rule string, variable string")


@query(f"""WITH {OBS}, g AS (SELECT phylum, count(*) AS n, avg(density) AS m, var_pop(density) * count(*) AS ss FROM obs GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(ss) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g)
    SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS f, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2 FROM t""")
def one_way_anova(spark, d):
    """Q6."""
    return rounded(statistics.one_way(observations(spark, d), "phylum", "density").drop("p"), 5)


@query(f"""WITH {OBS}, m AS (SELECT site, median(biovolume) AS m FROM obs GROUP BY 1), v AS (SELECT obs.site, abs(biovolume - m) AS v FROM obs JOIN m ON obs.site = m.site),
    g AS (SELECT site, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM v GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(ss) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g)
    SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS f, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2 FROM t""")
def levene_test(spark, d):
    """Q18."""
    return rounded(statistics.levene(observations(spark, d), "site", "biovolume").drop("p"), 5)


@query(f"""WITH {OBS}, r AS (SELECT site, biovolume AS v, row_number() OVER (PARTITION BY site ORDER BY biovolume) AS k, count(*) OVER (PARTITION BY site) AS n FROM obs),
    c AS (SELECT site, avg(v) AS c FROM r WHERE k > floor(0.1 * n) AND k <= n - floor(0.1 * n) GROUP BY 1), v AS (SELECT r.site, abs(v - c) AS v FROM r JOIN c ON r.site = c.site),
    g AS (SELECT site, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM v GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(ss) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g)
    SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS f, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2 FROM t""")
def levene_trimmed(spark, d):
    """Q18, from means without a tenth at each end."""
    return rounded(statistics.levene(observations(spark, d), "site", "biovolume", trim=0.1).drop("p"), 5)


_RAISED = [("HC0", "e * e"), ("HC1", "e * e * n / (n - 3.0)"), ("HC2", "e * e / (1 - h)"), ("HC3", "(e / (1 - h)) ** 2")]


@query(f"""{_NORMAL}, u AS (
        SELECT a - k.ma AS a, b - k.mb AS b, y - my - ba * (a - k.ma) - bb * (b - k.mb) AS e, n, 1.0 / n + (sbb * (a - k.ma) ** 2 - 2 * sab * (a - k.ma) * (b - k.mb) + saa * (b - k.mb) ** 2) / (saa * sbb - sab * sab) AS h, saa, sbb, sab, ba, bb
        FROM v CROSS JOIN k CROSS JOIN (SELECT n FROM m)
    ), w AS ({" UNION ALL ".join(f"SELECT '{name}' AS kind, *, {weight} AS w FROM u" for name, weight in _RAISED)})
    SELECT kind, 'discount' AS term, round(max(ba), 4) AS coefficient, round(sqrt(sum(w * (sbb * a - sab * b) ** 2)) / max(saa * sbb - sab * sab), 5) AS se FROM w GROUP BY kind
    UNION ALL SELECT kind, 'tax', round(max(bb), 4), round(sqrt(sum(w * (saa * b - sab * a) ** 2)) / max(saa * sbb - sab * sab), 5) FROM w GROUP BY kind""")
def robust_errors(spark, d):
    """Q3: errors of both slopes by four rules."""
    terms, rows = {"(intercept)": F.lit(1), "discount": F.col("discount"), "tax": F.col("tax")}, []
    for kind, _ in _RAISED:
        rows += [(kind, t, round(b, 4), round(se, 5)) for t, b, se, *_ in statistics.least_squares(observations(spark, d), terms, "density", kind).table()[1:]]
    return spark.createDataFrame(rows, "kind string, term string, coefficient double, se double")


@query(f"""WITH {OBS}, r AS (SELECT corr(density, biovolume) AS ab, corr(density, size) AS ac, corr(biovolume, size) AS bc FROM obs), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
    SELECT 'density' AS variable, round((1 - bc * bc) / det, 6) AS vif FROM d UNION ALL SELECT 'biovolume', round((1 - ac * ac) / det, 6) FROM d UNION ALL SELECT 'size', round((1 - ab * ab) / det, 6) FROM d""")
def inflation_of_three(spark, d):
    """Q9, by the correlation matrix."""
    got = statistics.vif(observations(spark, d), ["density", "biovolume", "size"])
    return spark.createDataFrame([(c, round(v, 6)) for c, v in got.items()], "variable string, vif double")


@query(f"""WITH {OBS}, r AS (SELECT phylum, rank() OVER (ORDER BY density) + (count(*) OVER (PARTITION BY density) - 1) / 2.0 AS rk FROM obs), s AS (SELECT phylum, sum(rk) AS r, count(*) AS m FROM r GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs),
    c AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM obs GROUP BY density)) SELECT round((12 / (n * (n + 1)) * sum(CAST(r AS DOUBLE) * r / m) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, CAST(count(*) - 1 AS DOUBLE) AS df FROM s CROSS JOIN n CROSS JOIN c GROUP BY n, ties""")
def kruskal_wallis(spark, d):
    """Q19."""
    return rounded(statistics.kruskal(observations(spark, d), "phylum", "density").drop("p"), 4)


@query(f"""WITH {OBS}, m AS (SELECT phylum, count(*) AS n, avg(density) AS m, var_samp(density) / count(*) AS e FROM obs GROUP BY 1)
    SELECT a.phylum AS group1, b.phylum AS group2, round((a.m - b.m) / sqrt(a.e + b.e), 6) AS t, round((a.e + b.e) ** 2 / (a.e * a.e / (a.n - 1) + b.e * b.e / (b.n - 1)), 3) AS df FROM m a JOIN m b ON a.phylum < b.phylum""")
def welch_tests(spark, d):
    """Q20."""
    return statistics.welch_pairs(observations(spark, d), "phylum", "density").select("group1", "group2", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query(f"""WITH {OBS}, p AS (SELECT a.phylum AS group1, b.phylum AS group2 FROM (SELECT DISTINCT phylum FROM obs) a JOIN (SELECT DISTINCT phylum FROM obs) b ON a.phylum < b.phylum),
    r AS (SELECT group1, group2, phylum, rank() OVER (PARTITION BY group1, group2 ORDER BY density) + (count(*) OVER (PARTITION BY group1, group2, density) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY group1, group2, density) AS t FROM p JOIN obs ON phylum = group1 OR phylum = group2),
    s AS (SELECT group1, group2, CAST(count_if(phylum = group1) AS DOUBLE) AS n, CAST(count_if(phylum = group2) AS DOUBLE) AS m, sum(CASE WHEN phylum = group1 THEN rk END) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1, 2),
    u AS (SELECT *, CAST(r1 AS DOUBLE) - n * (n + 1) / 2 AS w FROM s)
    SELECT group1, group2, w, round((w - n * m / 2 - 0.5 * sign(w - n * m / 2)) / sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))), 5) AS z FROM u""")
def rank_sum_pairs(spark, d):
    """Q20: Wilcoxon's test of each two phyla."""
    return posthoc.rank_sum_pairs(observations(spark, d), "phylum", "density").select("group1", "group2", "w", F.round("z", 5).alias("z"))


_MONTHS = f"""{SERIES}, mo AS (SELECT kind, date_diff('month', DATE '1970-01-01', day) AS t, avg(value) AS v FROM series GROUP BY 1, 2)"""


def _weekly(spark, d):
    """(kind, week, v): mean of each seventh day's sums, few points a series."""
    week = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / 7)
    return series(spark, d).groupBy("kind", week.alias("week")).agg(F.avg("value").alias("v"))


_WEEKS = f"""{SERIES}, wk AS (SELECT kind, CAST(floor(date_diff('day', DATE '1970-01-01', day) / 7.0) AS BIGINT) AS week, avg(value) AS v FROM series GROUP BY 1, 2)"""


@query(f"""WITH {_WEEKS}, p AS (SELECT a.kind, sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.week - a.week)) AS slope FROM wk a JOIN wk b ON a.kind = b.kind AND a.week < b.week GROUP BY 1), n AS (SELECT kind, count(*) AS n FROM wk GROUP BY 1)
    SELECT p.kind, n, CAST(s AS DOUBLE) AS s, round(slope, 5) AS slope FROM p JOIN n ON p.kind = n.kind""")
def trend_tests(spark, d):
    """Q25, T21."""
    return statistics.kendall(_weekly(spark, d), ["kind"], "week", "v").select("kind", "n", F.col("s").cast("double").alias("s"), F.round("slope", 5).alias("slope"))


@query(f"""WITH {_WEEKS}, p AS (SELECT a.kind, sum(sign(b.v - a.v)) AS s, count(*) AS pairs, median((b.v - a.v) / (b.week - a.week)) AS slope FROM wk a JOIN wk b ON a.kind = b.kind AND a.week < b.week GROUP BY 1),
    t AS (SELECT kind, v, CAST(count(*) AS DOUBLE) AS t FROM wk GROUP BY 1, 2), u AS (SELECT kind, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties, sum(t * (t - 1) / 2) AS tied FROM t GROUP BY 1),
    w AS (SELECT p.kind, n, s, pairs, slope, tied, (n * (n - 1) * (2 * n + 5) - ties) / 18 AS variance FROM p JOIN u ON p.kind = u.kind)
    SELECT kind, CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS s, round(s / sqrt((pairs - tied) * pairs), 5) AS tau, round(variance, 5) AS variance, round((s - sign(s)) / sqrt(variance), 5) AS z, round(slope, 5) AS slope FROM w""")
def mann_kendall(spark, d):
    """Q25 with tau, variance and z."""
    return rounded(statistics.kendall(_weekly(spark, d), ["kind"], "week", "v"), 5)


@query(f"""WITH {SERIES}, e AS (SELECT kind, min(day) AS a, max(day) AS b FROM series GROUP BY 1), c AS (SELECT kind, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM e)
    SELECT c.kind, CAST(c.day AS VARCHAR) AS day, round(value, 5) AS value FROM c LEFT JOIN series s ON c.kind = s.kind AND c.day = s.day""")
def regular_series(spark, d):
    """W18, C19, D5."""
    return timeseries.regular(series(spark, d), ["kind"], "day", "value", "1 day").select("kind", F.col("day").cast("string").alias("day"), F.round("value", 5).alias("value"))


@query(f"""WITH {SERIES} SELECT kind, CAST(make_date(year(day), 1, 1) + CAST(((dayofyear(day) - 1) // 8) * 8 AS INTEGER) AS VARCHAR) AS bin, round(avg(value), 5) AS value, count(*) AS n FROM series GROUP BY 1, 2""")
def eight_day_means(spark, d):
    """Z1 in batch, W19, C19."""
    return timeseries.binned(series(spark, d), ["kind"], calendar.interval_start(F.col("day"), 8).cast("string"), "value").select("kind", "bin", F.round("value", 5).alias("value"), "n")


@query(f"""WITH {SERIES} SELECT kind, CAST(make_date(1970 + (((year(day) - 1970) * 12 + month(day) - 1) // 2) // 6, ((((year(day) - 1970) * 12 + month(day) - 1) // 2) % 6) * 2 + 1, 1) AS VARCHAR) AS bin, round(avg(value), 5) AS value, count(*) AS n FROM series GROUP BY 1, 2""")
def two_month_means(spark, d):
    """W19."""
    return timeseries.binned(series(spark, d), ["kind"], calendar.month_bin(F.col("day"), 2).cast("string"), "value").select("kind", "bin", F.round("value", 5).alias("value"), "n")


@query(f"""WITH {SERIES}, g AS (SELECT kind, date_diff('day', day, lead(day) OVER (PARTITION BY kind ORDER BY day)) AS step FROM series), c AS (SELECT kind, step, count(*) AS n FROM g WHERE step IS NOT NULL GROUP BY 1, 2)
    SELECT kind, CAST(min_by(step, (-n, step)) AS INTEGER) AS step FROM c GROUP BY 1""")
def usual_steps(spark, d):
    """W23."""
    return windows.usual_step(series(spark, d), ["kind"], "day")


@query(f"""WITH {SERIES}, h AS (SELECT kind, date_diff('day', DATE '1970-01-01', day) AS t, CASE WHEN n % 3 <> 0 THEN value END AS v FROM series),
    b AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS p1
    FROM h WINDOW w AS (PARTITION BY kind ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY kind ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT kind, t, round(coalesce(v, v0 + (v1 - v0) * CAST(t - p0 AS DOUBLE) / nullif(p1 - p0, 0), v0, v1), 5) AS v FROM b""")
def interpolated_series(spark, d):
    """W17."""
    holes = series(spark, d).select("kind", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("t"), F.when(F.col("n") % 3 != 0, F.col("value")).alias("v"))
    return windows.interpolated(holes, ["kind"], "t", "v").select("kind", "t", F.round("v", 5).alias("v"))


@query(f"""WITH {SERIES}, g AS (SELECT kind, day, value, value - lag(value) OVER (PARTITION BY kind ORDER BY day) AS s FROM series) SELECT kind, round(var_pop(s) / 2, 4) AS noise FROM g GROUP BY 1""")
def series_noise(spark, d):
    """W25."""
    return rounded(windows.difference_variance(series(spark, d), ["kind"], "day", "value"), 4)


@query(f"""WITH RECURSIVE {SERIES}, v AS (SELECT kind, list(value ORDER BY day) AS own, list(day ORDER BY day) AS days FROM series GROUP BY 1),
    walk(kind, k, fixed) AS (SELECT kind, 1, own[1] FROM v UNION ALL
        SELECT v.kind, k + 1, CASE WHEN own[k + 1] <= 1.5 * fixed THEN own[k + 1] ELSE (fixed + coalesce(list_filter(own[k + 2:], lambda x: x <= 1.5 * fixed)[1], fixed)) / 2 END FROM walk JOIN v ON walk.kind = v.kind WHERE k < len(own))
    SELECT walk.kind, CAST(days[k] AS VARCHAR) AS day, round(own[k], 8) AS value, round(fixed, 8) AS corrected FROM walk JOIN v ON walk.kind = v.kind""")
def corrected_series(spark, d):
    """A walk along each series."""
    got = timeseries.corrected(series(spark, d), ["kind"], "day", "value", "corrected")
    return rounded(got.select("kind", F.col("day").cast("string").alias("day"), "value", "corrected"), 8)


@query()
def smoothed_series(spark, d):
    """T3, W26."""
    return timeseries.smoothed(series(spark, d), ["kind"], "day", "value", "smooth")


@query(f"""WITH {SERIES}, k AS (SELECT kind, day, value, lead(day) OVER w AS after, lead(value) OVER w AS v1 FROM series WHERE n % 4 != 0 WINDOW w AS (PARTITION BY kind ORDER BY day)), e AS (SELECT * FROM k WHERE after - day > 1)
    SELECT kind, CAST(CAST(unnest(generate_series(day + 1, after - 1, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day, round((value + v1) / 2, 5) AS value FROM e""")
def series_gaps(spark, d):
    """Missing days, each with the mean of the rows around."""
    got = timeseries.gaps(series(spark, d).where("n % 4 != 0"), ["kind"], "day", "value", 1)
    return rounded(got.select("kind", F.col("day").cast("string").alias("day"), "value"), 5)


def _two(spark, d):
    """Two daily series of equal length, by index."""
    both = series(spark, d).groupBy("day").agg(F.sum(F.when(F.col("kind") == "click", F.col("value")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("kind") != "click", F.col("value")).otherwise(0.0)).alias("b"))
    return both.withColumn("i", F.datediff("day", F.lit("2000-01-01").cast("date")).cast("long"))


@query(f"""WITH {SERIES}, v AS (SELECT date_diff('day', DATE '2000-01-01', day) AS i, sum(CASE WHEN kind = 'click' THEN value ELSE 0 END) AS a, sum(CASE WHEN kind <> 'click' THEN value ELSE 0 END) AS b FROM series GROUP BY 1), m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) AS n FROM v),
    l AS (SELECT unnest(generate_series(-5, 5)) AS lag) SELECT CAST(lag AS INTEGER) AS lag, round(sum((x.a - ma) * (y.b - mb)) / (max(sa) * max(sb) * max(n)), 5) AS cc FROM v x CROSS JOIN l JOIN v y ON y.i = x.i - lag CROSS JOIN m GROUP BY 1""")
def cross_correlation(spark, d):
    """T5."""
    both = _two(spark, d)
    return rounded(timeseries.cross_correlation(both.select("i", F.col("a").alias("v")), both.select("i", F.col("b").alias("v")), "i", "v", 5), 5)


@query(f"""WITH {SERIES}, c AS (SELECT kind, day, value - avg(value) OVER (PARTITION BY kind) AS v FROM series), l AS (SELECT kind, v, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2 FROM c WINDOW w AS (PARTITION BY kind ORDER BY day)),
    s AS (SELECT kind, count(*) AS n, sum(v * l1) / sum(v * v) AS r1, sum(v * l2) / sum(v * v) AS r2 FROM l GROUP BY 1) SELECT kind, 1 AS lag, round(r1, 5) AS r, round(n * (n + 2.0) * (r1 * r1 / (n - 1)), 4) AS q FROM s UNION ALL SELECT kind, 2, round(r2, 5), round(n * (n + 2.0) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 4) FROM s""")
def ljung_box(spark, d):
    """T9."""
    return timeseries.autocorrelations(series(spark, d), ["kind"], "day", "value", 2).select("kind", "lag", F.round("r", 5).alias("r"), F.round("q", 4).alias("q"))


@query(f"""WITH {SERIES}, r AS (SELECT kind, row_number() OVER w - 1 AS i, [value, lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w, lead(value, 4) OVER w] AS v FROM series WINDOW w AS (PARTITION BY kind ORDER BY day)),
    k AS (SELECT * FROM r WHERE v[5] IS NOT NULL), p AS (SELECT a.kind, a.i, b.i AS j, list_distance(a.v, b.v) AS d FROM k a JOIN k b ON a.kind = b.kind AND a.i < b.i), q AS (SELECT kind, quantile_cont(d, 0.1) AS radius FROM p GROUP BY 1)
    SELECT p.kind, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(d, 5) AS d, d <= radius AS recurrent FROM p JOIN q ON p.kind = q.kind""")
def recurrence_matrix(spark, d):
    """T4, C21, C22."""
    return rounded(timeseries.recurrences(series(spark, d), ["kind"], "day", "value"), 5)


@query(f"""WITH {SERIES}, r AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM series), p AS (SELECT kind, k % 7 AS place, avg(value) AS f FROM r GROUP BY 1, 2), e AS (SELECT DISTINCT kind, n FROM r)
    SELECT e.kind, CAST(step AS INTEGER) AS step, round(f, 5) AS forecast FROM e CROSS JOIN generate_series(1, 14) g(step) JOIN p ON p.kind = e.kind AND p.place = (n - 1 + step) % 7""")
def seasonal_forecasts(spark, d):
    """T10."""
    return rounded(timeseries.seasonal_forecast(series(spark, d), ["kind"], "day", "value", 7, 14), 5)


@query(f"""WITH {SERIES}, r AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY day) AS k, count(*) OVER (PARTITION BY kind) AS n FROM series) SELECT kind, k <= floor(n * 0.8) AS train, count(*) AS n FROM r GROUP BY 1, 2""")
def split_by_time(spark, d):
    """T11."""
    return timeseries.split_by_time(series(spark, d), ["kind"], "day").groupBy("kind", "train").agg(F.count("*").alias("n"))


@query(f"""WITH {PIXELS} SELECT product, date, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS sd, round(min(value), 3) AS min, round(max(value), 3) AS max, count(value) AS n FROM pixels GROUP BY 1, 2""")
def zonal_statistics(spark, d):
    """B9, A11, V12."""
    return rounded(raster.zonal(pixels(spark, d), ["product", "date"]), 3)


@query(f"""WITH {PIXELS}, w AS (SELECT date, row, col, max(CASE WHEN product = 'A' THEN value END) AS a, max(CASE WHEN product = 'N' THEN value END) AS n FROM pixels GROUP BY 1, 2, 3) SELECT date, row, col, round((a - n) / nullif(a + n, 0), 6) AS value FROM w WHERE (a - n) / nullif(a + n, 0) IS NOT NULL""")
def band_algebra(spark, d):
    """B1: a formula over products, one grouped pass."""
    return rounded(raster.bands_of_one(pixels(spark, d), ["A", "N"], ["date", "row", "col"], "(A - N) / (A + N)"))


@query(f"""WITH {PIXELS} SELECT product, date, row // 2 AS row, col // 2 AS col, round(avg(value), 7) AS value FROM pixels GROUP BY 1, 2, 3, 4""")
def upscaled_raster(spark, d):
    """Block means."""
    return rounded(raster.upscaled(pixels(spark, d), ["product", "date"]), 7)


@query(f"""WITH {PIXELS} SELECT product, date, row, col, round(CASE WHEN product = 'A' THEN CASE WHEN value BETWEEN 10000 AND 60000 THEN value * 0.1 END WHEN product = 'N' THEN CASE WHEN value BETWEEN 0 AND 50000 THEN value * 2 END ELSE value END, 7) AS value FROM pixels""")
def scaled_raster(spark, d):
    """B4, B5."""
    products = spark.createDataFrame([("A", 10000.0, 60000.0, 0.1), ("N", 0.0, 50000.0, 2.0)], "product string, lo double, hi double, scale double")
    return rounded(raster.scaled(pixels(spark, d), products), 7)


@query(f"""WITH {PIXELS}, y AS (SELECT DISTINCT date FROM pixels), p AS (SELECT * FROM pixels WHERE date % 2 = 1), g AS (SELECT DISTINCT product, row, col FROM p),
    t AS (SELECT g.product, g.row, g.col, y.date, value, last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER a AS v1 FROM g CROSS JOIN y LEFT JOIN p ON p.product = g.product AND p.row = g.row AND p.col = g.col AND p.date = y.date
    WINDOW b AS (PARTITION BY g.product, g.row, g.col ORDER BY y.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY g.product, g.row, g.col ORDER BY y.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT product, row, col, date, round(coalesce(value, (v0 + v1) / 2, v0, v1), 7) AS value FROM t""")
def filled_rasters(spark, d):
    """B7, B8."""
    px = pixels(spark, d)
    return rounded(raster.filled_dates(px.where("date % 2 = 1"), px.select("date"), ["product", "row", "col"]), 7)


@query(f"""WITH {PIXELS} SELECT product, date, row, col, round(value, 7) AS value FROM pixels WHERE col + 0.5 < 40 AND row + 0.5 < 3 AND (col + 0.5) >= (row + 0.5)""")
def clipped_raster(spark, d):
    """Pixels whose centre lies in a polygon."""
    ring = [(0.0, 0.0), (40.0, 0.0), (40.0, 3.0), (3.0, 3.0)]
    px = pixels(spark, d).withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5})
    return rounded(raster.clipped(px, "x", "y", ring).drop("x", "y"), 7)


@query(f"""WITH {PIXELS}, w AS (SELECT date, row, col, max(CASE WHEN product = 'A' THEN value END) AS a, max(CASE WHEN product = 'N' THEN value END) AS n, max(CASE WHEN product = 'R' THEN value END) AS r FROM pixels GROUP BY 1, 2, 3)
    SELECT 'A' AS a, 'N' AS b, round(corr(a, n), 5) AS r, count(a + n) AS n FROM w UNION ALL SELECT 'A', 'R', round(corr(a, r), 5), count(a + r) FROM w""")
def pixel_correlation(spark, d):
    """Q23, J16."""
    return rounded(raster.pixel_correlation(pixels(spark, d), ["date", "row", "col"], [("A", "N"), ("A", "R")]), 5)


@query(f"""WITH {PIXELS}, pt AS (SELECT c_custkey AS id, CAST(floor((90 - (c_acctbal / 200 + 30)) / 20) AS BIGINT) AS row, CAST(floor((c_custkey % 50) / 1.0) AS BIGINT) AS col FROM customer)
    SELECT id, round(avg(CASE WHEN product = 'A' THEN value END), 7) AS A_mean, round(max(CASE WHEN product = 'A' THEN value END), 7) AS A_max, round(min(CASE WHEN product = 'A' THEN value END), 7) AS A_min, round(stddev_pop(CASE WHEN product = 'A' THEN value END), 7) AS A_std FROM pt JOIN pixels p ON p.row = pt.row AND p.col = pt.col GROUP BY 1""")
def point_statistics(spark, d):
    """B10, B13, A12, J15."""
    row, col = raster.grid_cell(F.col("c_acctbal") / 200 + 30, (F.col("c_custkey") % 50).cast("double"), 90.0, 0.0, 20.0)
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), row.alias("row"), F.floor(F.col("c_custkey") % 50).cast("long").alias("col"))
    return rounded(raster.point_statistics(points, pixels(spark, d), ["row", "col"], ["id"], ["A"]), 7)


def _aeqd(lat: str, lon: str) -> str:
    """SQL for a place in the plane of true distances from (p.lat, p.lon), as a list of x and y in km."""
    half = f"sin(radians({lat} - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians({lat})) * sin(radians({lon} - p.lon) / 2) ** 2"
    k = f"6371.0088 * list_transform([2 * asin(sqrt(least({half}, 1.0)))], lambda c: CASE WHEN sin(c) > 1e-15 THEN c / sin(c) ELSE 1 END)[1]"
    x, y = f"cos(radians({lat})) * sin(radians({lon} - p.lon))", f"cos(radians(p.lat)) * sin(radians({lat})) - sin(radians(p.lat)) * cos(radians({lat})) * cos(radians({lon} - p.lon))"
    return f"[{k} * ({x}), {k} * ({y})]"


@query(f"""WITH p AS (SELECT c_custkey, c_acctbal / 150 AS lat, CAST((c_custkey * 37) % 360 AS DOUBLE) - 180 AS lon FROM customer), s AS (SELECT s_acctbal / 200 AS lat1, CAST((s_suppkey * 53) % 360 AS DOUBLE) - 180 AS lon1 FROM supplier),
    e AS (SELECT c_custkey, {_aeqd("s.lat1", "s.lon1")} AS a, {_aeqd("(s.lat1 + 0.3)", "(s.lon1 + 0.4)")} AS b FROM p CROSS JOIN s),
    d AS (SELECT c_custkey, a, [b[1] - a[1], b[2] - a[2]] AS v FROM e), t AS (SELECT *, greatest(0.0, least(1.0, -(a[1] * v[1] + a[2] * v[2]) / (v[1] ** 2 + v[2] ** 2))) AS t FROM d)
    SELECT c_custkey, round(min(sqrt((a[1] + t * v[1]) ** 2 + (a[2] + t * v[2]) ** 2)), 3) AS distance_km FROM t GROUP BY 1""")
def nearest_coast(spark, d):
    """To the nearest segment, all around the globe."""
    points = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 150).alias("lat"), ((F.col("c_custkey") * 37) % 360 - 180).cast("double").alias("lon"))
    coast = table(spark, d, "supplier").select((F.col("s_acctbal") / 200).alias("lat1"), ((F.col("s_suppkey") * 53) % 360 - 180).cast("double").alias("lon1"))
    coast = coast.withColumns({"lat2": F.col("lat1") + 0.3, "lon2": F.col("lon1") + 0.4})
    return rounded(geometry.nearest_segment(points, ["c_custkey"], "lat", "lon", coast).select("c_custkey", "distance_km"), 3)


_SHAPES = [[[(0.0, 0.0), (40.0, 0.0), (40.0, 60.0), (0.0, 60.0)], [(10.0, 1.0), (30.0, 1.0), (30.0, 50.0), (10.0, 50.0)]], [[(42.0, 0.0), (49.0, 0.0), (49.0, 30.0)]]]


@query(f"""WITH {PIXELS} SELECT product, date, row, col, round(value, 7) AS value FROM pixels
    WHERE (col + 0.5 < 40 AND row + 0.5 < 60 AND NOT (col + 0.5 >= 10 AND col + 0.5 < 30 AND row + 0.5 >= 1 AND row + 0.5 < 50)) OR (col + 0.5 < 49 AND row + 0.5 < 30 AND col + 0.5 >= 42 + (row + 0.5) * 7 / 30)""")
def clipped_by_parts(spark, d):
    """A polygon with a hole and a second part, as a table of edges."""
    shape = spark.createDataFrame([(1, _SHAPES)], "shape int, parts array<array<array<struct<x: double, y: double>>>>")
    return rounded(geometry.clipped_by(pixels(spark, d), ["row", "col"], F.col("col") + 0.5, F.col("row") + 0.5, geometry.edges(shape, ["shape"], "parts"), 10.0), 7)


@query(f"""WITH {PIXELS}, u AS (SELECT product, date, row // 2 AS row, col // 2 AS col, avg(value) AS value FROM pixels GROUP BY 1, 2, 3, 4),
    g AS (SELECT r AS row, c AS col, (r + 0.5) * 1.5 - 0.5 + 0.2 AS y, (c + 0.5) * 1.5 - 0.5 - 0.1 AS x FROM generate_series(0, 9) a(r) CROSS JOIN generate_series(0, 14) b(c)),
    n AS (SELECT row, col, floor(y) + i AS sr, floor(x) + j AS sc, abs(1 - i - (y - floor(y))) * abs(1 - j - (x - floor(x))) AS w FROM g CROSS JOIN generate_series(0, 1) k(i) CROSS JOIN generate_series(0, 1) l(j))
    SELECT product, date, n.row, n.col, round(sum(w * value) / sum(w), 6) AS value FROM n JOIN u ON u.row = sr AND u.col = sc WHERE w > 0 GROUP BY 1, 2, 3, 4""")
def reprojected_raster(spark, d):
    """Means of two by two pixels, then a coarser grid that lies askew, from four neighbours."""
    up = raster.upscaled(pixels(spark, d), ["product", "date"])
    return rounded(geometry.bilinear(up, ["product", "date"], (0.0, 0.0, 1.0), (-0.2, -0.1, 1.5), (10, 15)))


@query(f"""WITH {OBS}, t AS (SELECT site, taxon, sum(density) AS v FROM obs GROUP BY 1, 2) SELECT a.site, a.taxon AS i, b.taxon AS j FROM t a JOIN t b ON a.site = b.site AND a.taxon < b.taxon WHERE a.v > b.v""")
def ordered_pairs(spark, d):
    """J13, J17."""
    t = observations(spark, d).groupBy("site", "taxon").agg(F.sum("density").alias("v"))
    a, b = tables.renamed(t, {"taxon": "i", "v": "vi"}), tables.renamed(t, {"taxon": "j", "v": "vj"})
    return a.join(b, "site").where("i < j and vi > vj").select("site", "i", "j")
