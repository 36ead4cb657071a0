"""Plans of choices: metrics and transforms by name, penalties, grids of settings, columns and files that match."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.lineage import written
from tidewrack.operators import dissimilarity, diversity, filters, learning, niche, ordination, posthoc, statistics, tables, windows
from tidewrack.plans.base import OBS, observations, query, rounded, table

_METRICS = ("braycurtis", "manhattan", "canberra", "jaccard", "sorensen", "cosine", "euclidean")
_BY_METRIC = {
    "braycurtis": "sum(abs(xi - xj)) / sum(xi + xj)", "manhattan": "sum(abs(xi - xj))", "canberra": "sum(abs(xi - xj) / (xi + xj))", "jaccard": "1 - count_if(xi > 0 AND xj > 0) / count(*)",
    "sorensen": "1 - 2 * count_if(xi > 0 AND xj > 0) / (count_if(xi > 0) + count_if(xj > 0))", "cosine": "1 - sum(xi * xj) / sqrt(sum(xi * xi) * sum(xj * xj))", "euclidean": "sqrt(sum((xi - xj) ** 2))",
}


@query(f"""WITH {OBS}, s AS (SELECT site || CAST(year AS VARCHAR) || CAST(month AS VARCHAR) AS sample, taxon, sum(density) AS x FROM obs GROUP BY 1, 2), p AS (SELECT DISTINCT a.sample AS i, b.sample AS j FROM s a JOIN s b ON a.sample < b.sample),
    u AS (SELECT i, j, taxon FROM p JOIN s ON sample = i UNION SELECT i, j, taxon FROM p JOIN s ON sample = j), f AS (SELECT u.*, coalesce(a.x, 0) AS xi, coalesce(b.x, 0) AS xj FROM u LEFT JOIN s a ON a.sample = i AND a.taxon = u.taxon LEFT JOIN s b ON b.sample = j AND b.taxon = u.taxon),
    d AS (SELECT i, j, {", ".join(f"{f} AS {m}" for m, f in _BY_METRIC.items())} FROM f GROUP BY 1, 2)
    {" UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n, round(avg({m}), 6) AS mean, round(max({m}), 6) AS largest FROM d" for m in _METRICS)}""")
def metrics_by_name(spark, d):
    """M1: seven metrics between months of sites."""
    months = observations(spark, d).withColumn("sample", F.concat("site", F.col("year").cast("string"), F.col("month").cast("string")))
    community, told = diversity.community(months, ["sample"], "taxon", "density"), None
    for metric in _METRICS:
        got = dissimilarity.by_name(community, "sample", "taxon", "x", metric).agg(F.lit(metric).alias("metric"), F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("largest"))
        told = got if told is None else told.unionByName(got)
    return told


@query(f"""WITH {OBS}, l AS (SELECT phylum, biovolume AS x, ln(biovolume) AS lx, ln(density) AS ly FROM obs WHERE biovolume > 0 AND density > 0), f AS (SELECT phylum, regr_slope(ly, lx) AS b, regr_intercept(ly, lx) AS a, avg(lx) AS m, regr_sxx(ly, lx) AS sxx, count(*) AS n,
    (1 - regr_r2(ly, lx)) * regr_syy(ly, lx) / (count(*) - 2) AS v, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1), g AS (SELECT *, lo + (hi - lo) * k / 10 AS x FROM f CROSS JOIN generate_series(0, 10) s(k))
    SELECT phylum, round(x, 4) AS x, round(exp(a + b * ln(x)), 5) AS fit, round(sqrt(v * (1.0 / n + (ln(x) - m) ** 2 / sxx)), 6) AS se FROM g""")
def size_density_band(spark, d):
    """Q2, V3: the fitted curve with the error of its mean."""
    got = statistics.power_band(observations(spark, d), ["phylum"], "biovolume", "density", 11)
    return got.select("phylum", F.round("x", 4).alias("x"), F.round("fit", 5).alias("fit"), F.round("se", 6).alias("se"))


@query(f"""WITH {OBS}, z AS (SELECT density AS y, (discount - avg(discount) OVER ()) / stddev_pop(discount) OVER () AS a, (tax - avg(tax) OVER ()) / stddev_pop(tax) OVER () AS b FROM obs), s AS (SELECT sum(a * a) + 10 AS aa, sum(b * b) + 10 AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb FROM z)
    SELECT 'discount' AS variable, round((ay * bb - yb * ab) / (aa * bb - ab * ab), 6) AS coefficient FROM s UNION ALL SELECT 'tax', round((yb * aa - ay * ab) / (aa * bb - ab * ab), 6) FROM s""")
def ridge_coefficients(spark, d):
    """Q28: of scaled columns."""
    got = statistics.penalised(observations(spark, d), ["discount", "tax"], "density", 10.0)
    return spark.createDataFrame([(c, round(b, 6)) for c, b in got.items()], "variable string, coefficient double")


@query(f"""WITH {OBS}, s AS (SELECT regr_sxx(density, discount) AS xx, regr_sxy(density, discount) AS xy, count(*) AS n FROM obs), z AS (SELECT xy / sqrt(xx / n) AS v, n FROM s)
    SELECT 'discount' AS variable, round(sign(v) * greatest(0, abs(v) - n * 0.001) / n, 7) AS coefficient FROM z""")
def lasso_coefficient(spark, d):
    """Q28: of one scaled column, where it has a closed form."""
    got = statistics.penalised(observations(spark, d), ["discount"], "density", 0.001, "lasso")
    return spark.createDataFrame([(c, round(b, 7)) for c, b in got.items()], "variable string, coefficient double")


@query()
def most_normal_transform(spark, d):
    """Candidates by the p of Shapiro and Wilk's test, then by skewness."""
    means = observations(spark, d).groupBy("sample", "taxon").agg(F.avg("biovolume").alias("v"))
    return rounded(posthoc.most_normal(means, "v", ["sample", "taxon"]), 5)


@query(f"""WITH {OBS}, q AS (SELECT site, quantile_cont(biovolume, 0.25) AS q1, median(biovolume) AS m, quantile_cont(biovolume, 0.75) AS q3 FROM obs GROUP BY 1)
    SELECT obs.site, count(*) AS n, round(avg((biovolume - m) / (q3 - q1)), 6) AS mean, round(stddev_pop((biovolume - m) / (q3 - q1)), 6) AS sd FROM obs JOIN q ON obs.site = q.site GROUP BY 1""")
def robust_scaling(spark, d):
    """Medians to zero, interquartile ranges to one; mean and deviation of the scaled values."""
    told = windows.robust_scaled(observations(spark, d).select("site", "biovolume"), ["site"], "biovolume", "scaled")
    return told.groupBy("site").agg(F.count("*").alias("n"), F.round(F.avg("scaled"), 6).alias("mean"), F.round(F.stddev_pop("scaled"), 6).alias("sd"))


@query("""SELECT 'p_brand' AS "column", round(avg(CASE WHEN try_cast(trim(p_brand) AS DOUBLE) IS NULL THEN 0 ELSE 1 END), 6) AS share FROM part UNION ALL SELECT 'p_size', 1.0 FROM part WHERE p_partkey = 1
    UNION ALL SELECT 'mixed', round(avg(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END), 6) FROM part""")
def convertible_columns(spark, d):
    """Shares of values that are numbers."""
    part = table(spark, d, "part").select("p_brand", "p_size", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("mixed"))
    return rounded(filters.convertible_shares(part))


@query("""WITH f AS (SELECT DISTINCT 'NPP_' || strftime(o_orderdate, '%Y-%m') || '.tif' AS file FROM orders), q AS (SELECT DISTINCT l_returnflag || '_qc_' || strftime(l_shipdate, '%Y-%m') || '_x.tif' AS qc FROM lineitem)
    SELECT file, min(qc) AS qc FROM f LEFT JOIN q ON contains(qc, regexp_extract(file, '_(\\d{4}-\\d{2})', 1)) AND contains(qc, 'N_qc') GROUP BY 1""")
def matched_files(spark, d):
    """Of each raster the quality file of its month."""
    files = table(spark, d, "orders").select(F.concat(F.lit("NPP_"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".tif")).alias("file")).distinct()
    quality = table(spark, d, "lineitem").select(F.concat("l_returnflag", F.lit("_qc_"), F.date_format("l_shipdate", "yyyy-MM"), F.lit("_x.tif")).alias("qc")).distinct()
    return tables.matched_by_part(files, "file", quality, "qc", r"_(\d{4}-\d{2})", "N_qc")


@query(f"""WITH {OBS}, k AS (SELECT site, CASE WHEN size % 7 = 0 THEN NULL WHEN size % 5 = 0 THEN -1e12 ELSE size END AS depth FROM obs) SELECT site, count(*) AS n FROM k WHERE depth >= -999999999 GROUP BY 1""")
def known_depths(spark, d):
    """rows with a depth, sentinels far below left out."""
    depth = F.when(F.col("size") % 7 == 0, None).when(F.col("size") % 5 == 0, -1e12).otherwise(F.col("size").cast("double"))
    return observations(spark, d).withColumn("depth", depth).where(filters.known_depth("depth")).groupBy("site").agg(F.count("*").alias("n"))


@query(f"""WITH {OBS}, c AS (SELECT taxon, CAST(CAST(floor(avg(size) / 2) AS BIGINT) AS VARCHAR) AS size_class, avg(biovolume) AS optimum, stddev_samp(biovolume) AS tolerance, ln(sum(density) + 1) AS log_density FROM obs GROUP BY 1), k AS (SELECT size_class FROM c WHERE tolerance > 0 GROUP BY 1 HAVING count(*) >= 3)
    SELECT taxon, size_class, round(optimum - tolerance / 2, 4) AS xmin, round(optimum + tolerance / 2, 4) AS xmax, round(log_density, 6) AS log_density FROM c WHERE tolerance > 0 AND size_class IN (SELECT size_class FROM k)""")
def taxa_in_classes(spark, d):
    """Intervals and log densities of taxa in classes of three or more."""
    obs = observations(spark, d)
    curves = obs.groupBy("taxon").agg(F.floor(F.avg("size") / 2).cast("long").alias("size_class"), F.avg("biovolume").alias("optimum"), F.stddev_samp("biovolume").alias("tolerance"))
    got = niche.taxa_in_classes(curves, obs, "taxon", "size_class", "density")
    return got.select("taxon", "size_class", F.round("xmin", 4).alias("xmin"), F.round("xmax", 4).alias("xmax"), F.round("log_density", 6).alias("log_density"))


@query()
def correspondence_scores(spark, d):
    """Scores of samples and taxa, loadings and the axes' inertia."""
    obs = observations(spark, d)
    env = obs.groupBy("sample").agg(F.avg("discount").alias("e1"), F.avg("tax").alias("e2"))
    sites, taxa, inertia, loadings = ordination.correspondence_scores(obs, env, "sample", "taxon", "density", ["e1", "e2"])
    fixed = [("axis", f"cca{i + 1}", v, None) for i, v in enumerate(inertia)] + [("environment", v, a, b) for v, a, b in loadings]
    rows = sites.select(F.lit("site").alias("kind"), F.col("sample").alias("name"), "cca1", "cca2").unionByName(taxa.select(F.lit("taxon").alias("kind"), F.col("taxon").alias("name"), "cca1", "cca2"))
    return rounded(rows.unionByName(spark.createDataFrame(fixed, "kind string, name string, cca1 double, cca2 double")), 5)


@query()
def grid_of_settings(spark, d):
    """Settings of a forest and of a penalised line by cross validation."""
    x = ["density", "discount", "tax", "size"]
    data = written(learning.folds(observations(spark, d), ["ord", "line"], 3).select("fold", "ord", "line", "biovolume", *x))
    rows = []
    for name, model, grid in (("forest", learning.forest("biovolume", 5, 3), {"maxDepth": [2, 4], "featureSubsetStrategy": ["onethird", "all"]}), ("penalised", learning.linear("biovolume"), {"regParam": [0.0, 100.0], "elasticNetParam": [0.0, 1.0]})):
        _, told = learning.grid_search(data, x, model, grid, "biovolume", 3, ids=["ord", "line"])
        rows += [(name, ", ".join(f"{k}={v}" for k, v in sorted(setting.items())), round(score, 2)) for setting, score in told]
    return spark.createDataFrame(rows, "model string, setting string, rmse double")


@query()
def forest_importances(spark, d):
    """L3: how much each variable's splits lower a forest's variance."""
    x = ["density", "discount", "tax", "size"]
    model = learning.fit(observations(spark, d), x, learning.forest("biovolume", 5, 4))
    return spark.createDataFrame([(c, round(v, 5)) for c, v in learning.forest_importance(model, x)], "variable string, importance double")
