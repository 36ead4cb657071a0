"""Ordination, clustering and size-class plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewrack.operators import classes, dissimilarity, diversity, ordination
from tidewrack.plans.base import OBS, observations, query, rounded, table


@query(f"""WITH {OBS}, t AS (SELECT site, taxon, ln(avg(biovolume)) / ln(2) AS l, sum(density) AS w FROM obs GROUP BY 1, 2), e AS (SELECT floor(min(l)) AS edge FROM t), c AS (SELECT site, CAST(least(greatest(floor(l - edge) + 1, 1), 16) AS INTEGER) AS size_class, sum(w) AS total FROM t CROSS JOIN e GROUP BY 1, 2),
    g AS (SELECT s.site, CAST(k AS INTEGER) AS size_class FROM (SELECT DISTINCT site FROM t) s CROSS JOIN (SELECT unnest(generate_series(1, 16)) AS k))
    SELECT g.site, g.size_class, CASE WHEN g.size_class <= 2 THEN 1 WHEN g.size_class <= 5 THEN 2 WHEN g.size_class <= 8 THEN 3 WHEN g.size_class <= 11 THEN 4 WHEN g.size_class <= 14 THEN 5 ELSE 6 END AS super_group, round(coalesce(total, 0), 4) AS total FROM g LEFT JOIN c ON g.site = c.site AND g.size_class = c.size_class""")
def fixed_size_classes(spark, d):
    """V1."""
    return rounded(classes.size_classes(observations(spark, d), ["site"], "taxon", "biovolume", "density"), 4)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 1 AND p_size % 3 = 1 THEN 'Solitary/Colonial' WHEN p_size % 2 = 1 THEN 'Colonial' WHEN p_size % 5 = 1 THEN 'Non-colonial' WHEN p_size % 3 = 1 THEN 'Solitary/Colonial' ELSE 'Unknown' END AS form FROM part""")
def life_forms(spark, d):
    """P34."""
    flag = lambda k: F.when(F.col("p_size") % k == 1, 1).otherwise(0)
    return table(spark, d, "part").select("p_partkey", classes.life_form(flag(5), flag(2), flag(3)).alias("form"))


@query("""SELECT 'p_brand:' || p_brand AS source, 'p_type:' || p_type AS target, count(*) AS freq FROM part GROUP BY 1, 2""")
def flow_edges(spark, d):
    """D14."""
    return classes.flow(table(spark, d, "part"), ["p_brand", "p_type"])


@query()
def hierarchical_clusters(spark, d):
    """M7."""
    logs = diversity.community(observations(spark, d), ["sample"], "taxon", "density").withColumn("x", F.log10(F.col("x") + 1))
    return rounded(ordination.linkage(dissimilarity.bray_curtis(logs, "sample", "taxon", "x"), "average"))


@query()
def nonmetric_scaling(spark, d):
    """M8, M9: centroids of sites in a plane."""
    logs = diversity.community(observations(spark, d), ["sample"], "taxon", "density").withColumn("x", F.log10(F.col("x") + 1))
    points, stress = ordination.nonmetric_scaling(dissimilarity.bray_curtis(logs, "sample", "taxon", "x"))
    centres = points.groupBy(F.substring("site", 1, 3).alias("group")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rounded(centres.withColumn("stress", F.lit(stress)), 4)


@query()
def redundancy_analysis(spark, d):
    """Monthly sums of phyla on the environment, year held."""
    names = [r[0] for r in table(spark, d, "part").select("p_type").distinct().orderBy("p_type").collect()]
    wide = observations(spark, d).groupBy("site", "year", "month").agg(*(F.sum(F.when(F.col("phylum") == n, F.col("density")).otherwise(0.0)).alias(f"y{i}") for i, n in enumerate(names)), F.avg("discount").alias("e1"), F.avg("tax").alias("e2"))
    got = ordination.redundancy_analysis(wide.withColumn("t", F.col("year").cast("double")), [f"y{i}" for i in range(len(names))], ["e1", "e2"], ["t"])
    return spark.createDataFrame([(k, i, float(v)) for k, vs in got.items() for i, v in enumerate(vs if isinstance(vs, list) else [vs])], "name string, nth int, value double")


def _stations(spark, d):
    """Monthly sums of the first two phyla and means of the environment by site, and the time."""
    names = [r[0] for r in table(spark, d, "part").select("p_type").distinct().orderBy("p_type").limit(2).collect()]
    wide = observations(spark, d).groupBy("site", "year", "month").agg(*(F.sum(F.when(F.col("phylum") == n, F.col("density")).otherwise(0.0)).alias(f"y{i}") for i, n in enumerate(names)), F.avg("discount").alias("e1"), F.avg("tax").alias("e2"))
    return wide.withColumn("t", F.col("year").cast("double"))


@query()
def redundancy_permutations(spark, d):
    """Global test, axes and terms, year held."""
    rows = _stations(spark, d)
    fit = ordination.redundancy(rows, ["y0", "y1"], ["e1", "e2"], ["t"])
    told = ordination.redundancy_permutations(rows, fit, ["site", "year", "month"])
    return spark.createDataFrame([(k, i + 1, round(v, 6), round(p, 6)) for k, own in told.items() for i, (v, p) in enumerate(own)], "test string, nth int, value double, p double")


@query(f"""WITH {OBS}, names AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS k FROM (SELECT DISTINCT p_type FROM part)),
    m AS (SELECT site, year, month, sum(CASE WHEN k = 1 THEN density ELSE 0 END) AS y0, avg(discount) AS e1, avg(tax) AS e2 FROM obs JOIN names ON phylum = p_type GROUP BY 1, 2, 3),
    r AS (SELECT *, rank() OVER (ORDER BY y0) + (count(*) OVER (PARTITION BY y0) - 1) / 2.0 AS ry, rank() OVER (ORDER BY e1) + (count(*) OVER (PARTITION BY e1) - 1) / 2.0 AS r1, rank() OVER (ORDER BY e2) + (count(*) OVER (PARTITION BY e2) - 1) / 2.0 AS r2 FROM m)
    SELECT 'pearson' AS method, 'e1' AS variable, round(corr(e1, y0), 5) AS value FROM r UNION ALL SELECT 'pearson', 'e2', round(corr(e2, y0), 5) FROM r
    UNION ALL SELECT 'spearman', 'e1', round(corr(r1, ry), 5) FROM r UNION ALL SELECT 'spearman', 'e2', round(corr(r2, ry), 5) FROM r
    UNION ALL SELECT 'regression', 'e1', round(regr_slope(y0, e1), 3) FROM r UNION ALL SELECT 'regression', 'e2', round(regr_slope(y0, e2), 3) FROM r""")
def environment_associations(spark, d):
    """Of a response, as of an axis, with the environment."""
    rows, told = _stations(spark, d).select("y0", "e1", "e2"), None
    for method, digits in (("pearson", 5), ("spearman", 5), ("regression", 3)):
        got = ordination.associations(rows, ["e1", "e2"], ["y0"], method).select(F.lit(method).alias("method"), "variable", F.round("value", digits).alias("value"))
        told = got if told is None else told.unionByName(got)
    return told


@query()
def constrained_axes(spark, d):
    """sites' centroids on the axes, species and environment in the same plane."""
    rows = _stations(spark, d)
    fit = ordination.redundancy(rows, ["y0", "y1"], ["e1", "e2"], ["t"])
    scores = ordination.redundancy_scores(rows, fit)
    centres = scores.groupBy(F.lit("site").alias("kind"), F.col("site").alias("name")).agg(F.avg("rda1").alias("rda1"), F.avg("rda2").alias("rda2"))
    _, loadings = ordination.biplot(np.zeros((0, fit.axes)), fit.loadings(), fit.values(fit.sxy), "scaling2")
    species = spark.createDataFrame([("species", y, *map(float, row)) for y, row in zip(fit.ys, loadings)], "kind string, name string, rda1 double, rda2 double")
    env = ordination.associations(scores, fit.xs, ["rda1", "rda2"]).groupBy(F.lit("environment").alias("kind"), F.col("variable").alias("name")).pivot("axis", ["rda1", "rda2"]).agg(F.first("value"))
    return rounded(centres.unionByName(species).unionByName(env))


@query()
def constrained_correspondence(spark, d):
    """M22."""
    obs = observations(spark, d)
    env = obs.groupBy("sample").agg(F.avg("discount").alias("e1"), F.avg("tax").alias("e2"))
    got = ordination.correspondence_axes(obs, env, "sample", "taxon", "density", ["e1", "e2"])
    return spark.createDataFrame([(k, i, float(v)) for k, vs in got.items() for i, v in enumerate(vs if isinstance(vs, list) else [vs])], "name string, nth int, value double")


@query()
def mixed_clusters(spark, d):
    """M17."""
    part = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 2000).alias("price"), "p_type")
    return ordination.k_prototypes(part, ["size", "price"], ["p_type"], 3).select("p_partkey", "cluster")
