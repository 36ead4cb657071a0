"""Diversity, composition, dissimilarity and niche plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import measures
from tidewrack.operators import aggregates, dissimilarity, diversity, niche, tables, windows
from tidewrack.plans.base import OBS, observations, query, rounded, table

_MOMENTS = f"""WITH {OBS}, x AS (SELECT site, taxon, sum(density) AS x FROM obs GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY x DESC, taxon) AS k FROM x),
    m AS (SELECT site, sum(x) AS s, sum(x * x) AS s2, sum(CASE WHEN x > 0 THEN x * ln(x) END) AS xlnx, count(CASE WHEN x > 0 THEN 1 END) AS n,
                 max(CASE WHEN k = 1 THEN x END) AS one, max(CASE WHEN k = 2 THEN x END) AS two FROM r GROUP BY 1),
    h AS (SELECT *, ln(s) - xlnx / s AS h, s2 / (s * s) AS p2, (SELECT count(DISTINCT taxon) FROM obs) AS t FROM m)"""


@query(f"""{_MOMENTS}
    SELECT site, n AS richness, round(h, 6) AS shannon, round(exp(h), 6) AS shannon_eq, round(1 - p2, 6) AS simpson, round(1 / (1 - p2), 6) AS simpson_eq,
           round(n / sqrt(s), 6) AS menhinick, round((n - 1) / ln(s), 6) AS margalef, round(n / ln(s), 6) AS gleason,
           round((s + sqrt(s2)) / (s + sqrt(s)), 6) AS mcintosh, round(n / (n - 1) * (1 - p2), 6) AS hurlbert, round(h / ln(n), 6) AS pielou,
           round(exp(h) / n, 6) AS sheldon, round((exp(h) - 1) / (n - 1), 6) AS ludwig_reynolds, round(one / s, 6) AS berger_parker,
           round((one + two) / s, 6) AS mcnaughton, round(100 * (one + two) / s, 6) AS hulburt FROM h""")
def diversity_indices(spark, d):
    """G1-G16, first definitions."""
    return rounded(diversity.classic_indices(observations(spark, d), ["site"], "taxon", "density"))


@query(f"""{_MOMENTS}
    SELECT site, n AS richness, round(h, 6) AS shannon, round(h / ln(t), 6) AS shannon_eq, round(1 - p2, 6) AS simpson, round(1 / p2, 6) AS simpson_eq,
           round(n / sqrt(s), 6) AS menhinick, round((n - 1) / ln(s), 6) AS margalef, round((n - 1) / ln(10), 6) AS gleason,
           round(sqrt(s2) / s, 6) AS mcintosh, round(s / (s - 1) * (1 - p2), 6) AS hurlbert, round(h / ln(n), 6) AS pielou,
           round(n / t, 6) AS sheldon, round(p2 / ln(t), 6) AS ludwig_reynolds, round(one / s, 6) AS berger_parker,
           round((one + two) / s, 6) AS mcnaughton, round(1 - p2, 6) AS hulburt FROM h""")
def diversity_indices_dense(spark, d):
    """G1-G16, second definitions."""
    return rounded(diversity.dense_indices(observations(spark, d), ["site"], "taxon", "density"))


@query(f"""WITH {OBS}, x AS (SELECT sample, phylum, sum(density) AS x FROM obs GROUP BY 1, 2), p AS (SELECT *, x / sum(x) OVER (PARTITION BY sample) AS p FROM x)
    SELECT sample, count(*) AS richness, round(-sum(p * ln(p)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson, round(-sum(p * ln(p)) / ln(count(*)), 6) AS pielou FROM p GROUP BY 1""")
def diversity_by_sample(spark, d):
    """Per site and year, at phylum level."""
    found = diversity.classic_indices(observations(spark, d), ["sample"], "phylum", "density")
    return rounded(found.select("sample", "richness", "shannon", "simpson", "pielou"))


@query(f"""WITH {OBS} SELECT year, count(DISTINCT phylum) AS n_phylum, count(DISTINCT taxon) AS n_taxon, round(100.0 * count(taxon) / count(*), 6) AS identified_percent FROM obs GROUP BY 1""")
def taxa_percentages(spark, d):
    """G24, A3."""
    return rounded(diversity.taxa_percentages(observations(spark, d), ["year"], ["phylum", "taxon"]))


@query(f"""WITH {OBS}, x AS (SELECT site, taxon, CAST(floor(sum(density)) AS BIGINT) AS x FROM obs GROUP BY 1, 2), t AS (SELECT *, CAST(sum(x) OVER (PARTITION BY site) AS BIGINT) AS a FROM x),
    m AS (SELECT least(min(a), 5000) AS d FROM t), depths AS (SELECT unnest(generate_series(CAST(1 AS BIGINT), (SELECT d FROM m), greatest((SELECT d FROM m) // 100, 1))) AS depth)
    SELECT site, depth, round(sum(1 - CASE WHEN a - x >= depth THEN exp(lgamma(a - x + 1) + lgamma(a - depth + 1) - lgamma(a - x - depth + 1) - lgamma(a + 1)) ELSE 0 END), 5) AS expected
    FROM t CROSS JOIN depths GROUP BY 1, 2""")
def rarefaction_curves(spark, d):
    """G19, C12."""
    return rounded(diversity.rarefaction(observations(spark, d), ["site"], "taxon", "density"), 5)


_DEPTHS = """t AS (SELECT *, CAST(sum(x) OVER (PARTITION BY site) AS BIGINT) AS a FROM x), m AS (SELECT least(min(a), 5000) AS d FROM t), depths AS (SELECT unnest(generate_series(CAST(1 AS BIGINT), (SELECT d FROM m), greatest((SELECT d FROM m) // 100, 1))) AS depth),
    c AS (SELECT site, depth, sum(1 - CASE WHEN a - x >= depth THEN exp(lgamma(a - x + 1) + lgamma(a - depth + 1) - lgamma(a - x - depth + 1) - lgamma(a + 1)) ELSE 0 END) AS expected FROM t CROSS JOIN depths GROUP BY 1, 2)"""


@query(f"""WITH {OBS}, x AS (SELECT sample AS site, taxon, CAST(floor(sum(density)) AS BIGINT) AS x FROM obs GROUP BY 1, 2 HAVING floor(sum(density)) > 0), {_DEPTHS}
    SELECT left(site, 3) AS treatment, depth, round(avg(expected), 5) AS expected, round(coalesce(stddev_samp(expected), 0), 5) AS sd, count(*) AS n FROM c GROUP BY 1, 2""")
def rarefaction_means(spark, d):
    """Mean curves of a treatment's samples."""
    curves = diversity.rarefaction(observations(spark, d), ["sample"], "taxon", "density")
    return rounded(diversity.mean_curves(curves.withColumn("treatment", F.substring("sample", 1, 3)), ["treatment"]), 5)


@query(f"""WITH {OBS}, x AS (SELECT split_part(site, '.', 2) AS site, taxon, CAST(floor(sum(density)) AS BIGINT) AS x FROM obs GROUP BY 1, 2), {_DEPTHS}
    SELECT site AS pool, depth, round(expected, 5) AS expected FROM c""")
def rarefaction_pooled(spark, d):
    """Curves of pooled communities (all sites of a status together)."""
    pooled = observations(spark, d).withColumn("pool", F.split("site", r"\.")[1])
    return rounded(diversity.rarefaction(pooled, ["pool"], "taxon", "density"), 5)


_TRAITS = "tr AS (SELECT p_brand AS taxon, CAST(avg(p_size) AS DOUBLE) AS t1, avg(p_retailprice) AS t2 FROM part GROUP BY 1)"


def _traits(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("taxon")).agg(F.avg("p_size").alias("t1"), F.avg("p_retailprice").alias("t2"))


@query(f"""WITH {OBS}, {_TRAITS}, x AS (SELECT site, taxon, sum(density) AS x FROM obs GROUP BY 1, 2), p AS (SELECT site, taxon, x / sum(x) OVER (PARTITION BY site) AS p FROM x WHERE x > 0),
    g AS (SELECT max(t1) - min(t1) AS r1, max(t2) - min(t2) AS r2 FROM tr), h AS (SELECT p.site, p.taxon, p.p, t1, t2 FROM p JOIN tr USING (taxon)),
    rao AS (SELECT a.site, sum(a.p * b.p * (abs(a.t1 - b.t1) / r1 + abs(a.t2 - b.t2) / r2) / 2) AS rao_q FROM h a JOIN h b ON a.site = b.site CROSS JOIN g GROUP BY 1),
    c AS (SELECT site, sum(p * t1) AS c1, sum(p * t2) AS c2 FROM h GROUP BY 1),
    f AS (SELECT h.site, count(*) AS richness, sum(p * sqrt((t1 - c1) * (t1 - c1) + (t2 - c2) * (t2 - c2))) AS fdis FROM h JOIN c ON h.site = c.site GROUP BY 1)
    SELECT f.site, richness, round(fdis, 5) AS fdis, round(rao_q, 6) AS rao_q FROM f JOIN rao ON f.site = rao.site""")
def functional_diversity(spark, d):
    """G21, G22."""
    weights = diversity.community(observations(spark, d), ["site"], "taxon", "density")
    found = diversity.rao_fdis(weights, _traits(spark, d), ["site"], "taxon", ["t1", "t2"])
    return found.select("site", "richness", F.round("fdis", 5).alias("fdis"), F.round("rao_q", 6).alias("rao_q"))


@query(f"""WITH {OBS}, {_TRAITS}, x AS (SELECT sample AS site, taxon, sum(density) AS x FROM obs GROUP BY 1, 2), p AS (SELECT site, taxon, x / sum(x) OVER (PARTITION BY site) AS p FROM x WHERE x > 0),
    g AS (SELECT max(t1) - min(t1) AS r1, max(t2) - min(t2) AS r2 FROM tr), h AS (SELECT p.site, p.taxon, p.p, t1, t2 FROM p JOIN tr USING (taxon)),
    rao AS (SELECT a.site, sum(a.p * b.p * (abs(a.t1 - b.t1) / r1 + abs(a.t2 - b.t2) / r2) / 2) AS rao_q FROM h a JOIN h b ON a.site = b.site CROSS JOIN g GROUP BY 1),
    c AS (SELECT site, sum(p * t1) AS c1, sum(p * t2) AS c2 FROM h GROUP BY 1),
    f AS (SELECT h.site, count(*) AS richness, sum(p * sqrt((t1 - c1) * (t1 - c1) + (t2 - c2) * (t2 - c2))) AS fdis FROM h JOIN c ON h.site = c.site GROUP BY 1),
    y AS (SELECT f.site AS sample, richness, fdis, rao_q, split_part(f.site, '.', 3) AS year FROM f JOIN rao ON f.site = rao.site)
    SELECT sample, richness, round(fdis, 5) AS fdis, round(rao_q, 5) AS rao_q, year, round(
        CASE WHEN max(richness) OVER w > min(richness) OVER w THEN (richness - min(richness) OVER w) / (max(richness) OVER w - min(richness) OVER w) ELSE 0 END
        - CASE WHEN max(rao_q) OVER w > min(rao_q) OVER w THEN (rao_q - min(rao_q) OVER w) / (max(rao_q) OVER w - min(rao_q) OVER w) ELSE 0 END, 5) AS redundancy FROM y WINDOW w AS (PARTITION BY year)""")
def functional_redundancy(spark, d):
    """G23, W10."""
    weights = diversity.community(observations(spark, d), ["sample"], "taxon", "density")
    found = diversity.rao_fdis(weights, _traits(spark, d), ["sample"], "taxon", ["t1", "t2"])
    return rounded(diversity.redundancy(found.withColumn("year", F.substring_index("sample", ".", -1)), ["year"]), 5)


@query(f"""WITH {OBS}, t AS (SELECT site, taxon, sum(density) AS total FROM obs GROUP BY 1, 2), w AS (SELECT *, total / sum(total) OVER (PARTITION BY site) AS share,
    sum(total) OVER (PARTITION BY site ORDER BY total DESC, taxon ROWS UNBOUNDED PRECEDING) / sum(total) OVER (PARTITION BY site) AS cumulative FROM t)
    SELECT site, taxon, round(total, 6) AS total, round(cumulative, 9) AS cumulative, round(share, 9) AS share FROM w WHERE cumulative <= 0.6 + 1e-12""")
def dominant_taxa(spark, d):
    """Taxa up to a share, the crossing one left out."""
    return windows.top_share(observations(spark, d), ["site"], "taxon", "density", 0.6, crossing=False).select("site", "taxon", F.round("total", 6).alias("total"), F.round("cumulative", 9).alias("cumulative"), F.round("share", 9).alias("share"))


@query(f"""WITH {OBS}, t AS (SELECT site, taxon, sum(density) AS total FROM obs GROUP BY 1, 2), w AS (SELECT *, total / sum(total) OVER (PARTITION BY site) AS share,
    sum(total) OVER (PARTITION BY site ORDER BY total DESC, taxon ROWS UNBOUNDED PRECEDING) / sum(total) OVER (PARTITION BY site) AS cumulative FROM t)
    SELECT site, taxon, round(total, 6) AS total FROM w WHERE cumulative - share < 0.6""")
def dominant_taxa_crossing(spark, d):
    """The crossing taxon kept."""
    return windows.top_share(observations(spark, d), ["site"], "taxon", "density", 0.6, crossing=True).select("site", "taxon", F.round("total", 6).alias("total"))


@query(f"""WITH {OBS}, t AS (SELECT year, taxon, sum(density) AS a, sum(biovolume) AS b FROM obs GROUP BY 1, 2)
    SELECT year, taxon, round(100 * sum(a) OVER w / sum(a) OVER (PARTITION BY year), 6) AS cumulative_density, round(100 * sum(b) OVER w / sum(b) OVER (PARTITION BY year), 6) AS cumulative_biovolume
    FROM t WINDOW w AS (PARTITION BY year ORDER BY a DESC, taxon ROWS UNBOUNDED PRECEDING)""")
def cumulative_two_metrics(spark, d):
    """W4."""
    return rounded(windows.top_share_of_two(observations(spark, d), ["year"], "taxon", "density", "biovolume"))


@query(f"""WITH {OBS}, t AS (SELECT site, phylum, sum(biovolume) AS total FROM obs GROUP BY 1, 2) SELECT site, phylum, round(total, 4) AS total, round(100 * total / sum(total) OVER (PARTITION BY site), 6) AS percent FROM t""")
def composition_by_phylum(spark, d):
    """W6, J7."""
    return tables.percent_of_total(observations(spark, d), ["site"], ["phylum"], "biovolume").select("site", "phylum", F.round("total", 4).alias("total"), F.round("percent", 6).alias("percent"))


@query(f"""WITH {OBS}, c AS (SELECT site, CAST(round_even(ln(biovolume) / ln(2), 0) AS BIGINT) AS size_class, density FROM obs WHERE biovolume > 0) SELECT site, size_class, round(sum(density), 6) AS total FROM c GROUP BY 1, 2""")
def size_class_spectrum(spark, d):
    """A13, N1, C1."""
    return rounded(aggregates.histogram(observations(spark, d), ["site"], "biovolume", 2.0, "density"))


_PAIRS = f"""WITH {OBS}, x AS (SELECT sample, taxon, log10(sum(density) + 1) AS x FROM obs GROUP BY 1, 2), t AS (SELECT sample, sum(x) AS s, sum(x * x) AS s2 FROM x GROUP BY 1),
    q AS (SELECT a.sample AS i, b.sample AS j, a.s AS si, b.s AS sj, a.s2 AS si2, b.s2 AS sj2 FROM t a JOIN t b ON a.sample < b.sample),
    c AS (SELECT a.sample AS i, b.sample AS j, sum(least(a.x, b.x)) AS l, sum(a.x * b.x) AS p FROM x a JOIN x b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY 1, 2)"""


def _logs(spark, d):
    return diversity.community(observations(spark, d), ["sample"], "taxon", "density").withColumn("x", F.log10(F.col("x") + 1))


@query(f"{_PAIRS} SELECT q.i, q.j, round(1 - 2 * coalesce(l, 0) / (si + sj), 6) AS d FROM q LEFT JOIN c ON q.i = c.i AND q.j = c.j")
def bray_curtis(spark, d):
    """M1, D4."""
    return rounded(dissimilarity.bray_curtis(_logs(spark, d), "sample", "taxon", "x"))


@query(f"{_PAIRS} SELECT q.i, q.j, round(2 * coalesce(p, 0) / ((si2 / (si * si) + sj2 / (sj * sj)) * si * sj), 6) AS similarity FROM q LEFT JOIN c ON q.i = c.i AND q.j = c.j")
def morisita_horn(spark, d):
    """M3."""
    return rounded(dissimilarity.morisita_horn(_logs(spark, d), "sample", "taxon", "x"))


_ENV = f"""WITH {OBS}, e AS (SELECT sample, avg(discount) AS e1, avg(tax) AS e2, avg(size) AS e3 FROM obs GROUP BY 1)"""


def _environment(spark, d):
    return observations(spark, d).groupBy("sample").agg(F.avg("discount").alias("e1"), F.avg("tax").alias("e2"), F.avg("size").alias("e3"))


@query(f"""{_ENV}, z AS (SELECT sample, (e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER () AS e1, (e2 - avg(e2) OVER ()) / stddev_pop(e2) OVER () AS e2, (e3 - avg(e3) OVER ()) / stddev_pop(e3) OVER () AS e3 FROM e)
    SELECT a.sample AS i, b.sample AS j, round(sqrt((a.e1 - b.e1) * (a.e1 - b.e1) + (a.e2 - b.e2) * (a.e2 - b.e2) + (a.e3 - b.e3) * (a.e3 - b.e3)), 5) AS d FROM z a JOIN z b ON a.sample < b.sample""")
def environment_distance(spark, d):
    """Euclidean distance of standardised variables. The samples are few; their moments are one row."""
    env, names = _environment(spark, d), ["e1", "e2", "e3"]
    m = env.agg(*(F.avg(c).alias(f"m{c}") for c in names), *(F.stddev_pop(c).alias(f"s{c}") for c in names))
    z = env.crossJoin(F.broadcast(m)).select("sample", *(measures.ratio(F.col(c) - F.col(f"m{c}"), F.col(f"s{c}")).alias(c) for c in names))
    return rounded(dissimilarity.euclidean(z, "sample", names), 5)


@query(f"""{_ENV}, g AS (SELECT max(e1) - min(e1) AS r1, max(e2) - min(e2) AS r2, max(e3) - min(e3) AS r3 FROM e)
    SELECT a.sample AS i, b.sample AS j, round((abs(a.e1 - b.e1) / r1 + abs(a.e2 - b.e2) / r2 + abs(a.e3 - b.e3) / r3) / 3, 6) AS d FROM e a JOIN e b ON a.sample < b.sample CROSS JOIN g""")
def gower_distance(spark, d):
    """M4."""
    return rounded(dissimilarity.gower(_environment(spark, d), "sample", ["e1", "e2", "e3"]))


_SIMPER = f"""WITH {OBS}, x AS (SELECT site, sample, taxon, log10(sum(density) + 1) AS x FROM obs GROUP BY 1, 2, 3), n AS (SELECT site, count(DISTINCT sample) AS n FROM x GROUP BY 1),
    m AS (SELECT x.site, taxon, sum(x) / max(n) AS mean FROM x JOIN n ON x.site = n.site GROUP BY 1, 2), g AS (SELECT n.site, t.taxon, coalesce(mean, 0) AS mean FROM n CROSS JOIN (SELECT DISTINCT taxon FROM m) t LEFT JOIN m ON m.site = n.site AND m.taxon = t.taxon),
    d AS (SELECT a.site AS group1, b.site AS group2, a.taxon, abs(a.mean - b.mean) AS diff FROM g a JOIN g b ON a.taxon = b.taxon AND a.site < b.site),
    p AS (SELECT *, 100 * diff / sum(diff) OVER (PARTITION BY group1, group2) AS percent FROM d),
    c AS (SELECT *, sum(percent) OVER w AS cumulative, row_number() OVER w AS nth FROM p WINDOW w AS (PARTITION BY group1, group2 ORDER BY percent DESC, taxon ROWS UNBOUNDED PRECEDING))"""


def _simper(spark, d):
    obs = observations(spark, d)
    logs = obs.groupBy("site", "sample", "taxon").agg(F.log10(F.sum("density") + 1).alias("x"))
    return dissimilarity.simper(logs, "site", "sample", "taxon", "x")


@query(f"{_SIMPER} SELECT group1, group2, taxon, nth, round(percent, 5) AS percent, round(cumulative, 5) AS cumulative FROM c WHERE nth <= 20")
def simper(spark, d):
    """M5, O6."""
    return _simper(spark, d).select("group1", "group2", "taxon", F.col("nth").cast("long").alias("nth"), F.round("percent", 5).alias("percent"), F.round("cumulative", 5).alias("cumulative"))


@query(f"{_SIMPER}, t AS (SELECT group1, group2, max(cumulative) AS top FROM c WHERE nth <= 5 GROUP BY 1, 2) SELECT round(avg(top), 5) AS mean, round(median(top), 5) AS median, round(min(top), 5) AS min, round(max(top), 5) AS max FROM t")
def simper_summary(spark, d):
    """M6, A23."""
    return rounded(dissimilarity.simper_summary(_simper(spark, d)), 5)


def _groups(spark, d):
    return observations(spark, d).select(F.col("sample").alias("site"), F.substring("sample", 1, 1).alias("grp")).distinct()


@query()
def permanova(spark, d):
    """M10."""
    return rounded(dissimilarity.permanova(dissimilarity.bray_curtis(_logs(spark, d), "sample", "taxon", "x"), _groups(spark, d)))


@query()
def pairwise_permanova(spark, d):
    """M12."""
    return rounded(dissimilarity.pairwise_permanova(dissimilarity.bray_curtis(_logs(spark, d), "sample", "taxon", "x"), _groups(spark, d), 199))


@query()
def permdisp(spark, d):
    """M11."""
    return rounded(dissimilarity.permdisp(dissimilarity.bray_curtis(_logs(spark, d), "sample", "taxon", "x"), _groups(spark, d)))


@query()
def mantel(spark, d):
    """M13."""
    env = dissimilarity.gower(_environment(spark, d), "sample", ["e1", "e2", "e3"])
    return rounded(dissimilarity.mantel(dissimilarity.bray_curtis(_logs(spark, d), "sample", "taxon", "x"), env))


@query(f"""{_PAIRS}, e AS (SELECT sample, avg(discount) AS e1, avg(tax) AS e2 FROM obs GROUP BY 1), b AS (SELECT q.i, q.j, 1 - 2 * coalesce(l, 0) / (si + sj) AS d FROM q LEFT JOIN c ON q.i = c.i AND q.j = c.j),
    v AS (SELECT 'e1' AS variable, d, abs(x.e1 - y.e1) AS gap FROM b JOIN e x ON b.i = x.sample JOIN e y ON b.j = y.sample UNION ALL SELECT 'e2', d, abs(x.e2 - y.e2) FROM b JOIN e x ON b.i = x.sample JOIN e y ON b.j = y.sample)
    SELECT variable, round(corr(d, gap), 5) AS r, count(gap) AS n FROM v GROUP BY 1""")
def distance_versus_environment(spark, d):
    """M14, J13."""
    pairs = dissimilarity.bray_curtis(_logs(spark, d), "sample", "taxon", "x")
    return rounded(dissimilarity.distance_correlation(pairs, _environment(spark, d).select("sample", "e1", "e2"), "sample", ["e1", "e2"]), 5)


_NICHE = f"""WITH {OBS}, i AS (SELECT phylum, taxon, avg(biovolume) AS opt, stddev_samp(biovolume) AS tol, sum(density) AS w FROM obs GROUP BY 1, 2), v AS (SELECT *, opt - tol / 2 AS xmin, opt + tol / 2 AS xmax FROM i)"""


def _intervals(spark, d):
    got = observations(spark, d).groupBy("phylum", "taxon").agg(F.avg("biovolume").alias("opt"), F.stddev_samp("biovolume").alias("tol"), F.sum("density").alias("w"))
    return niche.intervals(got, "opt", "tol")


@query(f"""{_NICHE} SELECT a.phylum, a.taxon AS i, b.taxon AS j, round(CASE WHEN a.xmax > a.xmin AND b.xmin IS NOT NULL THEN greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) / (a.xmax - a.xmin) ELSE 0 END, 6) AS overlap
    FROM v a JOIN v b ON a.phylum = b.phylum AND a.taxon <> b.taxon""")
def niche_overlap(spark, d):
    """N5, J14, P35."""
    return rounded(niche.overlaps(_intervals(spark, d), "taxon", ["phylum"]))


@query(f"{_NICHE} SELECT phylum, round(min(xmin), 4) AS xmin, round(max(xmax), 4) AS xmax, count(*) AS n_taxa FROM v GROUP BY 1")
def class_intervals(spark, d):
    """N6."""
    return rounded(niche.class_intervals(_intervals(spark, d), ["phylum"]), 4)


@query()
def response_curves(spark, d):
    """A Poisson curve of each taxon along discount, yearly counts by site."""
    obs = observations(spark, d).groupBy("taxon", "sample", F.floor((F.col("discount") - 0.05) * 40).alias("x")).agg(F.sum("density").alias("y")).withColumn("x", F.col("x").cast("double"))
    return rounded(niche.response_curves(obs, ["taxon"], "x", "y"), 4)


@query()
def response_grid(spark, d):
    """N4."""
    obs = observations(spark, d).groupBy("phylum", "sample", F.floor((F.col("discount") - 0.05) * 40).alias("x")).agg(F.sum("density").alias("y")).withColumn("x", F.col("x").cast("double"))
    return niche.curve_grid(niche.response_curves(obs, ["phylum"], "x", "y"), ["phylum"])


@query()
def null_model(spark, d):
    """Observed overlap of the phyla's niches against shuffles."""
    obs = observations(spark, d).withColumn("x", (F.col("year") - 1998).cast("double"))
    return niche.null_model(obs, "sample", "phylum", "x", "density")
