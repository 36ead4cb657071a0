"""Cleaning, filtering, joining, aggregating, reshaping and window plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import calendar, formula, measures, text
from tidewrack.operators import aggregates, filters, tables, windows
from tidewrack.plans.base import OBS, SERIES, observations, query, rounded, series, table


@query("""SELECT doc_id, lower(replace(replace(text, ' ', ''), '.', '')) AS name_key, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
    trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned, source || '.' || coalesce(lang, 'nan') AS key FROM documents""")
def clean_texts(spark, d):
    """P4, P7, P9, P13, C15."""
    return table(spark, d, "documents").select(
        "doc_id", text.normal_name(F.col("text")).alias("name_key"), text.slugify(F.col("source")).alias("slug"),
        text.clean_text(F.col("text"), normalise=False).alias("cleaned"), text.composite_key(["source", "lang"]).alias("key"),
    )


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type IN ('click', 'view') AS flag, CASE lower(event_type) WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS code FROM events""")
def lenient_casts(spark, d):
    """P10, P11, P18, C24, C26."""
    props = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", text.comma_number(props).alias("k"), F.col("event_type").isin("click", "view").alias("flag"), text.mapped(F.col("event_type"), {"click": "c", "view": "v"}).alias("code"))


@query("""SELECT o_orderkey, CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS VARCHAR) AS first_day, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season,
    CASE month(o_orderdate) WHEN 4 THEN 'Spring' WHEN 10 THEN 'Autumn' ELSE 'Other' END AS campaign, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(CAST(make_date(year(o_orderdate), 1, 1) AS DATE) + CAST(((dayofyear(o_orderdate) - 1) // 8) * 8 AS INTEGER) AS VARCHAR) AS interval_start FROM orders""")
def dates_and_seasons(spark, d):
    """P16, P17, P24, C18-C20."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", calendar.safe_date(F.year(day), F.month(day), F.lit(1)).cast("string").alias("first_day"), calendar.season(F.month(day)).alias("season"),
        calendar.campaign_season(F.month(day)).alias("campaign"), F.dayofyear(day).alias("doy"), calendar.interval_start(day, 8).cast("string").alias("interval_start"),
    )


@query("""SELECT p_partkey, round(ln(p_retailprice) / ln(2), 6) AS log2, round(CASE WHEN p_size - 10 > 0 THEN ln(p_size - 10) END, 6) AS guarded, round(sqrt(p_size), 6) AS root, round(cbrt(p_retailprice), 6) AS cube, round((power(p_retailprice, 0.5) - 1) / 0.5, 6) AS boxcox,
    round(ln(1 + p_size), 6) AS l1p, round_even(p_retailprice, 1) AS half_even, round(p_retailprice / nullif(p_size % 5, 0), 6) AS ratio FROM part""")
def transforms(spark, d):
    """C1-C6, C9, P20, P22."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.round(measures.safe_log(price, 2.0), 6).alias("log2"), F.round(measures.safe_log(size - 10), 6).alias("guarded"), F.round(measures.safe_sqrt(size), 6).alias("root"),
        F.round(F.cbrt(price), 6).alias("cube"), F.round(measures.box_cox(price, 0.5), 6).alias("boxcox"), F.round(measures.yeo_johnson(size, 0.0), 6).alias("l1p"),
        F.bround(price, 1).alias("half_even"), F.round(measures.ratio(price, (size % 5).cast("double")), 6).alias("ratio"),
    )


@query("""SELECT p_partkey, round(CASE WHEN p_retailprice < 3000 THEN 0.26 * power(p_retailprice, 0.86) ELSE 0.216 * power(p_retailprice, 0.939) END, 5) AS carbon, round(p_retailprice * 1.03 / 1000, 6) AS biomass,
    round_even(p_size * 1000.0 / 7, 2) AS whole, CASE WHEN p_size <= 5 THEN 0.001979 WHEN p_size <= 10 THEN 0.00365 WHEN p_size <= 25 THEN 0.010555 WHEN p_size <= 50 THEN 0.021703 ELSE 0.041598 END::DOUBLE AS coefficient FROM part""")
def cell_measures(spark, d):
    """C10, C11, P19, P21."""
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", F.round(measures.carbon_content(price, F.lit(False)), 5).alias("carbon"), F.round(measures.biomass(price), 6).alias("biomass"),
        measures.density_by_chamber(size, F.lit(7.0)).alias("whole"), measures.volume_coefficient(size).alias("coefficient"),
    )


#: A formula for each kind of part, as a table of formulas would hold it.
FORMULAS = {"SMALL": "pi / 6 * p_size ^ 3", "LARGE": "sqrt(p_retailprice) * 2", "ECONOMY": "p_retailprice / (p_size - 1)", "PROMO": "no"}


@query("""SELECT p_partkey, round(CASE split_part(p_type, ' ', 1) WHEN 'SMALL' THEN pi() / 6 * power(p_size, 3) WHEN 'LARGE' THEN sqrt(p_retailprice) * 2 WHEN 'ECONOMY' THEN p_retailprice / nullif(p_size - 1, 0) END, 5) AS volume FROM part""")
def formulas_as_data(spark, d):
    """Each row's formula from a small table, one branch for each distinct formula."""
    part = table(spark, d, "part").withColumn("kind", F.split("p_type", " ")[0])
    named = part.withColumn("formula", text.mapped(F.col("kind"), FORMULAS, keep=False))
    value = formula.by_row("formula", FORMULAS.values(), part.columns)
    return named.select("p_partkey", F.round(value, 5).alias("volume"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10 AND l_quantity <= 30 AND l_discount BETWEEN 0.02 AND 0.06""")
def rule_filter(spark, d):
    """rules from a table become one predicate that reaches the scan."""
    asked = filters.rules([{"key": "l_returnflag", "value": "R"}, {"key": "l_quantity", "min": 10, "max": 30}])
    return table(spark, d, "lineitem").where(asked & F.col("l_discount").between(0.02, 0.06)).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS INTEGER) >> 1) & 3 IN (0, 1) AND l_tax > 0 AS good, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS kept FROM lineitem""")
def quality_flags(spark, d):
    """F9, F14, F15, C14, B3, B4."""
    good = filters.quality_bits(F.col("l_quantity").cast("int"), 1, 2, (0, 1)) & (F.col("l_tax") > 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", good.alias("good"), filters.in_range(F.col("l_quantity"), 5, 45).alias("kept"))


@query(f"""WITH {OBS}, k AS (SELECT taxon FROM obs GROUP BY 1 HAVING count(DISTINCT CASE WHEN density > 45 THEN sample END) >= 0.6 * (SELECT count(DISTINCT sample) FROM obs)) SELECT taxon, count(*) AS n FROM obs WHERE taxon IN (SELECT taxon FROM k) GROUP BY 1""")
def frequent_taxa(spark, d):
    """F18."""
    obs = observations(spark, d).withColumn("over", F.greatest(F.col("density") - 45, F.lit(0.0)))
    return filters.frequent_taxa(obs, "sample", "taxon", "over", 0.6).groupBy("taxon").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, n_name, r_name, s.n AS n_suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey""")
def checked_merges(spark, d):
    """Chained equi-joins with checked keys."""
    nation = tables.renamed(table(spark, d, "nation"), {"n_nationkey": "c_nationkey", "n_regionkey": "r_regionkey"})
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n_suppliers"))
    told = tables.merge(tables.merge(table(spark, d, "customer"), nation, ["c_nationkey"]), table(spark, d, "region"), ["r_regionkey"])
    return tables.merge(told, counts, ["c_nationkey"], "left").select("c_custkey", "n_name", "r_name", "n_suppliers")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def rare_keys(spark, d):
    """J12, U7, F7."""
    big = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return tables.not_in(table(spark, d, "customer"), big, "c_custkey").select("c_custkey")


@query(f"""WITH {OBS} SELECT site, count(DISTINCT taxon) AS taxa, round(avg(density), 6) AS mean_density, round(sum(biovolume), 2) AS sum_biovolume, round(stddev_samp(density), 6) AS sd, min(density) AS least, max(density) AS most FROM obs GROUP BY 1""")
def named_aggregates(spark, d):
    """A1, A2, A10, J6."""
    return observations(spark, d).groupBy("site").agg(
        F.count_distinct("taxon").alias("taxa"), F.round(F.avg("density"), 6).alias("mean_density"), F.round(F.sum("biovolume"), 2).alias("sum_biovolume"),
        F.round(F.stddev_samp("density"), 6).alias("sd"), F.min("density").alias("least"), F.max("density").alias("most"),
    )


@query(f"""WITH {OBS} SELECT site, year, round(avg(density), 6) AS density, round(sum(biovolume), 2) AS biovolume, count(DISTINCT taxon) AS richness FROM obs GROUP BY 1, 2""")
def instructed_aggregates(spark, d):
    """What to do with a column is data."""
    got = aggregates.by_instructions(observations(spark, d), ["site", "year"], {"density": "A mean", "biovolume": "sum"}, "taxon")
    return got.select("site", "year", F.round("density", 6).alias("density"), F.round("biovolume", 2).alias("biovolume"), "richness")


@query(f"""WITH {OBS}, c AS (SELECT site, size, count(*) AS n FROM obs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, size) AS k FROM c) SELECT site, size, n FROM r WHERE k = 1""")
def group_mode(spark, d):
    """A9, A14-A16."""
    return aggregates.mode_of(observations(spark, d), ["site"], "size")


@query(f"""WITH {OBS}, m AS (SELECT site, median(biovolume) AS m FROM obs GROUP BY 1), q AS (SELECT site, quantile_cont(biovolume, 0.25) AS q1, quantile_cont(biovolume, 0.5) AS median, quantile_cont(biovolume, 0.75) AS q3 FROM obs GROUP BY 1),
    x AS (SELECT obs.site, median(abs(biovolume - m)) AS mad FROM obs JOIN m ON obs.site = m.site GROUP BY 1) SELECT q.site, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(mad, 4) AS mad FROM q JOIN x ON q.site = x.site""")
def robust_statistics(spark, d):
    """A17-A19."""
    obs = observations(spark, d)
    return rounded(aggregates.quartiles(obs, ["site"], "biovolume").join(aggregates.mad(obs, ["site"], "biovolume").drop("median"), "site"), 4)


@query(f"""WITH {OBS}, m AS (SELECT phylum, count(*) AS n, avg(biovolume) AS m FROM obs GROUP BY 1), c AS (SELECT obs.phylum, max(n) AS n, avg((biovolume - m) ** 2) AS m2, avg((biovolume - m) ** 3) AS m3, avg((biovolume - m) ** 4) AS m4 FROM obs JOIN m ON obs.phylum = m.phylum GROUP BY 1)
    SELECT phylum, n, round(m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2), 5) AS skewness, round((n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) + 3, 5) AS kurtosis FROM c""")
def distribution_shape(spark, d):
    """A20."""
    return rounded(aggregates.shape(observations(spark, d), ["phylum"], "biovolume"), 5)


@query(f"""WITH {OBS}, t AS (SELECT site, taxon, sum(density) AS v FROM obs GROUP BY 1, 2) SELECT site, min_by(taxon, (v, taxon)) AS lowest, min_by(taxon, (-v, taxon)) AS highest FROM t GROUP BY 1""")
def extreme_taxa(spark, d):
    """A21, C23."""
    totals = observations(spark, d).groupBy("site", "taxon").agg(F.sum("density").alias("v"))
    return aggregates.extremes(totals, ["site"], "taxon", "v")


@query(f"""WITH {OBS} SELECT coalesce(site, 'All') AS site, round(sum(density), 4) AS sum, round(avg(density), 6) AS mean FROM obs GROUP BY ROLLUP (site)""")
def totals_and_all(spark, d):
    """A26, A27, U1."""
    got = aggregates.with_total(observations(spark, d), "site", "density")
    return got.select("site", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY site, year ORDER BY ord, line) AS k FROM obs) SELECT site, year, ord, line, taxon FROM r WHERE k = 1""")
def first_per_key(spark, d):
    """A29, A30."""
    return aggregates.first_rows(observations(spark, d), ["site", "year"], [F.col("ord"), F.col("line")]).select("site", "year", "ord", "line", "taxon")


@query(f"""WITH {OBS} SELECT site, round(coalesce(sum(density) FILTER (year = 1995), 0), 4) AS "1995", round(coalesce(sum(density) FILTER (year = 1996), 0), 4) AS "1996", round(coalesce(sum(density) FILTER (year = 1997), 0), 4) AS "1997" FROM obs GROUP BY 1""")
def wide_years(spark, d):
    """R1-R3, T12."""
    return rounded(tables.wide(observations(spark, d), ["site"], "year", "density", [1995, 1996, 1997]), 4)


@query(f"""WITH {OBS}, g AS (SELECT s.sample, t.taxon FROM (SELECT DISTINCT sample FROM obs) s CROSS JOIN (SELECT DISTINCT taxon FROM obs) t), x AS (SELECT sample, taxon, sum(density) AS v FROM obs WHERE density > 40 GROUP BY 1, 2)
    SELECT g.sample, g.taxon, round(coalesce(v, 0), 4) AS density FROM g LEFT JOIN x ON g.sample = x.sample AND g.taxon = x.taxon""")
def dense_matrix(spark, d):
    """D3, R10, U8."""
    obs = observations(spark, d)
    keep = obs.withColumn("density", F.when(F.col("density") > 40, F.col("density")).otherwise(0.0))
    return rounded(tables.dense(keep, ["sample"], "taxon", "density"), 4)


@query("""SELECT p_partkey, 'p_retailprice' AS variable, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'p_size', p_size FROM part""")
def long_form(spark, d):
    """R4, R5."""
    return tables.long(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_partkey"], ["p_retailprice", "p_size"])


@query(f"""WITH {SERIES} SELECT kind, CAST(day AS VARCHAR) AS day, round(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END, 5) AS average FROM series WINDOW w AS (PARTITION BY kind ORDER BY day ROWS 2 PRECEDING)""")
def moving_average(spark, d):
    """W1."""
    return series(spark, d).select("kind", F.col("day").cast("string").alias("day"), F.round(windows.moving_average("value", ["kind"], "day", 3), 5).alias("average"))


@query(f"""WITH {SERIES}, l AS (SELECT kind, day, value, lag(value) OVER (PARTITION BY kind ORDER BY day) AS before FROM series) SELECT kind, CAST(day AS VARCHAR) AS day, round(before, 5) AS before FROM l WHERE before IS NOT NULL""")
def lagged_values(spark, d):
    """W2."""
    return windows.lagged(series(spark, d), ["kind"], "day", "value", "before").select("kind", F.col("day").cast("string").alias("day"), F.round("before", 5).alias("before"))


@query(f"""WITH {OBS}, h AS (SELECT ord, line, site, CASE WHEN size % 7 = 0 THEN NULL ELSE density END AS v FROM obs) SELECT ord, line, round(coalesce(v, avg(v) OVER (PARTITION BY site), avg(v) OVER ()), 5) AS v FROM h""")
def imputed_means(spark, d):
    """W7."""
    holes = observations(spark, d).select("ord", "line", "site", F.when(F.col("size") % 7 != 0, F.col("density")).alias("v"))
    return windows.imputed(holes, ["site"], "v").select("ord", "line", F.round("v", 5).alias("v"))


@query(f"""WITH {OBS}, t AS (SELECT phylum, taxon, sum(density) AS v FROM obs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY phylum ORDER BY v DESC, taxon) AS nth FROM t) SELECT phylum, taxon, round(v, 4) AS v, nth FROM r WHERE nth <= 3""")
def top_taxa(spark, d):
    """W8, W9, O5, O6."""
    totals = observations(spark, d).groupBy("phylum", "taxon").agg(F.sum("density").alias("v"))
    return windows.top_n(totals, ["phylum"], [F.desc("v"), F.col("taxon")], 3).select("phylum", "taxon", F.round("v", 4).alias("v"), F.col("nth").cast("long").alias("nth"))


@query("""SELECT s_suppkey, round(coalesce((s_acctbal - min(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 0), 6) AS scaled, round(s_acctbal - avg(s_acctbal) OVER w, 4) AS centred,
    round(coalesce((s_acctbal - avg(s_acctbal) OVER w) / nullif(stddev_pop(s_acctbal) OVER w, 0), 0), 5) AS z, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS ecdf FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def scaled_values(spark, d):
    """W10-W12, W28, C7."""
    k = ["s_nationkey"]
    return table(spark, d, "supplier").select("s_suppkey", F.round(windows.min_max("s_acctbal", k), 6).alias("scaled"), F.round(windows.centred("s_acctbal", k), 4).alias("centred"), F.round(windows.z_score("s_acctbal", k), 5).alias("z"), F.round(windows.ecdf("s_acctbal", k), 6).alias("ecdf"))


@query(f"""WITH {OBS}, c AS (SELECT site, median(biovolume) AS m, median(density) AS m2 FROM obs GROUP BY 1), s AS (SELECT obs.site, median(abs(biovolume - m)) AS a, median(abs(density - m2)) AS a2 FROM obs JOIN c ON obs.site = c.site GROUP BY 1)
    SELECT obs.site, count(*) AS n, count(CASE WHEN greatest(abs(0.6745 * (biovolume - m) / a), abs(0.6745 * (density - m2) / a2)) > 1.5 THEN 1 END) AS outliers FROM obs JOIN c ON obs.site = c.site JOIN s ON s.site = obs.site GROUP BY 1""")
def robust_outliers(spark, d):
    """W13, V7."""
    scored = windows.outlier_scores(observations(spark, d).select("site", "biovolume", "density"), ["site"], ["biovolume", "density"], "mad")
    return windows.flagged(scored, ["biovolume", "density"], 1.5).groupBy("site").agg(F.count("*").alias("n"), F.count_if("outlier").alias("outliers"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, quantile_cont(o_totalprice, 0.995) AS top FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice < q1 - 0.5 * (q3 - q1) OR o_totalprice > q3 + 0.5 * (q3 - q1) THEN 'o_totalprice' ELSE '' END AS outlying, round(least(o_totalprice, top), 4) AS clipped FROM orders CROSS JOIN q WHERE abs(o_totalprice - m) <= 1.5 * s""")
def outlier_reports(spark, d):
    """W14-W16."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    told = windows.iqr_report(orders, ["o_totalprice"], 0.5)
    near = windows.within_sds(orders, "o_totalprice", 1.5).select("o_orderkey")
    top = windows.clipped(orders, "o_totalprice", 0.995).select("o_orderkey", F.round("o_totalprice", 4).alias("clipped"))
    return told.join(near, "o_orderkey", "left_semi").join(top, "o_orderkey").select("o_orderkey", "outlying", "clipped")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END AS place, lpad(regexp_extract(o_orderpriority, '^(\\d+)', 1), 12, '0') || regexp_replace(o_orderpriority, '^\\d+', '') AS natural_key FROM orders""")
def custom_order(spark, d):
    """O1-O4, O8."""
    return table(spark, d, "orders").select("o_orderkey", tables.ordered_by_list("o_orderpriority", ["1-URGENT", "5-LOW"]).cast("int").alias("place"), tables.natural("o_orderpriority").alias("natural_key"))


@query(f"""WITH {OBS} SELECT taxon, round(sum(density), 4) AS total FROM obs GROUP BY 1 ORDER BY sum(density) DESC, taxon LIMIT 15""")
def top_fifteen(spark, d):
    """O5."""
    return rounded(tables.top_by_total(observations(spark, d), "taxon", "density", 15), 4)


@query("""SELECT c_nationkey AS key FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier""")
def shared_keys(spark, d):
    """U3-U6."""
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"))
    return a.intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")))


@query("""SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def ragged_union(spark, d):
    """U2, S11."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return tables.stacked(a, b)


@query("""SELECT p_partkey, p_size * p_retailprice AS p_size_x_p_retailprice, power(p_size, 2) AS p_size_2, CASE WHEN p_type LIKE 'LARGE%' THEN 1 ELSE 0 END AS kind_LARGE, CASE WHEN p_type LIKE 'SMALL%' THEN 1 ELSE 0 END AS kind_SMALL FROM part""")
def feature_columns(spark, d):
    """P29-P31."""
    part = table(spark, d, "part").withColumn("kind", F.split("p_type", " ")[0])
    return part.select("p_partkey", *tables.interactions(["p_size", "p_retailprice"]), *tables.powers(["p_size"], 2), *tables.one_hot("kind", ["ECONOMY", "LARGE", "SMALL"]))
