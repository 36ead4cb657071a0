"""Plans that call, one by one, the functions of filters, tables, aggregates, windows, rasters and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.functions import measures, text
from tidewrack.operators import aggregates, classes, filters, niche, ordination, raster, statistics, tables, timeseries, windows
from tidewrack.plans.base import OBS, PIXELS, SERIES, observations, pixels, query, rounded, series, table


@query("""
    SELECT doc_id, 'all' AS kind FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL
    UNION ALL SELECT doc_id, 'two' FROM documents
    WHERE (text IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (nullif(source, 's0') IS NOT NULL)::INT >= 2
""")
def present_rows(spark, d):
    """F1-F3."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.nullif("source", F.lit("s0")).alias("source"))
    every = filters.present(docs, ["text", "lang"]).select("doc_id", F.lit("all").alias("kind"))
    return every.union(filters.present(docs, ["text", "lang", "source"], 2).select("doc_id", F.lit("two").alias("kind")))


@query("""
    SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_tax BETWEEN 0.01 AND 0.05
""")
def boxed_rows(spark, d):
    """F6."""
    inside = filters.box("l_discount", "l_tax", 0.02, 0.06, 0.01, 0.05)
    return table(spark, d, "lineitem").where(inside).select("l_orderkey", "l_linenumber")


@query("""
    WITH f AS (SELECT *, min(c_mktsegment) OVER (PARTITION BY c_nationkey) AS place FROM customer)
    SELECT c_custkey FROM f WHERE c_mktsegment = CASE WHEN c_nationkey % 2 = 0 THEN 'BUILDING' ELSE place END
""")
def chosen_places(spark, d):
    """F8."""
    named = table(spark, d, "nation").where("n_nationkey % 2 = 0")
    named = named.select(F.col("n_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return filters.chosen_places(table(spark, d, "customer"), named, "c_nationkey", "c_mktsegment").select("c_custkey")


@query("""
    SELECT event_id FROM events
    WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL AND value IS NOT NULL AND abs(value) > 0.5
""")
def numeric_and_complete(spark, d):
    """F10, F11."""
    told = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    good = filters.all_numeric(["k", "value"]) & filters.complete(["value"], zero_is_missing=True, tolerance=0.5)
    return told.where(good).select("event_id")


@query("""
    SELECT o_orderkey FROM orders WHERE NOT contains(lower(coalesce(o_orderpriority, '')), 'high')
    AND CAST(o_orderdate AS DATE) + 30 >= DATE '1995-03-01' AND CAST(o_orderdate AS DATE) <= DATE '1995-06-30'
""")
def overlapping_intervals(spark, d):
    """F12, F13."""
    day = F.to_date("o_orderdate")
    told = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", day.alias("start"), F.date_add(day, 30).alias("end"))
    lo, hi = (F.to_date(F.lit(x)) for x in ("1995-03-01", "1995-06-30"))
    asked = filters.without_text("o_orderpriority", "High") & filters.overlapping("start", "end", lo, hi)
    return told.where(asked).select("o_orderkey")


@query(f"""
    WITH {OBS}, k AS (SELECT sample FROM obs GROUP BY 1 HAVING count(DISTINCT taxon) >= 20)
    SELECT sample, count(*) AS n FROM obs WHERE sample IN (SELECT sample FROM k) GROUP BY 1
""")
def large_groups(spark, d):
    """F16."""
    return filters.large_groups(observations(spark, d), "sample", "taxon", 20).groupBy("sample").agg(F.count("*").alias("n"))


@query("""
    WITH t AS (
        SELECT 'large' AS trait, avg((p_size > 25)::INT) AS m FROM part
        UNION ALL SELECT 'rare', avg((p_size = 50)::INT) FROM part
        UNION ALL SELECT 'priced', avg((p_retailprice > 0)::INT) FROM part
    ) SELECT trait FROM t WHERE m > 0.05 AND m < 0.95
""")
def informative_traits(spark, d):
    """F17."""
    made = {"large": F.col("p_size") > 25, "rare": F.col("p_size") == 50, "priced": F.col("p_retailprice") > 0}
    told = table(spark, d, "part").select(*(c.cast("int").alias(name) for name, c in made.items()))
    return spark.createDataFrame([(t,) for t in filters.informative_traits(told, list(made))], "trait string")


@query("""
    SELECT factor FROM (
        SELECT 'l_returnflag' AS factor, count(DISTINCT l_returnflag) AS n FROM lineitem
        UNION ALL SELECT 'one', 1 UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem
    ) WHERE n > 1
""")
def varying_factors(spark, d):
    """F19."""
    told = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.lit("x").alias("one"))
    return spark.createDataFrame([(f,) for f in filters.varying(told, ["l_returnflag", "one", "l_linestatus"])], "factor string")


@query("""
    SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3
""")
def merge_on_shared(spark, d):
    """J3."""
    nation = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return tables.merge_on_shared(table(spark, d, "customer"), nation, ["c_nationkey", "year"]).select("c_custkey", "n_name")


@query("""
    SELECT k, n_pairs FROM (
        SELECT a.k, count(*) AS n_pairs FROM (SELECT nullif(c_nationkey % 3, 0) AS k FROM customer) a
        JOIN (SELECT nullif(s_nationkey % 3, 0) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k)
""")
def null_keys_match(spark, d):
    """Null keys are a group and may match; a key that repeats on both sides gives all pairs."""
    a = table(spark, d, "customer").select(F.nullif(F.col("c_nationkey") % 3, F.lit(0)).alias("k"))
    b = table(spark, d, "supplier").select(F.nullif(F.col("s_nationkey") % 3, F.lit(0)).alias("k"))
    # counted by key before they meet, so that the pairs themselves are never made
    counted = tables.merge(a.groupBy("k").count(), b.groupBy("k").count(), ["k"], nulls_match=True)
    return counted.select("k", (F.col("count") * F.col("count_y")).alias("n_pairs"))


@query("""
    SELECT s_suppkey AS id, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS balance
    FROM supplier JOIN customer ON s_suppkey = c_custkey
""")
def coalesced_columns(spark, d):
    """P23."""
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    other = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return tables.coalesced(tables.merge(own, other, ["id"]))


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def only_listed_keys(spark, d):
    """J11, U3, U5, U6."""
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return tables.only_in(table(spark, d, "customer"), rich, "c_nationkey").select("c_custkey")


@query("""
    WITH a AS (SELECT s_nationkey AS nation, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
    b AS (SELECT c_nationkey AS nation, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
    SELECT a.nation, a.id, b.id AS id_y FROM a JOIN b ON a.nation = b.nation AND a.k = b.k
""")
def bound_columns(spark, d):
    """J17."""
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    return tables.by_position(a, b, "id", ["nation"]).select("nation", "id", "id_y")


@query(f"""
    WITH {SERIES}, n AS (
        SELECT kind, day, lag(value) OVER w AS before, lead(value) OVER w AS after FROM series WINDOW w AS (PARTITION BY kind ORDER BY day)
    ) SELECT kind, CAST(day AS VARCHAR) AS day, round((coalesce(before, after) + coalesce(after, before)) / 2, 5) AS between FROM n
""")
def neighbours_in_time(spark, d):
    """J18."""
    got = tables.neighbours(series(spark, d), ["kind"], "day", "value")
    return got.select("kind", F.col("day").cast("string").alias("day"), F.round("between", 5).alias("between"))


@query(f"""
    WITH {OBS} SELECT site, round(avg(density), 6) AS mean, round(stddev_samp(density), 6) AS sd, min(density) AS min,
    max(density) AS max, count(density) AS n FROM obs GROUP BY 1
""")
def described_values(spark, d):
    """A1, A2, A10, A22."""
    return rounded(aggregates.described(observations(spark, d), ["site"], "density"))


@query(f"""
    WITH {OBS} SELECT site, year, round(avg(density), 6) AS density, round(avg(biovolume), 4) AS biovolume FROM obs
    WHERE site IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2
""")
def aggregates_by_roles(spark, d):
    """A6."""
    got = aggregates.by_roles(observations(spark, d).select("site", "year", "density", "biovolume"), {"site": "A", "year": "F"})
    return got.select("site", "year", F.round("density", 6).alias("density"), F.round("biovolume", 4).alias("biovolume"))


@query("""
    SELECT l_orderkey AS ord, round(sum(l_quantity), 4) AS quantity, min(o_custkey) AS customer
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def constant_columns(spark, d):
    """Of the other columns those that are constant inside each key are kept."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("supplier"))
    told = line.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("customer")), "ord")
    return rounded(aggregates.with_constants(told, ["ord"], ["quantity"]), 4)


@query(f"""
    WITH {OBS}, t AS (SELECT sample, taxon, sum(density) AS v FROM obs GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, taxon) AS nth FROM t)
    SELECT taxon, count(*) AS n_pairs FROM r WHERE nth <= 5 GROUP BY 1
""")
def top_five_counts(spark, d):
    """A23."""
    totals = observations(spark, d).groupBy("sample", "taxon").agg(F.sum("density").alias("v"))
    ranked = windows.top_n(totals, ["sample"], [F.desc("v"), F.col("taxon")], 10)
    return aggregates.top_pairs(ranked, "nth", "taxon", 5)


@query(f"""
    WITH {OBS} SELECT site, count(*) AS n_rows, count(taxon) AS with_taxon, count(phylum) AS with_phylum,
    count(DISTINCT taxon) AS distinct_taxon, count(DISTINCT phylum) AS distinct_phylum FROM obs GROUP BY 1
""")
def taxonomic_coverage(spark, d):
    """A24, A25."""
    return aggregates.coverage(observations(spark, d), ["site"], ["taxon", "phylum"])


@query(f"""
    WITH {OBS}, m AS (SELECT site, avg(density) AS m FROM obs GROUP BY 1)
    SELECT a.site AS i, b.site AS j, round(abs(a.m - b.m), 6) AS d FROM m a CROSS JOIN m b
""")
def square_distances(spark, d):
    """Pairs of sites once, then mirrored."""
    means = observations(spark, d).groupBy("site").agg(F.avg("density").alias("m"))
    pairs = tables.site_pairs(means, "site").join(means.select(F.col("site").alias("i"), F.col("m").alias("mi")), "i")
    pairs = pairs.join(means.select(F.col("site").alias("j"), F.col("m").alias("mj")), "j")
    return rounded(tables.mirrored(pairs.withColumn("d", F.abs(F.col("mi") - F.col("mj")))))


@query(f"""
    WITH {OBS}, m AS (SELECT year, avg(density) AS density, avg(tax) AS tax FROM obs WHERE year BETWEEN 1995 AND 1997 GROUP BY 1)
    SELECT 'density' AS variable, round(max(density) FILTER (year = 1995), 6) AS "1995", round(max(density) FILTER (year = 1996), 6) AS "1996",
    round(max(density) FILTER (year = 1997), 6) AS "1997" FROM m UNION ALL
    SELECT 'tax', round(max(tax) FILTER (year = 1995), 6), round(max(tax) FILTER (year = 1996), 6), round(max(tax) FILTER (year = 1997), 6) FROM m
""")
def transposed_table(spark, d):
    """R6."""
    years = [1995, 1996, 1997]
    means = observations(spark, d).where(F.col("year").isin(years)).groupBy("year").agg(F.avg("density").alias("density"), F.avg("tax").alias("tax"))
    return rounded(tables.transposed(means, "year", ["density", "tax"], years))


@query(f"""
    WITH {SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY day) AS k, max(day) OVER (PARTITION BY kind) AS e FROM series)
    SELECT kind, CAST(day AS VARCHAR) AS day FROM r WHERE k % 2 = 1 AND day > e - INTERVAL 1 YEAR
""")
def thinned_series(spark, d):
    """W20, W22."""
    kept = windows.last_years(windows.every_nth(series(spark, d), ["kind"], "day", 2), ["kind"], "day", 1)
    return kept.select("kind", F.col("day").cast("string").alias("day"))


@query(f"""
    WITH {PIXELS} SELECT a.date, a.row, a.col, round((a.value - n.value) / nullif(a.value + n.value, 0), 6) AS value FROM pixels a
    JOIN pixels n ON a.date = n.date AND a.row = n.row AND a.col = n.col WHERE a.product = 'A' AND n.product = 'N'
""")
def joined_bands(spark, d):
    """B1."""
    px = pixels(spark, d)
    bands = {name: px.where(F.col("product") == name) for name in ("A", "N")}
    return rounded(raster.algebra(bands, "(A - N) / (A + N)", ["date", "row", "col"]))


@query(f"""
    WITH {PIXELS}, q AS (SELECT year(l_shipdate) AS date, l_partkey // 50 AS row, l_partkey % 50 AS col, CAST(max(l_quantity) AS INTEGER) AS qc
        FROM lineitem GROUP BY 1, 2, 3)
    SELECT product, p.date, p.row, p.col, round(CASE WHEN (qc >> 1) & 3 IN (0, 1) THEN value END, 6) AS value
    FROM pixels p LEFT JOIN q ON p.date = q.date AND p.row = q.row AND p.col = q.col
""")
def quality_masked_raster(spark, d):
    """B3."""
    line = table(spark, d, "lineitem")
    cell = [F.year("l_shipdate").alias("date"), F.expr("l_partkey div 50").alias("row"), (F.col("l_partkey") % 50).alias("col")]
    quality = line.groupBy(*cell).agg(F.max("l_quantity").cast("int").alias("qc"))
    return rounded(raster.quality_masked(pixels(spark, d), quality, ["date", "row", "col"], 1, 2, (0, 1)))


@query(f"""
    WITH {PIXELS} SELECT s_suppkey, round(value, 6) AS sampled FROM supplier
    LEFT JOIN (SELECT * FROM pixels WHERE product = 'R' AND date = 1994) p ON row = s_suppkey % 4 AND col = s_nationkey
""")
def sampled_points(spark, d):
    """B10."""
    points = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("row"), F.col("s_nationkey").cast("long").alias("col"))
    grid = pixels(spark, d).where("product = 'R' and date = 1994")
    return rounded(raster.sampled(points, grid, ["row", "col"], "sampled").select("s_suppkey", "sampled"))


@query("""
    WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders)
    SELECT year, nth, CAST(make_date(year, 1, 1) + CAST(floor(nth * date_diff('day', make_date(year, 1, 1), make_date(year, 12, 31)) / 4.0) AS INTEGER) AS VARCHAR) AS date
    FROM y CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS nth)
""")
def dates_of_years(spark, d):
    """T1."""
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return timeseries.yearly_dates(years, "year", 5).withColumn("date", F.col("date").cast("string"))


@query("""SELECT 'sizes_' || max(p_size) || '.csv' AS file FROM part""")
def best_threshold(spark, d):
    """V2."""
    files = table(spark, d, "part").select(F.concat(F.lit("sizes_"), F.col("p_size").cast("string"), F.lit(".csv")).alias("file"))
    return classes.best_threshold(files, "file")


@query("""
    WITH m AS (SELECT min(s_acctbal) AS least FROM supplier), t AS (SELECT s_nationkey, s_suppkey, abs(s_acctbal) AS v FROM supplier)
    SELECT s.s_suppkey, round(ln(s_acctbal + CASE WHEN least <= 0 THEN abs(least) + 1e-6 ELSE 0 END), 5) AS shifted,
    round(sqrt(v / sum(v) OVER (PARTITION BY t.s_nationkey)), 6) AS hellinger
    FROM supplier s CROSS JOIN m JOIN t ON s.s_suppkey = t.s_suppkey
""")
def shifted_and_hellinger(spark, d):
    """C4, C7."""
    told = table(spark, d, "supplier").withColumn("v", F.abs("s_acctbal"))
    least = told.agg(F.min("s_acctbal").alias("least"))
    told = told.crossJoin(F.broadcast(least))  # one row
    shifted = measures.shifted_log(F.col("s_acctbal"), F.col("least"))
    return rounded(told.select("s_suppkey", F.round(shifted, 5).alias("shifted"), ordination.hellinger(told, "s_nationkey", "v").alias("hellinger")))


@query(r"""
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
    regexp_replace(regexp_replace(lower(trim(p_name || '  Spp. x')), '\s+', ' ', 'g'), '\s+(sp\.|spp\.|cf\.|aff\.).*', '') AS species,
    trim(replace(p_type, 'SMALL', 'small')) AS repaired, trim(regexp_replace(lower('  ' || p_type || '  +  cone '), '\s+', ' ', 'g')) AS shape,
    split_part(p_brand || '.' || p_size, '.', 1) AS brand, split_part(p_brand || '.' || p_size, '.', 2) AS size FROM part
""")
def texts_and_flags(spark, d):
    """C24-C26, P5, P6, P8, P14, R11."""
    part = table(spark, d, "part")
    said = F.when(F.col("p_size") % 3 == 0, "Yes").when(F.col("p_size") % 3 == 1, "no")
    key = F.concat_ws(".", "p_brand", F.col("p_size").cast("string"))
    return part.select(
        "p_partkey", text.to_flag(said).alias("flag"), text.clean_species(F.concat("p_name", F.lit("  Spp. x"))).alias("species"),
        text.repair_name(F.col("p_type"), {"SMALL": "small"}).alias("repaired"),
        text.normal_shape(F.concat(F.lit("  "), "p_type", F.lit("  +  cone "))).alias("shape"), *text.split_key(key, ["brand", "size"]),
    )


@query("""SELECT p_partkey, floor(p_retailprice * 100) / 100 AS price FROM part""")
def decimal_commas(spark, d):
    """A column of numbers such as 1.234,56."""
    cents = F.floor(F.col("p_retailprice") * 100).cast("long")
    whole, rest = F.expr("cents div 100"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    told = table(spark, d, "part").select("p_partkey", cents.alias("cents"))
    thousands = F.when(whole >= 1000, F.concat(F.expr("cents div 100000").cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    return text.decimal_column(told.select("p_partkey", F.concat(thousands, F.lit(","), rest).alias("price")), "price")


@query("""SELECT n_name AS name, n_nationkey AS nationkey, 'none' AS unit FROM nation""")
def repaired_headers(spark, d):
    """Headers cleaned, empty columns dropped, missing ones given, preferred ones first."""
    raw = table(spark, d, "nation").select(F.col("n_nationkey").alias("﻿ Nation Key"), F.col("n_name").alias("Name é"), F.lit(None).cast("string").alias("Empty"))
    told = tables.without_empty_columns(text.clean_headers(raw, ascii_only=True))
    return tables.front(tables.with_defaults(told, {"unit": "none", "name": "no"}), ["name", "other"])


@query(f"""
    WITH {OBS}, t AS (SELECT site, taxon, min(density) AS a, quantile_cont(density, 0.5) AS b, sum(biovolume) AS w FROM obs GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY w DESC, taxon) AS nth FROM t),
    p AS (SELECT x.site, CASE WHEN x.b > x.a THEN greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) / (x.b - x.a) ELSE 0 END AS o
        FROM r x JOIN r y ON x.site = y.site AND x.nth <= 2 AND y.nth <= 2 AND x.taxon <> y.taxon)
    SELECT site, round(avg(o), 6) AS overlap FROM p GROUP BY 1
""")
def top_two_overlap(spark, d):
    """The overlap of a site's two weightiest taxa."""
    told = observations(spark, d).groupBy("site", "taxon").agg(F.min("density").alias("xmin"), F.median("density").alias("xmax"), F.sum("biovolume").alias("w"))
    return rounded(niche.top_two_overlap(told, "taxon", "w", ["site"]))


@query(f"""
    WITH {OBS}, f AS (SELECT regr_slope(biovolume, density) AS a, regr_intercept(biovolume, density) AS b FROM obs)
    SELECT DISTINCT site, printf('y = %.2fx + %.2f', a, b) AS equation FROM obs CROSS JOIN f
""")
def regression_texts(spark, d):
    """Q27: one fit over all rows, told for each group."""
    return statistics.regression_text(observations(spark, d), "site", "density", "biovolume")
