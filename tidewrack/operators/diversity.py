"""Diversity indices of communities, from long tables (site, taxon, value).

A site's sum over taxa is made first, then all its indices in one grouped aggregate: two shuffles, both combined
before they move, whatever the number of taxa or sites. Two definition sets share their names: ``classic`` and
``dense``; the latter needs the number of taxa in the whole table, zeros included.

Defined results: null values add nothing; taxa of zero abundance don't count; where a formula divides by zero or takes
the logarithm of zero the index is null; a null site is a site of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import ratio, safe_log

CLASSIC = (
    "richness", "shannon", "shannon_eq", "simpson", "simpson_eq", "menhinick", "margalef", "gleason",
    "mcintosh", "hurlbert", "pielou", "sheldon", "ludwig_reynolds", "berger_parker", "mcnaughton", "hulburt",
)


def community(df: DataFrame, sites: Sequence[str], taxon: str, value: str) -> DataFrame:
    """(sites..., taxon, x): abundance of each taxon at each site."""
    return df.groupBy(*sites, taxon).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("x"))


def moments(table: DataFrame, sites: Sequence[str]) -> DataFrame:
    """What the indices need of each site: s, s2 (of squares), xlnx, n (taxa above zero) and the two largest values."""
    x = F.col("x")
    up = F.when(x > 0, x)
    top = F.slice(F.sort_array(F.collect_list(up), asc=False), 1, 2)
    return table.groupBy(*sites).agg(
        F.sum("x").alias("s"), F.sum(x * x).alias("s2"), F.sum(up * F.ln(up)).alias("xlnx"),
        F.count(up).alias("n"), top.alias("top"),
    )


def _shared() -> dict[str, Column]:
    s, n = F.col("s"), F.col("n").cast("double")
    p2 = ratio(F.col("s2"), s * s)
    return {"s": s, "n": n, "p2": p2, "h": F.when(s > 0, F.ln(F.when(s > 0, s)) - F.coalesce("xlnx", F.lit(0.0)) / F.when(s > 0, s)), "one": F.get("top", F.lit(0)), "two": F.get("top", F.lit(1))}


def classic_indices(df: DataFrame, sites: Sequence[str], taxon: str, value: str) -> DataFrame:
    """The sixteen indices of ``CLASSIC`` for each site, in their usual form."""
    c = _shared()
    s, n, p2, h = c["s"], c["n"], c["p2"], c["h"]
    root2 = F.sqrt("s2")
    found = {
        "richness": F.col("n"),
        "shannon": h,
        "shannon_eq": F.exp(h),
        "simpson": 1 - p2,
        "simpson_eq": F.when(1 - p2 > 0, ratio(F.lit(1.0), 1 - p2)),
        "menhinick": F.when(s > 0, ratio(n, F.sqrt(F.when(s > 0, s)))),
        "margalef": F.when(n > 1, ratio(n - 1, safe_log(s))),
        "gleason": ratio(n, safe_log(s)),
        "mcintosh": F.when(s > 0, ratio(s + root2, s + F.sqrt(F.when(s > 0, s)))),
        "hurlbert": F.when(n > 1, ratio(n, n - 1) * (1 - p2)),
        "pielou": F.when(n > 1, ratio(h, safe_log(n))),
        "sheldon": ratio(F.exp(h), n),
        "ludwig_reynolds": F.when(n > 1, ratio(F.exp(h) - 1, n - 1)),
        "berger_parker": ratio(c["one"], s),
        "mcnaughton": F.when(n >= 2, ratio(c["one"] + c["two"], s)),
        "hulburt": F.when(n >= 2, 100 * ratio(c["one"] + c["two"], s)),
    }
    return moments(community(df, sites, taxon, value), sites).select(*sites, *(e.alias(k) for k, e in found.items()))


def dense_indices(df: DataFrame, sites: Sequence[str], taxon: str, value: str) -> DataFrame:
    """The sixteen indices in the variant that counts against all taxa of the table."""
    table = community(df, sites, taxon, value)
    every = table.agg(F.count_distinct(taxon).cast("double").alias("t"))
    c = _shared()
    s, n, p2, h, t = c["s"], c["n"], c["p2"], c["h"], F.col("t")
    found = {
        "richness": F.col("n"),
        "shannon": h,
        "shannon_eq": ratio(h, safe_log(t)),
        "simpson": 1 - p2,
        "simpson_eq": ratio(F.lit(1.0), p2),
        "menhinick": F.when(s > 0, ratio(n, F.sqrt(F.when(s > 0, s)))),
        "margalef": F.when(s > 1, ratio(n - 1, safe_log(s))),
        "gleason": F.when(n > 1, (n - 1) / F.ln(F.lit(10.0))),
        "mcintosh": ratio(F.sqrt("s2"), s),
        "hurlbert": F.when(s > 1, ratio(s, s - 1) * (1 - p2)),
        "pielou": F.when(n > 1, ratio(h, safe_log(n))),
        "sheldon": ratio(n, t),
        "ludwig_reynolds": ratio(p2, safe_log(t)),
        "berger_parker": ratio(c["one"], s),
        "mcnaughton": F.when(n >= 2, ratio(c["one"] + c["two"], s)),
        "hulburt": 1 - p2,
    }
    both = moments(table, sites).crossJoin(F.broadcast(every))  # one row
    return both.select(*sites, *(e.alias(k) for k, e in found.items()))


def taxa_percentages(df: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Distinct names of each level per key, and the share of rows named down to the last level, in percent."""
    counted = [F.count_distinct(level).alias(f"n_{level}") for level in levels]
    return df.groupBy(*keys).agg(*counted, (100 * ratio(F.count(levels[-1]), F.count("*"))).alias("identified_percent"))


def rarefaction(df: DataFrame, sites: Sequence[str], taxon: str, value: str, points: int = 100, depth: int = 5000) -> DataFrame:
    """(sites..., depth, expected): taxa expected in so many individuals drawn without return, at up to ``points`` depths.

    Counts are whole numbers; the depth ends at the smallest site's count or ``depth``. ln C(N - x, d) - ln C(N, d) is
    a difference of sums of logarithms, read from one table of ln n! that is as long as the largest count needs.
    """
    table = community(df, sites, taxon, value).withColumn("x", F.floor("x").cast("long")).where("x > 0")
    total = table.withColumn("all", F.sum("x").over(Window.partitionBy(*sites)))
    most = total.groupBy(*sites).agg(F.first("all").alias("all")).agg(F.least(F.min("all"), F.lit(depth)).alias("d"))
    step = F.greatest(F.floor(F.col("d") / points).cast("long"), F.lit(1))
    depths = most.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("d"), step)).alias("depth"))
    lf = _ln_factorial
    missed = F.when(F.col("all") - F.col("x") >= F.col("depth"), F.exp(lf(F.col("all") - F.col("x")) + lf(F.col("all") - F.col("depth")) - lf(F.col("all") - F.col("x") - F.col("depth")) - lf(F.col("all")))).otherwise(0.0)
    return total.crossJoin(F.broadcast(depths)).groupBy(*sites, "depth").agg(F.sum(1 - missed).alias("expected"))  # at most ``points`` + 1 rows


def mean_curves(curves: DataFrame, treatment: Sequence[str]) -> DataFrame:
    """(treatment..., depth, expected, sd, n): mean of the sites' curves at each depth; sd is 0 for one site."""
    return curves.groupBy(*treatment, "depth").agg(F.avg("expected").alias("expected"), F.coalesce(F.stddev_samp("expected"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after a shift by 8, exact to about 1e-12."""
    x = n.cast("double") + 9.0
    inner = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046728 + inner
    shift = F.lit(0.0)
    for k in range(1, 9):
        shift = shift + F.ln(n.cast("double") + k)
    return series - shift


def rao_fdis(weights: DataFrame, traits: DataFrame, sites: Sequence[str], taxon: str, names: Sequence[str]) -> DataFrame:
    """(sites..., richness, rao_q, fdis): functional diversity from shares and traits.

    ``weights`` has (sites..., taxon, x), ``traits`` (taxon, names...). Rao's Q sums share * share * Gower distance over
    pairs of a site's taxa; FDis is the mean distance to the weighted centre.
    """
    ranges = traits.agg(*(F.when(F.max(c) > F.min(c), F.max(c) - F.min(c)).otherwise(1.0).alias(f"{c}__r") for c in names))
    own = Window.partitionBy(*sites)
    shares = weights.where("x > 0").withColumn("p", F.col("x") / F.sum("x").over(own))
    here = shares.join(traits, taxon).select(*sites, taxon, "p", *names)
    gaps = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) / F.col(f"{c}__r") for c in names]
    same = F.lit(True)
    for k in sites:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    pairs = here.alias("a").join(here.alias("b"), same).crossJoin(F.broadcast(ranges))
    rao = pairs.groupBy(*(F.col(f"a.{k}").alias(k) for k in sites)).agg(F.sum(F.col("a.p") * F.col("b.p") * sum(gaps[1:], gaps[0]) / len(names)).alias("rao_q"))
    centred = here.select("*", *((F.sum(F.col("p") * F.col(c)).over(own) / F.sum("p").over(own)).alias(f"{c}__c") for c in names))
    square = [F.pow(F.col(c) - F.col(f"{c}__c"), F.lit(2)) for c in names]
    fdis = centred.groupBy(*sites).agg(F.count("*").alias("richness"), F.sum(F.col("p") * F.sqrt(sum(square[1:], square[0]))).alias("fdis"))
    return fdis.join(rao, list(sites))


def redundancy(indices: DataFrame, group: Sequence[str]) -> DataFrame:
    """``indices`` with redundancy: richness less Rao's Q, both scaled to 0..1 within the group."""
    w = Window.partitionBy(*group)
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
    return indices.withColumn("redundancy", scaled("richness") - scaled("rao_q"))
