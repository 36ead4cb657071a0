"""Dissimilarities between sites, from long tables (site, taxon, x).

Pairs of sites meet by an equi-join on the taxon, so that only what two sites share is multiplied; what a site has on
its own enters through its total. Number of sites squared is the size of the answer, not of an intermediate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import ratio


def _products(table: DataFrame, site: str, taxon: str, x: str) -> DataFrame:
    a = table.select(F.col(site).alias("i"), taxon, F.col(x).alias("xi")).where("xi != 0")
    b = table.select(F.col(site).alias("j"), taxon, F.col(x).alias("xj")).where("xj != 0")
    return a.join(b, taxon).where("i < j").groupBy("i", "j").agg(F.sum(F.least("xi", "xj")).alias("least"), F.sum(F.col("xi") * F.col("xj")).alias("product"))


def _with_totals(table: DataFrame, site: str, taxon: str, x: str) -> DataFrame:
    """All pairs i < j with what they share (0 if nothing) and each site's totals."""
    totals = table.groupBy(site).agg(F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("s2"))
    a = totals.select(F.col(site).alias("i"), F.col("s").alias("si"), F.col("s2").alias("si2"))
    b = totals.select(F.col(site).alias("j"), F.col("s").alias("sj"), F.col("s2").alias("sj2"))
    return a.join(b, F.col("i") < F.col("j")).join(_products(table, site, taxon, x), ["i", "j"], "left").na.fill(0.0, ["least", "product"])


def bray_curtis(table: DataFrame, site: str, taxon: str, x: str) -> DataFrame:
    """(i, j, d) for i < j; null where both sites are empty."""
    return _with_totals(table, site, taxon, x).select("i", "j", (1 - ratio(2 * F.col("least"), F.col("si") + F.col("sj"))).alias("d"))


def morisita_horn(table: DataFrame, site: str, taxon: str, x: str, empty: float | None = 0.0) -> DataFrame:
    """(i, j, similarity) for i < j; ``empty`` where a site has nothing."""
    t = _with_totals(table, site, taxon, x)
    c = ratio(2 * F.col("product"), (ratio(F.col("si2"), F.col("si") * F.col("si")) + ratio(F.col("sj2"), F.col("sj") * F.col("sj"))) * F.col("si") * F.col("sj"))
    return t.select("i", "j", (c if empty is None else F.coalesce(c, F.lit(empty))).alias("similarity"))


def by_name(table: DataFrame, site: str, taxon: str, x: str, metric: str) -> DataFrame:
    """(i, j, d) for i < j by a metric's name: braycurtis, manhattan, canberra, jaccard and sorensen (of presences), cosine
    or euclidean. Pairs meet on shared taxa; what one of them has alone comes from its totals. Null where it isn't defined."""
    own = table.where(F.col(x) != 0).groupBy(site, taxon).agg(F.sum(x).alias("x__"))
    a = own.select(F.col(site).alias("i"), taxon, F.col("x__").alias("xi"))
    b = own.select(F.col(site).alias("j"), taxon, F.col("x__").alias("xj"))
    gap = F.abs(F.col("xi") - F.col("xj"))
    shared = a.join(b, taxon).where("i < j").groupBy("i", "j").agg(F.sum(F.least("xi", "xj")).alias("least"), F.sum(F.col("xi") * F.col("xj")).alias("product"), F.count("*").alias("both"), F.sum(ratio(gap, F.col("xi") + F.col("xj"))).alias("gaps"))
    totals = own.groupBy(site).agg(F.sum("x__").alias("s__"), F.sum(F.col("x__") * F.col("x__")).alias("q__"), F.count("*").alias("n__"))
    one, two = (totals.select(F.col(site).alias(k), *(F.col(f"{c}__").alias(f"{c}{k}") for c in "sqn")) for k in "ij")
    pairs = one.join(two, F.col("i") < F.col("j")).join(shared, ["i", "j"], "left").na.fill(0, ["least", "product", "both", "gaps"])
    c = F.col
    told = {
        "braycurtis": 1 - ratio(2 * c("least"), c("si") + c("sj")), "manhattan": c("si") + c("sj") - 2 * c("least"), "canberra": c("gaps") + c("ni") + c("nj") - 2 * c("both"),
        "jaccard": 1 - ratio(c("both"), c("ni") + c("nj") - c("both")), "sorensen": 1 - ratio(2 * c("both"), c("ni") + c("nj")),
        "cosine": 1 - ratio(c("product"), F.sqrt(c("qi") * c("qj"))), "euclidean": F.sqrt(F.greatest(F.lit(0.0), c("qi") + c("qj") - 2 * c("product"))),
    }
    if metric not in told:
        raise ValueError(f"no metric {metric}")
    return pairs.select("i", "j", told[metric].cast("double").alias("d"))


def euclidean(table: DataFrame, site: str, values: Sequence[str]) -> DataFrame:
    """(i, j, d) for i < j over wide rows of one site each."""
    a = table.select(F.col(site).alias("i"), *(F.col(v).alias(f"{v}_i") for v in values))
    b = table.select(F.col(site).alias("j"), *(F.col(v).alias(f"{v}_j") for v in values))
    square = [F.pow(F.col(f"{v}_i") - F.col(f"{v}_j"), F.lit(2.0)) for v in values]
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.sqrt(sum(square[1:], square[0])).alias("d"))


def gower(table: DataFrame, site: str, values: Sequence[str]) -> DataFrame:
    """(i, j, d) for i < j: mean of absolute differences, each over its range (1 where constant)."""
    ranges = table.agg(*(F.when(F.max(v) > F.min(v), F.max(v) - F.min(v)).otherwise(F.lit(1.0)).alias(f"{v}_r") for v in values))
    a = table.select(F.col(site).alias("i"), *(F.col(v).alias(f"{v}_i") for v in values))
    b = table.select(F.col(site).alias("j"), *(F.col(v).alias(f"{v}_j") for v in values))
    gap = [F.abs(F.col(f"{v}_i") - F.col(f"{v}_j")) / F.col(f"{v}_r") for v in values]
    return a.join(b, F.col("i") < F.col("j")).crossJoin(F.broadcast(ranges)).select("i", "j", (sum(gap[1:], gap[0]) / len(values)).alias("d"))  # one row


def simper(table: DataFrame, group: str, sample: str, taxon: str, x: str, n_top: int = 20) -> DataFrame:
    """Taxa that make the difference between the means of each pair of groups, largest first, with running percent."""
    sizes = table.groupBy(group).agg(F.count_distinct(sample).alias("n"))
    means = table.groupBy(group, taxon).agg(F.sum(x).alias("sum")).join(sizes, group).select(group, taxon, (F.col("sum") / F.col("n")).alias("mean"))
    grid = sizes.select(group).crossJoin(means.select(taxon).distinct()).join(means, [group, taxon], "left").na.fill(0.0, ["mean"])
    a = grid.select(F.col(group).alias("group1"), taxon, F.col("mean").alias("mean1"))
    b = grid.select(F.col(group).alias("group2"), taxon, F.col("mean").alias("mean2"))
    pair = Window.partitionBy("group1", "group2")
    down = pair.orderBy(F.desc("percent"), taxon)
    told = a.join(b, taxon).where("group1 < group2").withColumn("abs_diff", F.abs(F.col("mean1") - F.col("mean2")))
    told = told.withColumn("percent", 100 * ratio(F.col("abs_diff"), F.sum("abs_diff").over(pair))).where("percent is not null")
    told = told.withColumn("cumulative", F.sum("percent").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(down))
    return told.where(F.col("nth") <= n_top)


def simper_summary(ranked: DataFrame, most: int = 5) -> DataFrame:
    """What the first ``most`` taxa of each pair explain together, over all pairs."""
    pairs = ranked.where(F.col("nth") <= most).groupBy("group1", "group2").agg(F.max("cumulative").alias("top"))
    return pairs.agg(F.avg("top").alias("mean"), F.median("top").alias("median"), F.min("top").alias("min"), F.max("top").alias("max"))


#: More sites than these are refused: each task holds their labels for every permutation, a byte for each.
MOST_SITES = 100_000


@dataclass
class Design:
    """Sites by number and their groups; ``codes`` is -1 for sites that have no part in it."""

    name: str
    groups: list
    codes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.codes >= 0], minlength=len(self.groups))


def permuted(codes: np.ndarray, n_perm: int, seed: int) -> np.ndarray:
    """A row for each permutation: the codes as given first, then shuffled among the sites that take part."""
    own = np.flatnonzero(codes >= 0)
    told = np.repeat(codes[None], n_perm + 1, axis=0).astype(np.int16)
    rng = np.random.default_rng(seed)
    for row in told[1:]:
        row[own] = rng.permutation(codes[own])
    return told


def _numbered(groups: DataFrame) -> tuple[DataFrame, list, np.ndarray]:
    """(site, number) of the sites, the groups' names in order, and each site's group by number."""
    rows = groups.select("site", "grp").where("grp IS NOT NULL").orderBy("site").limit(MOST_SITES + 1).collect()
    if len(rows) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites; aggregate them first")
    names = sorted({r["grp"] for r in rows})
    at = {g: k for k, g in enumerate(names)}
    schema = groups.select("site").schema.add("number", "integer")
    return groups.sparkSession.createDataFrame([(r["site"], k) for k, r in enumerate(rows)], schema), names, np.array([at[r["grp"]] for r in rows], np.int16)


def _inside(pairs: DataFrame, sites: DataFrame, designs: Sequence[Design], n_perm: int, seed: int) -> DataFrame:
    """(design, perm, grp, sum, n, all_sum, all_squares, all_n): distances within each group under each permutation, and over
    all of a design's pairs.

    One pass: a task makes the permutations itself from the seed and adds up its own pairs, so that neither pairs nor
    permutations are shuffled, only sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = [permuted(d.codes, n_perm, seed) for d in designs]
        sums, counts = ([np.zeros((n_perm + 1, len(d.groups))) for d in designs] for _ in range(2))
        every = np.zeros((len(designs), 3))
        for batch in batches:
            i, j, d = (batch.column(c).to_numpy() for c in ("a", "b", "d"))
            for k, (design, own) in enumerate(zip(designs, labels)):
                part = (design.codes[i] >= 0) & (design.codes[j] >= 0)
                x, y, z = i[part], j[part], d[part]
                every[k] += z.sum(), (z * z).sum(), len(z)
                for perm, codes in enumerate(own):
                    group = codes[x]
                    same = group == codes[y]
                    sums[k][perm] += np.bincount(group[same], z[same], len(design.groups))
                    counts[k][perm] += np.bincount(group[same], minlength=len(design.groups))
        rows = [(k, perm, g, s, c, *(every[k] if not perm and not g else (0.0, 0.0, 0.0))) for k in range(len(designs)) for perm in range(n_perm + 1) for g, (s, c) in enumerate(zip(sums[k][perm], counts[k][perm]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 5))], names)

    names = ["design", "perm", "grp", "sum", "n", "all_sum", "all_squares", "all_n"]
    a, b = sites.withColumnsRenamed({"site": "i", "number": "a"}), sites.withColumnsRenamed({"site": "j", "number": "b"})
    told = pairs.join(a, "i").join(b, "j").select("a", "b", F.col("d").cast("double").alias("d"))
    made = told.mapInArrow(run, "design int, perm int, grp int, sum double, n double, all_sum double, all_squares double, all_n double")
    return made.groupBy("design", "perm", "grp").agg(*(F.sum(c).alias(c) for c in names[3:]))


def _analysed(pairs: DataFrame, sites: DataFrame, designs: Sequence[Design], n_perm: int, seed: int) -> list[tuple[str, float, float]]:
    """(design, F, p). Squares are of deviations of distances from their mean; the square matrix holds each pair twice and
    a zero diagonal, and its half is summed; the within-group mean square of the labels as given also stands in the
    permutations."""
    told = _inside(pairs, sites, designs, n_perm, seed).collect()  # sums by permutation and group
    out = []
    for k, design in enumerate(designs):
        sums, counts, every = np.zeros((n_perm + 1, len(design.groups))), np.zeros((n_perm + 1, len(design.groups))), np.zeros(3)
        for r in told:
            if r["design"] == k:
                sums[r["perm"], r["grp"]], counts[r["perm"], r["grp"]] = r["sum"], r["n"]
                every += r["all_sum"], r["all_squares"], r["all_n"]
        size, n = design.counts, int(design.counts.sum())
        if not every[2] or n <= len(size):
            out.append((design.name, math.nan, math.nan))
            continue
        grand = every[0] / every[2]
        means = np.divide(sums, counts, out=np.full_like(sums, grand), where=counts > 0)
        between = (np.where((size > 1) & (counts > 0), size, 0) * (means - grand) ** 2).sum(axis=1)
        total = every[1] - every[0] * grand + n * grand**2 / 2
        f = between / (len(size) - 1) / ((total - between[0]) / (n - len(size)))
        out.append((design.name, float(f[0]), float(((f[1:] >= f[0] - 1e-12).sum() + 1) / (n_perm + 1))))
    return out


def permanova(pairs: DataFrame, groups: DataFrame, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """f and p of groups of sites over a distance table (i, j, d), as the workflow defines them. ``groups`` has (site, grp)."""
    sites, names, codes = _numbered(groups)
    rows = _analysed(pairs, sites, [Design("all", names, codes)], n_perm, seed) if len(names) > 1 else []
    return pairs.sparkSession.createDataFrame([r[1:] for r in rows], "f double, p double")


def pairwise_permanova(pairs: DataFrame, groups: DataFrame, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """(group1, group2, f, p, p_adjusted) of each two groups alone, all in one pass; p times the number of pairs, at most 1."""
    sites, names, codes = _numbered(groups)
    two = list(combinations(range(len(names)), 2))
    designs = [Design("", [names[a], names[b]], np.where(codes == a, 0, np.where(codes == b, 1, -1)).astype(np.int16)) for a, b in two]
    rows = _analysed(pairs, sites, designs, n_perm, seed) if designs else []
    told = [(str(names[a]), str(names[b]), f, p, min(1.0, p * len(two))) for (a, b), (_, f, p) in zip(two, rows)]
    return pairs.sparkSession.createDataFrame(told, "group1 string, group2 string, f double, p double, p_adjusted double")


def permdisp(pairs: DataFrame, groups: DataFrame, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """Variance of the groups' mean distances (diagonal included), and how often a permutation reaches it."""
    sites, names, codes = _numbered(groups)
    size = np.bincount(codes, minlength=len(names))
    means = np.zeros((n_perm + 1, len(names)))
    for r in _inside(pairs, sites, [Design("all", names, codes)], n_perm, seed).collect():
        means[r["perm"], r["grp"]] = 2 * r["sum"] / size[r["grp"]] ** 2
    v = means.var(axis=1)
    p = ((v[1:] >= v[0] - 1e-15).sum() + 1) / (n_perm + 1)
    return pairs.sparkSession.createDataFrame([(float(v[0]), float(p))] if len(names) else [], "dispersion double, p double")


def _permuted(sites: DataFrame, n_perm: int) -> DataFrame:
    """(perm, site, grp): labels as given for perm 0, shuffled by a hash for the others."""
    perms = sites.sparkSession.range(n_perm + 1).withColumnRenamed("id", "perm")
    every = perms.crossJoin(F.broadcast(sites)) if sites.count() < MOST_SITES else perms.crossJoin(sites)
    by_site, by_hash = Window.partitionBy("perm").orderBy("site"), Window.partitionBy("perm").orderBy(F.when(F.col("perm") == 0, 0).otherwise(F.xxhash64("site", "perm")), "site")
    told = every.select("perm", "site", "grp", F.row_number().over(by_site).alias("place"), F.row_number().over(by_hash).alias("drawn"))
    return told.select("perm", "site", F.col("drawn").alias("nth")).join(told.select("perm", F.col("place").alias("nth"), "grp"), ["perm", "nth"]).select("perm", "site", "grp")


def mantel(first: DataFrame, second: DataFrame, n_perm: int = 999) -> DataFrame:
    """Pearson correlation of two distance tables and how often a permutation of sites reaches it (two-sided)."""
    ids = first.select(F.col("i").alias("site")).union(first.select("j")).distinct()
    names = _permuted(ids.withColumn("grp", F.col("site")), n_perm)
    both = second.select("i", "j", F.col("d").alias("e")).union(second.select("j", "i", F.col("d")))
    a, b = names.select("perm", F.col("site").alias("i"), F.col("grp").alias("pi")), names.select("perm", F.col("site").alias("j"), F.col("grp").alias("pj"))
    moved = first.join(a, "i").join(b, ["perm", "j"]).select("perm", "d", "pi", "pj")
    told = moved.join(both.select(F.col("i").alias("pi"), F.col("j").alias("pj"), "e"), ["pi", "pj"]).groupBy("perm").agg(F.corr("d", "e").alias("r"))
    seen = told.where("perm = 0").select(F.col("r").alias("r0"))
    return told.where("perm > 0").crossJoin(F.broadcast(seen)).agg(F.first("r0").alias("r"), ((F.count_if(F.abs("r") >= F.abs("r0") - 1e-12) + 1) / F.lit(n_perm + 1.0)).alias("p"))


def distance_correlation(pairs: DataFrame, table: DataFrame, site: str, variables: Sequence[str]) -> DataFrame:
    """(variable, r, n): correlation of a distance table with the absolute differences of each variable."""
    long = table.unpivot([site], [F.col(v).cast("double").alias(v) for v in variables], "variable", "v")
    a = long.select(F.col(site).alias("i"), "variable", F.col("v").alias("vi"))
    b = long.select(F.col(site).alias("j"), "variable", F.col("v").alias("vj"))
    told = pairs.join(a, "i").join(b, ["j", "variable"]).withColumn("gap", F.abs(F.col("vi") - F.col("vj")))
    return told.groupBy("variable").agg(F.corr("d", "gap").alias("r"), F.count("gap").alias("n"))
