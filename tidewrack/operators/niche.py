"""Niches of taxa along an axis: response curves, optimum and tolerance, overlap of intervals, null models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import ratio
from tidewrack.lineage import settled



def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float, float]:
    """Coefficients of ln E[y] = a + b x + c x^2, a Poisson model with weights sqrt(y + 1), by reweighted least squares."""
    w0, design = np.sqrt(y + 1), np.column_stack([np.ones_like(x), x, x * x])
    b = np.array([np.log(max(y.mean(), 1e-9)), 0.0, 0.0])
    for _ in range(rounds):
        eta = np.clip(design @ b, -30, 30)
        mu = np.exp(eta)
        w = w0 * mu
        new = np.linalg.lstsq(design * np.sqrt(w)[:, None], np.sqrt(w) * (eta + (y - mu) / mu), rcond=None)[0]
        if np.max(np.abs(new - b)) < 1e-10:
            b = new
            break
        b = new
    return float(b[0]), float(b[1]), float(b[2])


def optimum(b: float, c: float, window: float = 3.0) -> tuple[float, float, bool]:
    """Optimum -b / 2c and tolerance sqrt(-1 / 2c); whether the curve has one peak inside the window."""
    if not c < 0:
        return np.nan, np.nan, False
    top = -b / (2 * c)
    return top, float(np.sqrt(-1 / (2 * c))), bool(abs(top) <= window)


def response_curves(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 5) -> DataFrame:
    """(keys..., a, b, c, optimum, tolerance, unimodal, n) of each taxon: taxa are dealt out, a fit is one numpy call."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "a double, b double, c double, optimum double, tolerance double, unimodal boolean, n long"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[x, y]).sort_values([x, y])
        if len(pdf) < least:
            row = (*key, None, None, None, None, None, False, len(pdf))
        else:
            a, b, c = fit_curve(pdf[x].to_numpy(float), pdf[y].to_numpy(float))
            top, width, one = optimum(b, c)
            row = (*key, a, b, c, top, width, one, len(pdf))
        return pd.DataFrame([row], columns=[*keys, "a", "b", "c", "optimum", "tolerance", "unimodal", "n"])

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(run, schema)


def curve_grid(fits: DataFrame, keys: Sequence[str], lo: float = -3.0, hi: float = 3.0, step: float = 0.01) -> DataFrame:
    """(keys..., x, expected) of each curve on a grid."""
    n = round((hi - lo) / step)
    x = F.lit(lo) + F.col("k") * step
    grid = fits.where("c is not null").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return grid.select(*keys, x.alias("x"), F.exp(F.col("a") + F.col("b") * x + F.col("c") * x * x).alias("expected"))


def intervals(df: DataFrame, optimum: str, tolerance: str) -> DataFrame:
    """``df`` with xmin and xmax, half a tolerance to each side of the optimum."""
    return df.withColumn("xmin", F.col(optimum) - F.col(tolerance) / 2).withColumn("xmax", F.col(optimum) + F.col(tolerance) / 2)


def overlaps(df: DataFrame, taxon: str, keys: Sequence[str]) -> DataFrame:
    """(keys..., i, j, overlap) for ordered pairs inside a key: the part of i's interval that j shares, 0 if i has no width."""
    a = df.select(*keys, F.col(taxon).alias("i"), F.col("xmin").alias("a1"), F.col("xmax").alias("a2"))
    b = df.select(*keys, F.col(taxon).alias("j"), F.col("xmin").alias("b1"), F.col("xmax").alias("b2"))
    shared = F.greatest(F.lit(0.0), F.least("a2", "b2") - F.greatest("a1", "b1"))
    known = F.col("a1").isNotNull() & F.col("a2").isNotNull() & F.col("b1").isNotNull() & F.col("b2").isNotNull()
    value = F.when(known & (F.col("a2") > F.col("a1")), ratio(shared, F.col("a2") - F.col("a1"))).otherwise(0.0)
    return a.join(b, list(keys)).where("i != j").select(*keys, "i", "j", value.alias("overlap"))


def class_intervals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The interval that all taxa of a class span."""
    return df.groupBy(*keys).agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.count("*").alias("n_taxa"))


def top_two_overlap(df: DataFrame, taxon: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """The mean of both overlaps between the two weightiest taxa of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(weight), taxon)
    two = df.withColumn("nth", F.row_number().over(w)).where("nth <= 2")
    return overlaps(two, taxon, keys).groupBy(*keys).agg(F.avg("overlap").alias("overlap"))


def null_intervals(df: DataFrame, site: str, taxon: str, x: str, y: str, runs: int, seed: int = 0, least: int = 5) -> DataFrame:
    """(run, taxon, xmin, xmax): the interval of each taxon's curve over its values as they are (run 0) and shuffled over its
    sites. A taxon is a group, as large as its sites; taxa of fewer than ``least`` sites and curves without a top are left out."""
    community = df.groupBy(site, taxon).agg(F.first(x).cast("double").alias("x__"), F.sum(y).cast("double").alias("y__"))
    kind = df.schema[taxon].dataType.simpleString()

    def shuffle(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(site)
        xs, ys, rows = own["x__"].to_numpy(float), own["y__"].to_numpy(float), []
        if len(own) >= least:
            draw = np.random.default_rng([seed, *str(key[0]).encode()])
            for run in range(runs + 1):
                _, b, c = fit_curve(xs, draw.permutation(ys) if run else ys, 25)
                top, width, _ = optimum(b, c)
                if not np.isnan(top):
                    rows.append((run, key[0], top - width / 2, top + width / 2))
        return pd.DataFrame(rows, columns=["run", taxon, "xmin", "xmax"])

    return community.groupBy(taxon).applyInPandas(shuffle, f"run long, `{taxon}` {kind}, xmin double, xmax double")


def null_model(df: DataFrame, site: str, taxon: str, x: str, y: str, runs: int = 500, seed: int = 0) -> DataFrame:
    """One row (observed, mean, sd, ses, p_left, p_right, runs): mean overlap of the taxa's intervals against shuffles of each
    taxon's values over its sites. Taxa of a run meet by a join on the run; a run without any overlap counts as 0."""
    spans = settled(null_intervals(df, site, taxon, x, y, runs, seed))
    a = spans.select("run", F.col(taxon).alias("i"), F.col("xmin").alias("a1"), F.col("xmax").alias("a2")).where("a2 > a1")
    b = spans.select("run", F.col(taxon).alias("j"), F.col("xmin").alias("b1"), F.col("xmax").alias("b2"))
    shared = F.greatest(F.lit(0.0), F.least("a2", "b2") - F.greatest("a1", "b1")) / (F.col("a2") - F.col("a1"))
    found = a.join(b, "run").where("i != j").groupBy("run").agg(F.avg(shared).alias("overlap"))
    made = df.sparkSession.range(runs + 1).withColumnRenamed("id", "run").join(found, "run", "left").na.fill(0.0, ["overlap"])
    seen, null = F.max(F.when(F.col("run") == 0, F.col("overlap"))), F.when(F.col("run") > 0, F.col("overlap"))
    told = made.agg(seen.alias("observed"), F.avg(null).alias("mean"), F.stddev_samp(null).alias("sd"), F.sort_array(F.collect_list(null)).alias("all"))  # one number for each run
    left, right = F.size(F.filter("all", lambda v: v <= F.col("observed"))), F.size(F.filter("all", lambda v: v >= F.col("observed")))
    return told.select("observed", "mean", "sd", ratio(F.col("observed") - F.col("mean"), F.col("sd")).alias("ses"), ((left + 1) / (runs + 1)).alias("p_left"), ((right + 1) / (runs + 1)).alias("p_right"), F.size("all").alias("runs"))


def taxa_in_classes(curves: DataFrame, counts: DataFrame, taxon: str, size_class: str, density: str, least: int = 3) -> DataFrame:
    """(taxon, size_class, xmin, xmax, log_density) of taxa with an interval (optimum -/+ half a tolerance, not empty) and a
    density, in classes of at least ``least`` taxa. ``curves`` has optimum and tolerance."""
    half = F.col("tolerance") / 2
    told = curves.select(taxon, F.col(size_class).cast("string").alias(size_class), (F.col("optimum") - half).alias("xmin"), (F.col("optimum") + half).alias("xmax")).where("xmax > xmin")
    totals = counts.groupBy(taxon).agg(F.ln(F.sum(density) + 1).alias("log_density")).where(F.col("log_density").isNotNull())
    met = told.join(totals, taxon)
    large = met.groupBy(size_class).agg(F.count_distinct(taxon).alias("n__")).where(F.col("n__") >= least).select(size_class)
    return met.join(large, size_class, "left_semi").select(taxon, size_class, "xmin", "xmax", "log_density")
