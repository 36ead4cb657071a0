"""Grouped aggregates that a table of roles or instructions can ask for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidewrack.functions.measures import size_class
from tidewrack.operators.windows import quantiles, with_key


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in but]


def described(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, sd (sample), min, max and n of a value per key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def by_roles(df: DataFrame, roles: Mapping[str, str], present_only: bool = True) -> DataFrame:
    """Means of all numeric columns per key; keys are the columns with role A or F. Rows with a null key go, if so asked."""
    keys = [c for c, r in roles.items() if r.upper() in ("A", "F")]
    df = df.na.drop(subset=keys) if present_only else df
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in numeric_columns(df, keys)))


def by_instructions(df: DataFrame, keys: Sequence[str], instructions: Mapping[str, str], taxon: str | None = None) -> DataFrame:
    """mean or sum of each column as its instruction says (``A mean``, ``sum``), with richness if a taxon is named."""
    made = [(F.sum(c) if "sum" in how.lower() else F.avg(c)).alias(c) for c, how in instructions.items()]
    if taxon:
        made.append(F.count_distinct(taxon).alias("richness"))
    return df.groupBy(*keys).agg(*made)


def with_constants(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per key, with the first value of all other columns that are constant inside every key."""
    others = [c for c in df.columns if c not in keys and c not in sums]
    per_key = df.groupBy(*keys).agg(*(F.count_distinct(c).alias(c) for c in others))
    most = per_key.agg(*(F.max(c).alias(c) for c in others)).first() if others else {}
    constant = [c for c in others if (most[c] or 0) <= 1]
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in constant))


def histogram(df: DataFrame, keys: Sequence[str], value: str, base: float, total: str | None = None) -> DataFrame:
    """Rows (or the sum of a column) by the nearest whole logarithm of a value."""
    classed = df.withColumn("size_class", size_class(F.col(value), base)).where("size_class is not null")
    return classed.groupBy(*keys, "size_class").agg((F.sum(total) if total else F.count("*")).alias("total"))


def mode_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per key, the smallest among equals."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.v").alias(value), (-F.col("best.n")).alias("n"))


def quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact quartiles by linear interpolation, and the interquartile range."""
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    return q.select(*keys, *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"))


def mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation per key, both from dealt counts, so that no key needs one task."""
    centre = quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("median"))
    away = with_key(df.select(*keys, value), centre, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("away__"))
    return with_key(centre, quantiles(away, keys, "away__", [0.5]).select(*keys, F.col("q")[0].alias("mad")), keys)


def shape(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Skewness and (Pearson) kurtosis with the sample corrections; null below three and four values."""
    n = F.col("n").cast("double")
    got = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3)
    return got.select(*keys, "n", skew.alias("skewness"), kurt.alias("kurtosis"))


def extremes(df: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """The labels of the smallest and largest value per key, the first label among equals."""
    least, most = F.min(F.struct(value, label)), F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l")))
    return df.groupBy(*keys).agg(least.alias("lo"), most.alias("hi")).select(*keys, F.col(f"lo.{label}").alias("lowest"), F.col("hi.l").alias("highest"))


def coverage(df: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Rows, rows named at each level, and distinct names; without keys, for the whole table."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"with_{c}") for c in levels), *(F.count_distinct(c).alias(f"distinct_{c}") for c in levels))


def with_total(df: DataFrame, key: str, value: str, label: str = "All") -> DataFrame:
    """Sum and mean per key and over all, in one pass by grouping sets."""
    rolled = df.rollup(key).agg(F.grouping(key).alias("g"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))
    return rolled.select(F.when(F.col("g") == 1, label).otherwise(F.col(key).cast("string")).alias(key), "sum", "mean")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) in an order that tells rows apart."""
    by = [c.desc() if last else c.asc() for c in order]
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("nth = 1").drop("nth")


def top_pairs(df: DataFrame, rank: str, taxon: str, most: int) -> DataFrame:
    """How often each taxon is among the first ``most`` of a pair."""
    return df.where(F.col(rank) <= most).groupBy(taxon).agg(F.count("*").alias("n_pairs"))
