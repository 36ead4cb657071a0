"""Row and column filters. Every function returns a DataFrame, or a Column where it is one predicate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.text import to_number


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def present(df: DataFrame, columns: Sequence[str], least: int | None = None) -> DataFrame:
    """Rows with all of the columns, or with ``least`` of them."""
    return df.na.drop(how="any", subset=list(columns)) if least is None else df.na.drop(thresh=least, subset=list(columns))


def rules(table: Iterable[Mapping]) -> Column:
    """A conjunction from rows of key, min, max, value; blank cells ask nothing and bounds are inclusive."""
    made = []
    for row in table:
        key = F.col(row["key"])
        if row.get("value") not in (None, ""):
            made.append(key.cast("string") == str(row["value"]))
        if row.get("min") is not None:
            made.append(key >= row["min"])
        if row.get("max") is not None:
            made.append(key <= row["max"])
    return all_of(made)


def box(lat: str, lon: str, south: float, north: float, west: float, east: float) -> Column:
    """Points inside a bounding box, edges included."""
    return F.col(lat).between(south, north) & F.col(lon).between(west, east)


def chosen_places(df: DataFrame, config: DataFrame, key: str, place: str) -> DataFrame:
    """Rows of the place that ``config`` (key, place) names for their key; keys it doesn't name keep their first place."""
    named = config.select(F.col(key).alias("named_key"), F.col(place).alias("named_place"))
    first = F.min(place).over(Window.partitionBy(key))
    joined = df.withColumn("first_place", first).join(named, F.col(key) == F.col("named_key"), "left")
    return joined.where(F.col(place) == F.coalesce("named_place", "first_place")).select(*df.columns)


def all_numeric(columns: Iterable[str]) -> Column:
    """Every column holds a finite number."""
    return all_of(to_number(F.col(c)).isNotNull() for c in columns)


def complete(columns: Iterable[str], zero_is_missing: bool = False, tolerance: float = 0.0) -> Column:
    """Every column is not null, and not zero within the tolerance if zero counts as missing."""
    return all_of(F.col(c).isNotNull() & ((F.abs(F.col(c)) > tolerance) if zero_is_missing else F.lit(True)) for c in columns)


def without_text(column: str, part: str) -> Column:
    """Rows whose text doesn't contain the part, whatever the case; null text stays."""
    return ~F.coalesce(F.contains(F.lower(F.col(column)), F.lit(part.lower())), F.lit(False))


def overlapping(start: str, end: str, lo, hi) -> Column:
    """Intervals that share a day with [lo, hi]."""
    return (F.col(end) >= F.lit(lo)) & (F.col(start) <= F.lit(hi))


def in_range(value: Column, lo: float, hi: float) -> Column:
    """The value, null outside its valid range."""
    return F.when(value.between(lo, hi), value)


def quality_bits(quality: Column, shift: int, length: int, good: Sequence[int]) -> Column:
    """Whether a bit field of a quality value is one of the good ones."""
    return F.shiftright(quality, shift).bitwiseAND(F.lit((1 << length) - 1)).isin(*good)


def large_groups(df: DataFrame, key: str, distinct: str, least: int) -> DataFrame:
    """Rows of the groups with at least so many distinct values."""
    keys = df.groupBy(key).agg(F.count_distinct(distinct).alias("n")).where(F.col("n") >= least).select(key)
    return df.join(keys, key, "left_semi")


def frequent_taxa(df: DataFrame, site: str, taxon: str, value: str, share: float) -> DataFrame:
    """Rows of the taxa above zero at that share of all sites or more."""
    sites = df.agg(F.count_distinct(site).alias("sites"))
    seen = df.groupBy(taxon).agg(F.count_distinct(F.when(F.col(value) > 0, F.col(site))).alias("n"))
    keys = seen.crossJoin(F.broadcast(sites)).where(F.col("n") >= share * F.col("sites")).select(taxon)  # one row
    return df.join(keys, taxon, "left_semi")


def informative_traits(df: DataFrame, traits: Sequence[str], least: int = 50, bounds: Sequence[tuple[float, float]] = ((0.05, 0.95), (0.01, 0.99))) -> list[str]:
    """Names of the 0/1 traits with enough values whose mean is strictly inside the first bounds that leave any."""
    row = df.agg(*(F.count(c).alias(f"n_{c}") for c in traits), *(F.avg(c).alias(f"m_{c}") for c in traits), *(F.count_if(~F.col(c).isin(0, 1)).alias(f"o_{c}") for c in traits)).first()
    binary = [c for c in traits if row[f"n_{c}"] >= least and not row[f"o_{c}"]]
    for lo, hi in bounds:
        kept = [c for c in binary if lo < row[f"m_{c}"] < hi]
        if kept:
            return kept
    return []


def varying(df: DataFrame, factors: Sequence[str]) -> list[str]:
    """Names of the factors with two levels or more."""
    row = df.agg(*(F.count_distinct(c).alias(c) for c in factors)).first()
    return [c for c in factors if row[c] > 1]


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def known_depth(depth: str, least: float = -999_999_999) -> Column:
    """Rows with a depth: any at or above the least, which null isn't."""
    return F.coalesce(F.col(depth) >= least, F.lit(False))


def convertible_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, share): of each column's values that aren't null, how many are numbers; null for a column without any."""
    names = list(df.columns if columns is None else columns)
    made = df.agg(*((F.try_divide(F.count(to_number(F.col(c).cast("string"))), F.count(c))).alias(c) for c in names)).withColumn("__", F.lit(0))
    return made.unpivot(["__"], names, "column", "share").drop("__")


def mostly_numbers(df: DataFrame, least: float = 0.5) -> list[str]:
    """Columns of which at least that share is convertible."""
    told = {r["column"]: r["share"] for r in convertible_shares(df).collect()}
    return [c for c in df.columns if told[c] is not None and told[c] >= least]
