"""Joins, reshaping, sets and order of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import ratio


def null_safe(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    """Equality of all keys under the aliases, null equal to null."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", nulls_match: bool = False) -> DataFrame:
    """An equi-join on keys that both tables have; other columns of the right one get ``_y`` where names clash.

    Unlike in SQL, null keys may match each other.
    """
    for side, df in (("left", left), ("right", right)):
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise ValueError(f"the {side} table has no column {', '.join(missing)}")
    clash = {c: f"{c}_y" for c in right.columns if c in left.columns and c not in keys}
    right = right.withColumnsRenamed(clash)
    if not nulls_match:
        return left.join(right, list(keys), how)
    told = left.alias("l").join(right.alias("r"), null_safe(keys), how)
    return told.select(*(F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys), *(F.col(f"l.{c}") for c in left.columns if c not in keys), *(F.col(f"r.{c}") for c in right.columns if c not in keys))


def merge_on_shared(left: DataFrame, right: DataFrame, wanted: Sequence[str], how: str = "left") -> DataFrame:
    """Joins on those of the wanted keys that both tables have."""
    keys = [k for k in wanted if k in left.columns and k in right.columns]
    if not keys:
        raise ValueError("the tables share none of the keys")
    return merge(left, right, keys, how)


def coalesced(df: DataFrame, suffix: str = "_y") -> DataFrame:
    """Each pair of columns x and x_y as one, the first value that isn't null."""
    pairs = [c for c in df.columns if f"{c}{suffix}" in df.columns]
    return df.withColumns({c: F.coalesce(c, f"{c}{suffix}") for c in pairs}).drop(*(f"{c}{suffix}" for c in pairs))


def only_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def not_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the keys; a null key is not."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def site_pairs(table: DataFrame, site: str, *columns: str) -> DataFrame:
    """Unordered pairs i < j of sites that share a taxon row: joined by the callers on their own keys."""
    return table.select(F.col(site).alias("i"), *columns).join(table.select(F.col(site).alias("j")), F.col("i") < F.col("j"))


def by_position(left: DataFrame, right: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """Joins the n-th rows of both tables inside each key."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return left.withColumn("position", number).join(right.withColumn("position", number).withColumnsRenamed({c: f"{c}_y" for c in right.columns if c not in keys}), [*keys, "position"])


def neighbours(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The values before and after in time, and the mean of those there are."""
    w = Window.partitionBy(*keys).orderBy(order)
    told = df.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))
    return told.withColumn("between", (F.coalesce("before", "after") + F.coalesce("after", "before")) / 2)


def wide(df: DataFrame, rows: Sequence[str], column: str, value: str, names: Sequence[str], how: str = "sum", fill: float | None = 0.0) -> DataFrame:
    """Long to wide; the names of the new columns are given, so that no pass over the rows has to find them."""
    made = df.groupBy(*rows).pivot(column, list(names)).agg(getattr(F, how)(value))
    return made if fill is None else made.na.fill(fill, list(map(str, names)))


def dense(df: DataFrame, site: Sequence[str], taxon: str, value: str) -> DataFrame:
    """Every site with every taxon, zero where there is no row. Taxa are few beside rows; sites keep their partitioning."""
    table = df.groupBy(*site, taxon).agg(F.sum(value).alias(value))
    grid = table.select(*site).distinct().crossJoin(table.select(taxon).distinct())
    return grid.join(table, [*site, taxon], "left").na.fill(0.0, [value])


def long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [F.col(v).cast("double").alias(v) for v in values], name, value)


def transposed(df: DataFrame, key: str, columns: Sequence[str], names: Sequence) -> DataFrame:
    """A row for each of the columns, and a column for each of the key's values, which are given."""
    return wide(long(df, [key], columns), ["variable"], key, "value", names, how="max", fill=None)


def mirrored(pairs: DataFrame, zero: bool = True) -> DataFrame:
    """A square distance table (i, j, d) from its half."""
    both = pairs.select("i", "j", "d").union(pairs.select("j", "i", "d"))
    if not zero:
        return both
    ids = pairs.select("i").union(pairs.select("j")).distinct()
    return both.union(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d")))


def stacked(*tables: DataFrame, distinct: bool = False) -> DataFrame:
    """All rows of tables with ragged columns, missing ones null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.distinct() if distinct else out


def ordered_by_list(c: str, order: Sequence[str]) -> Column:
    """A sort key by a custom order, values outside it last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(c))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def natural(c: str) -> Column:
    """A sort key that orders runs of digits by value."""
    return F.regexp_replace(F.regexp_replace(F.col(c), r"(\d+)", "000000000000$1"), r"0*(\d{12})(?!\d)", "$1")


def top_by_total(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n keys with the largest totals; the smaller key first among equals."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(n)


def percent_of_total(df: DataFrame, keys: Sequence[str], parts: Sequence[str], value: str) -> DataFrame:
    """Totals by key and part, and their percent of the key."""
    told = df.groupBy(*keys, *parts).agg(F.sum(value).alias("total"))
    return told.withColumn("percent", 100 * ratio(F.col("total"), F.sum("total").over(Window.partitionBy(*keys))))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Columns that are missing, with a default value."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns}) if set(defaults) - set(df.columns) else df


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Columns that hold a value anywhere."""
    row = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if row[c]))


def front(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that there are first, then all others."""
    return df.select(*(c for c in names if c in df.columns), *(c for c in df.columns if c not in names))


def interactions(names: Sequence[str]) -> list[Column]:
    """Products of all pairs."""
    return [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]


def powers(names: Sequence[str], degree: int) -> list[Column]:
    return [F.pow(F.col(c), F.lit(float(d))).alias(f"{c}_{d}") for c in names for d in range(2, degree + 1)]


def one_hot(c: str, levels: Sequence[str]) -> list[Column]:
    """0/1 columns for all levels but the first."""
    return [F.when(F.col(c) == level, 1).otherwise(0).alias(f"{c}_{level}") for level in levels[1:]]


def matched_by_part(files: DataFrame, name: str, others: DataFrame, other: str, pattern: str, must_contain: str = "") -> DataFrame:
    """(name, other): for each name the first other, in order, that has the same part (the pattern's first group) and
    contains a text; null where none does. Parts are taken out of both, so that names meet by an equi-join."""
    part = lambda c: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    found = others.where(F.col(other).contains(must_contain)).groupBy(part(other).alias("part__")).agg(F.min(other).alias(other))
    return files.select(name, part(name).alias("part__")).join(found, "part__", "left").select(name, other)
