"""Rasters as pixel tables (product, date, row, col, value). Algebra between bands is an equi-join on the pixel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.formula import formula
from tidewrack.functions.measures import ratio
from tidewrack.operators.filters import in_range, quality_bits


def algebra(bands: Mapping[str, DataFrame], expression: str, pixel: Sequence[str], value: str = "value") -> DataFrame:
    """A formula over bands that meet on the pixel; null where it isn't finite."""
    told = None
    for name, band in bands.items():
        own = band.select(*pixel, F.col(value).alias(name))
        told = own if told is None else told.join(own, list(pixel))
    return told.select(*pixel, formula(expression, list(bands)).alias(value))


def bands_of_one(df: DataFrame, names: Sequence[str], pixel: Sequence[str], expression: str, value: str = "value") -> DataFrame:
    """The same where all bands are products of one table: one grouped pass instead of joins."""
    wide = df.groupBy(*pixel).agg(*(F.max(F.when(F.col("product") == n, F.col(value))).alias(n) for n in names))
    return wide.select(*pixel, formula(expression, names).alias(value)).where(F.col(value).isNotNull())


def scaled(df: DataFrame, products: DataFrame, value: str = "value") -> DataFrame:
    """Valid range and scale factor of each product (product, lo, hi, scale); values outside are null."""
    told = df.join(products, "product", "left")
    kept = F.when(F.col("lo").isNull() | F.col(value).between(F.col("lo"), F.col("hi")), F.col(value))
    return told.withColumn(value, kept * F.coalesce("scale", F.lit(1.0))).select(*df.columns)


def quality_masked(df: DataFrame, quality: DataFrame, pixel: Sequence[str], shift: int, length: int, good: Sequence[int], value: str = "value") -> DataFrame:
    """Values whose quality bits are good; others null. ``quality`` has the pixel and ``qc``."""
    told = df.join(quality.select(*pixel, "qc"), list(pixel), "left")
    return told.withColumn(value, F.when(quality_bits(F.col("qc"), shift, length, good), F.col(value))).select(*df.columns)


def zonal(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """mean, population sd, min, max and number of a raster's values."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def upscaled(df: DataFrame, keys: Sequence[str], factor: int = 2, value: str = "value") -> DataFrame:
    """Means of blocks of factor by factor pixels."""
    return df.groupBy(*keys, F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col")).agg(F.avg(value).alias(value))


def filled_dates(df: DataFrame, dates: DataFrame, pixel: Sequence[str], strict: bool = True, value: str = "value") -> DataFrame:
    """Rasters of missing dates: the mean of the rasters before and after (both, if strict), the nearest one at the ends.

    ``dates`` has all dates wanted; a pixel's rows meet in one place, as many as there are dates.
    """
    grid = df.select(*pixel).distinct().crossJoin(F.broadcast(dates.select("date").distinct()))  # the calendar is short
    there = grid.join(df.select(*pixel, "date", F.col(value).alias("v"), F.lit(1).alias("seen")), [*pixel, "date"], "left")
    w = Window.partitionBy(*pixel).orderBy("date")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("seen") == 1, F.struct("v"))
    told = there.select("*", F.last(seen, True).over(back).alias("b"), F.first(seen, True).over(ahead).alias("a"))
    b, a = F.col("b.v"), F.col("a.v")
    mean = (b + a) / 2 if strict else (F.coalesce(b, a) + F.coalesce(a, b)) / 2
    made = F.when(F.col("seen") == 1, F.col("v")).when(F.col("b").isNull(), a).when(F.col("a").isNull(), b).otherwise(mean)
    return told.select(*pixel, "date", made.alias(value))


def inside(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the parity of edges to its right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        spans = (y >= min(y1, y2)) & (y < max(y1, y2))
        crossings = crossings + F.when(spans & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
    return crossings % 2 == 1


def clipped(df: DataFrame, x: str, y: str, ring: Sequence[tuple[float, float]], value: str = "value", zero_is_null: bool = True) -> DataFrame:
    """Pixels inside a polygon; zeros become null."""
    kept = df.where(inside(F.col(x), F.col(y), ring))
    return kept.withColumn(value, F.nullif(F.col(value), F.lit(0.0))) if zero_is_null else kept


def grid_cell(lat: Column, lon: Column, north: float, west: float, step: float) -> tuple[Column, Column]:
    """Row and column of a point in a grid with square cells."""
    return F.floor((F.lit(north) - lat) / step).cast("long"), F.floor((lon - F.lit(west)) / step).cast("long")


def sampled(points: DataFrame, raster: DataFrame, keys: Sequence[str], name: str, value: str = "value") -> DataFrame:
    """Points with the value of their pixel; null where there is none."""
    return points.join(raster.select(*keys, F.col(value).alias(name)), list(keys), "left")


def point_statistics(points: DataFrame, raster: DataFrame, keys: Sequence[str], point: Sequence[str], products: Sequence[str]) -> DataFrame:
    """Mean, max, min and population sd of each product at each point, products as columns."""
    met = points.join(raster, list(keys))
    out = []
    for p in products:
        v = F.when(F.col("product") == p, F.col("value"))
        out += [F.avg(v).alias(f"{p}_mean"), F.max(v).alias(f"{p}_max"), F.min(v).alias(f"{p}_min"), F.stddev_pop(v).alias(f"{p}_std")]
    return met.groupBy(*point).agg(*out)


def pixel_correlation(df: DataFrame, pixel: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r, n): correlation of products over the pixels that both have."""
    names = sorted({p for pair in pairs for p in pair})
    wide = df.groupBy(*pixel).agg(*(F.max(F.when(F.col("product") == n, F.col("value"))).alias(n) for n in names))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"), F.count(F.col(a) + F.col(b)).alias("n")) for a, b in pairs]
    return wide.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def valid(df: DataFrame, lo: float, hi: float, value: str = "value") -> DataFrame:
    return df.withColumn(value, in_range(F.col(value), lo, hi))


def normalised_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)
