"""Points, polygons and grids that meet by joins on cells: nearest segments, parity of edges, weights of neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the earth in km.
RADIUS = 6371.0088
#: The finest grid has 2**FINEST cells around the equator, and at most half as many squared; each level above has half that.
FINEST = 9


def _plane(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """A place in the plane of true distances and directions from (lat0, lon0), in km."""
    f0, f, dl = F.radians(lat0), F.radians(lat), F.radians(lon - lon0)
    half = F.pow(F.sin((f - f0) / 2), F.lit(2.0)) + F.cos(f0) * F.cos(f) * F.pow(F.sin(dl / 2), F.lit(2.0))
    c = 2 * F.asin(F.sqrt(F.least(half, F.lit(1.0))))
    k = F.when(F.sin(c) > 1e-15, c / F.sin(c)).otherwise(1.0) * RADIUS
    return k * F.cos(f) * F.sin(dl), k * (F.cos(f0) * F.sin(f) - F.sin(f0) * F.cos(f) * F.cos(dl))


def segment_distance(lat: Column, lon: Column, ends: Sequence[Column]) -> Column:
    """Distance in km from a point to a segment (lat1, lon1, lat2, lon2) that is straight in the point's own plane."""
    (x1, y1), (x2, y2) = _plane(lat, lon, ends[0], ends[1]), _plane(lat, lon, ends[2], ends[3])
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(x1 + t * dx, F.lit(2.0)) + F.pow(y1 + t * dy, F.lit(2.0)))


def _cell(lat: Column, lon: Column, around: int) -> tuple[Column, Column]:
    size = 360.0 / around
    return F.floor((lat + 90) / size).cast("long"), F.pmod(F.floor((lon + 180) / size).cast("long"), F.lit(around))


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    f, g = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(f) * np.cos(g), np.cos(f) * np.sin(g), np.sin(f)])


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((a - b) ** 2).sum(axis=1)) / 2))


class Pyramid:
    """Cells that hold ends of segments, and those that hold such cells: each with one of its ends and the angle within
    which all of them are from it. There are no more of them than the grid has cells."""

    def __init__(self, r: np.ndarray, c: np.ndarray, at: np.ndarray, reach: np.ndarray):
        self.levels = [(r, c, at, reach, None)]
        for _ in range(FINEST - 1):
            r, c, at, reach, _ = self.levels[-1]
            key = (r >> 1) * (1 << FINEST) + (c >> 1)
            _, first, above = np.unique(key, return_index=True, return_inverse=True)
            wide = np.zeros(len(first))
            np.maximum.at(wide, above, _angle(at, at[first][above]) + reach)
            below = np.argsort(above, kind="stable")
            starts = np.searchsorted(above[below], np.arange(len(first) + 1))
            self.levels.append((r[first] >> 1, c[first] >> 1, at[first], wide, (below, starts)))

    def near(self, spots: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a spot's and a finest cell's number: all cells that may hold an end of the spot's nearest segment.

        An end is as far in the spot's plane as on the globe. Within a quarter of the globe lengths are at most pi / 2 times
        as long there, so that a segment nearer than ``best``, the nearest end so far, has an end within the root of the
        squares of ``best`` and half that length. Elsewhere a segment is nearer than its nearer end by at most the cosine
        of half the angle that the spot sees it under, which is small but around the spot's antipode.
        """
        _, _, top, _, _ = self.levels[-1]
        spot, cell = np.repeat(np.arange(len(spots)), len(top)), np.tile(np.arange(len(top)), len(spots))
        best = np.full(len(spots), np.inf)
        for level in range(len(self.levels) - 1, -1, -1):
            _, _, at, reach, below = self.levels[level]
            away = _angle(spots[spot], at[cell])
            np.minimum.at(best, spot, away)
            limit, low, high = best[spot], away - reach[cell] - longest, away + reach[cell] + longest
            ends = away - reach[cell] <= np.sqrt(limit * limit + (math.pi / 4 * longest) ** 2) + 1e-9
            narrow = np.where((low > 0) & (high < math.pi), np.minimum(np.sin(low), np.sin(high)), 0.0)
            share = np.minimum(1.0, math.sin(min(longest, math.pi) / 2) / np.maximum(narrow, 1e-300))
            kept = np.where(high <= math.pi / 2, ends, low * np.sqrt(1 - share * share) <= limit + 1e-9)
            spot, cell = spot[kept], cell[kept]
            if below is not None:
                order, starts = below
                n = starts[cell + 1] - starts[cell]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                spot, cell = np.repeat(spot, n), order[np.repeat(starts[cell], n) + inner]
        return spot, cell


def near_cells(places: DataFrame, ends: DataFrame, longest: float) -> DataFrame:
    """(lat__, lon__, r, c): for each place the cells of ``ends`` (r, c, lat, lon) in which its nearest segment may end."""
    cells = ends.groupBy("r", "c").agg(F.min(F.struct("lat", "lon")).alias("one"), *(f(x).alias(f"{n}_{x}") for x in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))))
    held = cells.select("r", "c", "one.lat", "one.lon", "low_lat", "high_lat", "low_lon", "high_lon").toPandas()
    reach = np.hypot(*(np.maximum(held[x] - held[f"low_{x}"], held[f"high_{x}"] - held[x]) for x in ("lat", "lon")))
    tree = Pyramid(held["r"].to_numpy(), held["c"].to_numpy(), _unit(held["lat"].to_numpy(), held["lon"].to_numpy()), np.radians(reach.to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, c, *_ = tree.levels[0]
        for batch in batches:
            lat, lon = batch.column("lat__").to_numpy(), batch.column("lon__").to_numpy()
            for a in range(0, len(lat), 1024):
                spot, cell = tree.near(_unit(lat[a : a + 1024], lon[a : a + 1024]), longest / RADIUS)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lat[a + spot], lon[a + spot], r[cell], c[cell])], ["lat__", "lon__", "r", "c"])

    return places.mapInArrow(run, "lat__ double, lon__ double, r long, c long")


def nearest_segment(points: DataFrame, ids: Sequence[str], lat: str, lon: str, segments: DataFrame) -> DataFrame:
    """``points`` with distance_km to the nearest of ``segments`` (lat1, lon1, lat2, lon2); null only if there are none, or
    for points without a place. ``ids`` tell points apart.

    Segments are held by the cells in which they end. Each place is asked for once: from the whole globe down to the
    finest cells, those stay that may hold an end of its nearest segment, and the segments in these are compared.
    """
    names = ["lat1", "lon1", "lat2", "lon2"]
    coast = segments.select(*(F.col(c).cast("double").alias(c) for c in names)).na.drop().distinct()
    x, y = _plane(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    longest = coast.agg(F.max(F.sqrt(x * x + y * y))).first()[0]
    if longest is None:
        return points.withColumn("distance_km", F.lit(None).cast("double"))
    cells = [tuple(c.alias(n) for c, n in zip(_cell(F.col(a), F.col(b), 1 << FINEST), ("r", "c"))) for a, b in (("lat1", "lon1"), ("lat2", "lon2"))]
    wrapped = lambda a: (F.pmod(F.col(a) + 180.0, F.lit(360.0)) - 180.0).alias("lon")
    ends = [coast.select(*own, F.col(a).alias("lat"), wrapped(b)) for own, (a, b) in zip(cells, (("lat1", "lon1"), ("lat2", "lon2")))]
    held = coast.select(*cells[0], *names).unionByName(coast.select(*cells[1], *names)).distinct()
    asked = points.select("*", F.col(lat).cast("double").alias("lat__"), F.col(lon).cast("double").alias("lon__"))
    places = asked.select("lat__", "lon__").na.drop().distinct()
    met = near_cells(places, ends[0].unionByName(ends[1]), float(longest)).join(held, ["r", "c"])
    found = met.groupBy("lat__", "lon__").agg(F.min(segment_distance(F.col("lat__"), F.col("lon__"), [F.col(n) for n in names])).alias("distance_km"))
    return asked.join(found, ["lat__", "lon__"], "left").select(*points.columns, "distance_km")


def edges(df: DataFrame, ids: Sequence[str], geometry: str) -> DataFrame:
    """(ids..., part, ring, x1, y1, x2, y2): the edges of geometries that are arrays of parts, of rings, of points (x, y).
    Rings close themselves; a part is a row of its own in ``part``."""
    told = df.select(*ids, F.posexplode(geometry).alias("part", "rings")).select(*ids, "part", F.posexplode("rings").alias("ring", "points"))
    after = F.concat(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 1, 1))
    pairs = F.explode(F.arrays_zip(F.col("points").alias("a"), after.alias("b")))
    told = told.where(F.size("points") > 0).select(*ids, "part", "ring", pairs.alias("e"))
    return told.select(*ids, "part", "ring", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def within(points: DataFrame, point: Sequence[str], x: str, y: str, edges_: DataFrame, polygon: Sequence[str], band: float) -> DataFrame:
    """(point..., polygon...) of points in polygons: those with an odd number of edges to their right, so that holes are
    outside and all parts count. Points and edges meet in bands of y; an edge is in each band that it crosses."""
    flat = edges_.where(F.col("y1") != F.col("y2")).withColumns({"low": F.least("y1", "y2"), "high": F.greatest("y1", "y2")})
    spread = flat.withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / band), F.floor(F.col("high") / band))))
    asked = points.select(*point, F.col(x).alias("px"), F.col(y).alias("py"), F.floor(F.col(y) / band).alias("band"))
    crossing = F.col("x1") + (F.col("py") - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    met = asked.join(spread, "band").where((F.col("py") >= F.col("low")) & (F.col("py") < F.col("high")) & (F.col("px") < crossing))
    return met.groupBy(*point, *polygon).count().where("count % 2 = 1").drop("count")


def clipped_by(df: DataFrame, pixel: Sequence[str], x: Column, y: Column, edges_: DataFrame, band: float, value: str = "value", zero_is_null: bool = True) -> DataFrame:
    """Pixels whose centre is in one of the polygons; zeros become null. ``pixel`` are the columns that make a place."""
    places = df.select(*pixel, x.alias("x__"), y.alias("y__")).distinct()
    kept = within(places, pixel, "x__", "y__", edges_.withColumn("all__", F.lit(0)), ["all__"], band).select(*pixel)
    told = df.join(kept, list(pixel), "left_semi")
    return told.withColumn(value, F.nullif(F.col(value), F.lit(0.0))) if zero_is_null else told


def bilinear(df: DataFrame, keys: Sequence[str], source: tuple[float, float, float], target: tuple[float, float, float], shape: tuple[int, int], value: str = "value") -> DataFrame:
    """(keys..., row, col, value) on a target grid of ``shape`` rows and columns: the four source pixels around a target
    pixel's centre, weighted by nearness; missing ones give their weight to the others. Grids are (north, west, step)."""
    (north, west, step), (north2, west2, step2), (rows, cols) = source, target, shape
    place = df.sparkSession.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), (F.col("id") % cols).alias("col"))
    r = (F.lit(north) - (F.lit(north2) - (F.col("row") + 0.5) * step2)) / step - 0.5
    c = (F.lit(west2) + (F.col("col") + 0.5) * step2 - west) / step - 0.5
    told = place.withColumns({"r": r, "c": c})
    r0, c0 = F.floor("r"), F.floor("c")
    fr, fc = F.col("r") - r0, F.col("c") - c0
    around = [(r0, c0, (1 - fr) * (1 - fc)), (r0, c0 + 1, (1 - fr) * fc), (r0 + 1, c0, fr * (1 - fc)), (r0 + 1, c0 + 1, fr * fc)]
    told = told.select("row", "col", F.explode(F.array(*(F.struct(a.alias("sr"), b.alias("sc"), w.alias("w")) for a, b, w in around))).alias("s")).select("row", "col", "s.*").where("w > 0")
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col("row").cast("long").alias("sr"), F.col("col").cast("long").alias("sc"), F.col(value).alias("v__"))
    met = told.join(own, ["sr", "sc"])
    return met.groupBy(*keys, "row", "col").agg((F.sum(F.col("w") * F.col("v__")) / F.sum("w")).alias(value))
