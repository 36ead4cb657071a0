import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import geometry


def plane(lat0, lon0, lat, lon):
    f0, f, dl = math.radians(lat0), math.radians(lat), math.radians(lon - lon0)
    h = math.sin((f - f0) / 2) ** 2 + math.cos(f0) * math.cos(f) * math.sin(dl / 2) ** 2
    c = 2 * math.asin(math.sqrt(min(h, 1)))
    k = (c / math.sin(c) if math.sin(c) > 1e-15 else 1) * geometry.RADIUS
    return np.array([k * math.cos(f) * math.sin(dl), k * (math.cos(f0) * math.sin(f) - math.sin(f0) * math.cos(f) * math.cos(dl))])


def plain(lat, lon, segments):
    best = math.inf
    for a, b, c, d in segments:
        p, q = plane(lat, lon, a, b), plane(lat, lon, c, d)
        v = q - p
        t = min(1, max(0, -(p @ v) / (v @ v))) if v @ v > 0 else 0
        best = min(best, float(np.hypot(*(p + t * v))))
    return best


@pytest.mark.parametrize("length", [0.0, 0.3, 8.0])
def test_nearest_segment_equals_trying_all(spark, length):
    rng = np.random.default_rng(1)
    coast = [(float(a), float(b), float(np.clip(a + rng.uniform(-length, length), -90, 90)), float(b + rng.uniform(-length, length))) for a, b in zip(rng.uniform(-80, 85, 40), rng.uniform(-180, 180, 40))]
    spots = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)))]
    spots += [(150, 10.0, 179.999), (151, 10.0, -179.999), (152, 89.99, 0.0), (153, -90.0, 17.0), (154, coast[0][0], coast[0][1])]
    df = spark.createDataFrame([*spots, (155, None, 1.0)], "id int, lat double, lon double")
    got = {r["id"]: r["distance_km"] for r in geometry.nearest_segment(df, ["id"], "lat", "lon", spark.createDataFrame(coast, "lat1 double, lon1 double, lat2 double, lon2 double")).collect()}
    assert len(got) == 156 and got.pop(155) is None
    for i, lat, lon in spots:
        assert math.isclose(got[i], plain(lat, lon, coast), rel_tol=1e-9, abs_tol=1e-6)


def test_no_coast(spark):
    got = geometry.nearest_segment(spark.createDataFrame([(1, 2.0, 3.0)], "id int, lat double, lon double"), ["id"], "lat", "lon", spark.createDataFrame([], "lat1 double, lon1 double, lat2 double, lon2 double"))
    assert [tuple(r) for r in got.collect()] == [(1, 2.0, 3.0, None)]


def test_across_the_date_line(spark):
    coast = spark.createDataFrame([(0.0, 179.5, 0.0, 179.5), (0.0, 170.0, 0.0, 170.0)], "lat1 double, lon1 double, lat2 double, lon2 double")
    got = geometry.nearest_segment(spark.createDataFrame([(1, 0.0, -179.5)], "id int, lat double, lon double"), ["id"], "lat", "lon", coast).first()
    assert math.isclose(got["distance_km"], math.radians(1) * geometry.RADIUS, rel_tol=1e-9)


def test_polygons_with_holes_and_parts(spark):
    shapes = [("a", [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(3.0, 3.0), (7.0, 3.0), (5.0, 8.0)]], [[(20.0, -5.0), (24.0, 3.0), (16.0, 3.0)]]]), ("b", [[[(5.0, 5.0), (15.0, 5.0), (15.0, 15.0)]]]), ("none", [])]
    df = spark.createDataFrame(shapes, "name string, parts array<array<array<struct<x: double, y: double>>>>")
    e = geometry.edges(df, ["name"], "parts")
    assert e.groupBy("name", "part", "ring").count().count() == 4 and e.count() == 4 + 3 + 3 + 3
    rng = np.random.default_rng(2)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-2, 26, 400), rng.uniform(-7, 17, 400)))]
    found = {tuple(r) for r in geometry.within(spark.createDataFrame(spots, "id int, x double, y double"), ["id"], "x", "y", e, ["name"], 2.5).collect()}

    def odd(x, y, rings):
        n = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
                if y1 != y2 and min(y1, y2) <= y < max(y1, y2):
                    n += x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
        return n % 2

    want = {(i, name) for i, x, y in spots for name, parts in shapes if odd(x, y, [r for p in parts for r in p])}
    assert found == want and len(want) > 50


def test_bilinear(spark):
    grid = np.arange(30.0).reshape(5, 6) ** 1.5
    rows = [("a", r, c, None if (r, c) == (2, 3) else float(grid[r, c])) for r in range(5) for c in range(6)]
    df = spark.createDataFrame(rows, "product string, row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in geometry.bilinear(df, ["product"], (50.0, 10.0, 2.0), (49.0, 11.5, 1.0), (6, 7)).collect()}
    for i in range(6):
        for j in range(7):
            y, x = (50 - (49 - (i + 0.5))) / 2 - 0.5, (11.5 + j + 0.5 - 10) / 2 - 0.5
            near = [(r, c, (1 - abs(y - r)) * (1 - abs(x - c))) for r in (math.floor(y), math.floor(y) + 1) for c in (math.floor(x), math.floor(x) + 1)]
            near = [(grid[r, c], w) for r, c, w in near if w > 0 and 0 <= r < 5 and 0 <= c < 6 and (r, c) != (2, 3)]
            assert (i, j) in got and math.isclose(got[i, j], sum(v * w for v, w in near) / sum(w for _, w in near))
    same = geometry.bilinear(df, ["product"], (50.0, 10.0, 2.0), (50.0, 10.0, 2.0), (5, 6))
    assert {(r["row"], r["col"]): r["value"] for r in same.collect()} == {(r, c): v for _, r, c, v in rows if v is not None}


def test_far_points_meet_few_segments(spark):
    """Points far from any coast are compared with what is nearest to them, not with all that is within a wide cell."""
    rng = np.random.default_rng(5)
    coast = np.column_stack([rng.uniform(0, 10, 3000), rng.uniform(-179, 179, 3000)])
    ends = [(int((a + 90) // (360 / 512)), int((b + 180) // (360 / 512)), float(a), float(b)) for a, b in coast]
    places = spark.createDataFrame([(70.0, float(k)) for k in range(-170, 180, 10)], "lat__ double, lon__ double")
    cells = geometry.near_cells(places, spark.createDataFrame(ends, "r long, c long, lat double, lon double"), 10.0)
    assert places.count() <= cells.count() <= 0.02 * 3000 * places.count()
    segments = spark.createDataFrame([(float(a), float(b), float(a), float(b) + 0.05) for a, b in coast], "lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r["lon"]: r["distance_km"] for r in geometry.nearest_segment(places.toDF("lat", "lon"), ["lon"], "lat", "lon", segments).collect()}
    for lon, told in got.items():
        assert math.isclose(told, plain(70.0, lon, [(a, b, a, b + 0.05) for a, b in coast]), rel_tol=1e-9)
