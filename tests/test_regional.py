import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import crs, regional

#: Points within each system's area of use.
NEAR = {"3034": (12.5, 47.25), "3035": (-3.75, 55.5), "3347": (-75.5, 45.25), "3577": (146.25, -27.5), "5070": (-118.5, 37.75)}


def _image(spark, code, points):
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "i int, lon double, lat double")
    x, y = crs.transform("EPSG:4326", f"EPSG:{code}", F.col("lon"), F.col("lat"))
    back = crs.transform(f"EPSG:{code}", "EPSG:4326", F.col("x"), F.col("y"))
    return rows.select("i", x.alias("x"), y.alias("y")).select("i", "x", "y", back[0].alias("lon"), back[1].alias("lat")).orderBy("i").collect()


def test_published_point(spark):
    """The worked example of EPSG guidance note 7-2 for ETRS89-LAEA."""
    (r,) = _image(spark, "3035", [(5, 50)])
    assert (r.x, r.y) == pytest.approx((3962799.45, 2999718.85), abs=0.01)


@pytest.mark.parametrize("code", sorted(regional.SYSTEMS))
def test_origin_round_trip_and_defining_property(spark, code):
    kind, lat0, lon0, parallels, east, north = regional.SYSTEMS[code]
    lon, lat = NEAR[code]
    h = 1e-4
    points = [(lon0, lat0), (lon, lat), (lon + h, lat), (lon, lat + h), (lon - h, lat), (lon, lat - h)]
    rows = _image(spark, code, points)
    assert (rows[0].x, rows[0].y) == pytest.approx((east, north), abs=1e-4)
    for r, (a, b) in zip(rows, points, strict=True):
        assert (r.lon, r.lat) == pytest.approx((a, b), abs=1e-8)
    # Metres on the ground for a degree of longitude and latitude, and the map's partial derivatives.
    phi, w = math.radians(lat), 1 - regional.E2 * math.sin(math.radians(lat)) ** 2
    by_lon, by_lat = regional.RADIUS * math.cos(phi) / math.sqrt(w), regional.RADIUS * (1 - regional.E2) / w**1.5
    d = math.radians(2 * h)
    xl, yl = (rows[2].x - rows[4].x) / d / by_lon, (rows[2].y - rows[4].y) / d / by_lon
    xp, yp = (rows[3].x - rows[5].x) / d / by_lat, (rows[3].y - rows[5].y) / d / by_lat
    if kind == "lcc":
        assert (xl, yl) == pytest.approx((yp, -xp), abs=1e-6)
    else:
        assert xl * yp - xp * yl == pytest.approx(1.0, abs=1e-6)
    for p in parallels:
        a, b = _image(spark, code, [(lon0 - h, p), (lon0 + h, p)])
        w = 1 - regional.E2 * math.sin(math.radians(p)) ** 2
        assert (b.x - a.x) / d / (regional.RADIUS * math.cos(math.radians(p)) / math.sqrt(w)) == pytest.approx(1.0, abs=1e-6)


def test_points_without_image_are_null(spark):
    assert _image(spark, "3035", [(-170, -52)])[0].x is None
    assert _image(spark, "3034", [(0, 90)])[0].y is None
    far = crs.transform("EPSG:3035", "EPSG:4326", F.lit(9e7), F.lit(9e7))
    assert spark.range(1).select(*far).first()[1] is None


def test_between_systems(spark):
    x, y = crs.transform("EPSG:32631", "EPSG:3035", F.lit(500000.0), F.col("n"))
    there = spark.createDataFrame([(5500000.0,)], "n double").select(x.alias("x"), y.alias("y")).first()
    back = crs.transform("EPSG:3035", "EPSG:32631", F.col("x"), F.col("y"))
    assert tuple(spark.createDataFrame([there]).select(*back).first()) == pytest.approx((500000.0, 5500000.0), abs=1e-2)
