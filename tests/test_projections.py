"""Systems by parameters: published points of each method, round trips, names, and what is refused."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import crs as C
from gridloom.functions import projections as P

# Worked examples of IOGP publication 373-7-2 and of Snyder (1987), with the decimals given there.
PUBLISHED = [
    ("+proj=merc +lon_0=110 +k_0=0.997 +x_0=3900000 +y_0=900000 +ellps=bessel", 120.0, -3.0, 5009726.58, 569150.82, 0.01),
    ("+proj=merc +lon_0=51 +lat_ts=42 +ellps=krass", 53.0, 53.0, 165704.29, 5171848.07, 0.01),
    ("+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66", -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.8 / 3600, 255966.58, 142493.51, 0.01),
    ("+proj=lcc +lat_1=28.383333333333333 +lat_2=30.283333333333335 +lat_0=27.833333333333332 +lon_0=-99 +x_0=609601.2192024384 +y_0=0 +ellps=clrk66 +units=us-ft", -96.0, 28.5, 2963503.91, 254759.80, 0.01),
    ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", 5.0, 50.0, 3962799.45, 2999718.85, 0.01),
    ("+proj=stere +lat_0=90 +lon_0=0 +k_0=0.994 +x_0=2000000 +y_0=2000000 +ellps=WGS84", 44.0, 73.0, 3320416.75, 632668.43, 0.01),
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000 +ellps=WGS84", 120.0, -75.0, 7255380.79, 7053389.56, 0.01),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k_0=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 0.5, 50.5, 577274.99, 69740.50, 0.01),
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75.0, 35.0, 1885472.7, 1535925.0, 0.1),
    ("+proj=cea +lat_ts=5 +lon_0=-75 +ellps=clrk66", -78.0, 5.0, -332699.8, 554248.5, 0.1),
    ("+proj=sinu +lon_0=-90 +ellps=clrk66", -75.0, -50.0, 1075471.5, -5540628.0, 0.1),
    ("+proj=stere +lat_0=40 +lon_0=-100 +k_0=0.9999 +ellps=clrk66", -90.0, 30.0, 971630.8, -1063049.3, 0.1),
]
MORE = [
    "+proj=eqc +lat_ts=40 +lat_0=10 +lon_0=5 +ellps=intl", "+proj=laea +lat_0=90 +lon_0=-45", "+proj=laea +lat_0=-90 +lon_0=30", "+proj=laea +lat_0=0 +lon_0=20 +ellps=sphere", "+proj=tmerc +lat_0=-10 +lon_0=25 +k=0.99 +ellps=sphere",
    "+proj=cea +R=6371000", "+proj=merc +a=6378137 +b=6378137", "+proj=aea +lat_1=-18 +lat_2=-36 +lon_0=132 +ellps=GRS80", "+proj=lcc +lat_1=-20 +lat_0=-90 +lon_0=10", "+proj=sinu +R=6371007.181", "+proj=lcc +lat_1=65 +lat_2=35 +lat_0=52 +lon_0=10 +pm=paris",
    "+proj=utm +zone=60 +south +ellps=bessel", "+proj=aea +lat_1=40 +lat_2=40 +lon_0=0", "+proj=stere +lat_0=-30 +lon_0=100 +units=km", "+proj=longlat +pm=ferro",
]


def test_published_points(spark):
    rows = spark.createDataFrame([(i, lon, lat) for i, (_, lon, lat, *_) in enumerate(PUBLISHED)], "i int, lon double, lat double")
    for i, (text, lon, lat, x, y, off) in enumerate(PUBLISHED):
        p = P.parse(text)
        u, v = P.forward(p, F.col("lon"), F.col("lat"))
        got = rows.where(F.col("i") == i).select(u.alias("x"), v.alias("y")).select("*", *[c.alias(n) for c, n in zip(P.backward(p, F.col("x"), F.col("y")), ("lon", "lat"), strict=True)]).first()
        assert abs(got.x - x) <= off and abs(got.y - y) <= off, (text, got)
        assert abs(got.lon - lon) < 1e-8 and abs(got.lat - lat) < 1e-8, (text, got)  # a millimetre


def test_round_trips(spark):
    """Over a grid of points around each origin, parameters as numbers and as columns."""
    for text in [t for t, *_ in PUBLISHED] + MORE:
        p = P.parse(text)
        rows = spark.range(121).select((p.lon0 + (F.col("id") % 11 - 5) * 3.0).alias("lon"), F.least(F.lit(89.9), F.greatest(F.lit(-89.9), p.lat0 + (F.floor(F.col("id") / 11) - 5) * 4.0)).alias("lat"))
        own = P.Projection(p.kind, *[F.col(f"p{k}") for k in range(7)], a=F.col("p7"), rf=F.col("p8"), unit=p.unit, ts=p.ts)
        rows = rows.select("*", *[F.lit(float(getattr(p, n))).alias(f"p{k}") for k, n in enumerate(("lon0", "lat0", "lat1", "lat2", "k", "x0", "y0", "a", "rf"))])
        for way in (p, own):
            there = rows.select("*", *[c.alias(n) for c, n in zip(P.forward(way, F.col("lon"), F.col("lat")), "xy", strict=True)])
            back = there.select("x", "y", *[(c - F.col(n)).alias(n) for c, n in zip(P.backward(way, F.col("x"), F.col("y")), ("lon", "lat"), strict=True)])
            worst = back.agg(F.max(F.abs("lon")), F.max(F.abs("lat")), F.count("lon"), F.sum("x"), F.sum("y")).first()
            assert worst[0] < 1e-7 and worst[1] < 1e-8 and worst[2] == 121, (text, worst)
            if way is p:
                sums = worst[3:]
            else:
                assert worst[3:] == pytest.approx(sums, rel=1e-9, abs=1e-3), text


def test_names():
    assert C.normalise("+proj=utm +zone=31 +datum=WGS84 +units=m +no_defs") == "EPSG:32631" == C.normalise("+proj=tmerc +lat_0=0 +lon_0=3 +k=0.9996 +x_0=500000 +y_0=0 +ellps=WGS84")
    assert C.normalise("+proj=longlat +datum=WGS84 +no_defs") == "EPSG:4326" and C.normalise("+proj=utm +zone=5 +south") == "EPSG:32705"
    assert C.normalise("+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +nadgrids=@null +wktext +no_defs") in ("EPSG:3857", P.parse("+proj=merc +a=6378137 +b=6378137 +lat_ts=0").name())
    assert C.normalise("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80") == "EPSG:3035"
    a, b = C.normalise("+proj=sinu +R=6371007.181 +units=m"), C.normalise("+units=m +a=6371007.181 +b=6371007.181 +proj=sinu +no_defs")
    assert a == b == C.normalise(a) and C.parameters(a) == P.parse(a)
    for text in (t for t, *_ in PUBLISHED):
        name = C.normalise(text)
        assert C.normalise(name) == name and P.same(C.parameters(name), P.parse(text))


@pytest.mark.parametrize("text", ["+proj=krovak", "+proj=tmerc +towgs84=1,2,3", "+proj=utm", "+proj=utm +zone=61", "+proj=merc +ellps=moon", "+proj=lcc +lat_1=10 +lat_2=-10", "+proj=tmerc +lon_0=east", "+proj=tmerc +gamma=3", "+proj=tmerc +units=rod", "+proj=tmerc +lon_0=nan", "WGS 84"])
def test_what_is_refused(text):
    with pytest.raises(ValueError):
        C.normalise(text)


def test_points_without_an_image(spark):
    one = spark.createDataFrame([(-170.0, -52.0)], "lon double, lat double")
    assert one.select(*P.forward(P.parse("+proj=laea +lat_0=52 +lon_0=10"), F.col("lon"), F.col("lat"))).first()[0] is None
    assert one.select(*P.backward(P.parse("+proj=laea +lat_0=52 +lon_0=10"), F.lit(3e7), F.lit(3e7))).first()[1] is None
    pole = spark.createDataFrame([(0.0, 90.0)], "lon double, lat double")
    assert pole.select(*P.forward(P.parse("+proj=merc"), F.col("lon"), F.col("lat"))).first()[1] is None
    at = pole.select(*P.forward(P.parse("+proj=stere +lat_0=90"), F.col("lon"), F.col("lat"))).first()
    assert math.hypot(*at) < 1e-6


def test_turns():
    assert P.turn(P.parse("+proj=longlat")) == 360 and P.turn(P.parse("+proj=utm +zone=3")) is None
    assert P.turn(C.parameters("EPSG:3857")) == pytest.approx(2 * 20037508.342789244)
