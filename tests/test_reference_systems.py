"""Reference systems: UTM against the arc of the meridian, known points and round trips."""

import math

import pytest
from pyspark.sql import functions as F

from netaudit.functions import geo


def moved(spark, x, y, src, dst):
    df = spark.createDataFrame([(f"POINT Z ({x} {y} 7)".replace(" Z", ""), src)], "w string, crs string")
    p = df.select(geo.reproject(geo.parse_wkt(F.col("w")), F.col("crs"), dst)).first()[0][0]
    assert p.z == 7
    return p.x, p.y


def _arc(latitude):
    """Length of the meridian from the equator, by Simpson's rule."""
    a, e2, n = 6378137.0, 0.0066943799901413165, 20_000
    m = lambda f: a * (1 - e2) / (1 - e2 * math.sin(f) ** 2) ** 1.5
    h = math.radians(latitude) / n
    return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * m(k * h) for k in range(n + 1))


@pytest.mark.parametrize("latitude", [0.5, 30.0, 60.0, 83.0])
def test_middle_meridian(spark, latitude):
    x, y = moved(spark, 9.0, latitude, "EPSG:4326", "EPSG:32632")
    assert abs(x - 500_000) < 1e-6 and abs(y - 0.9996 * _arc(latitude)) < 1e-3
    assert abs(moved(spark, 9.0, -latitude, "EPSG:4490", "EPSG:32732")[1] - (1e7 - 0.9996 * _arc(latitude))) < 1e-3


@pytest.mark.parametrize(("x", "y", "zone", "east", "north"), [(7.5, 51.2, "EPSG:32632", 395201.3104, 5673135.2412), (2.2945, 48.8582, "EPSG:32631", 448251.795, 5411932.678)])
def test_known_points(spark, x, y, zone, east, north):
    got = moved(spark, x, y, "EPSG:4326", zone)
    assert abs(got[0] - east) < 1e-3 and abs(got[1] - north) < 1e-3


@pytest.mark.parametrize(("x", "y", "zone"), [(7.1, 50.3, "EPSG:32632"), (-70.9, -33.4, "EPSG:32719"), (179.9, 65.0, "EPSG:32601"), (-179.9, -10.0, "EPSG:32760")])
def test_round_trips(spark, x, y, zone):
    df = spark.createDataFrame([(f"POINT ({x} {y} 7)",)], "w string")
    there = geo.reproject(geo.parse_wkt(F.col("w")), F.lit("EPSG:4326"), zone)
    back = df.select(geo.reproject(there, F.lit(zone.lower()), "EPSG:4326")).first()[0][0]
    assert (back.x, back.y) == (pytest.approx(x, abs=1e-9), pytest.approx(y, abs=1e-9))
    web = df.select(geo.reproject(geo.reproject(there, F.lit(zone), "EPSG:3857"), F.lit("EPSG:3857"), "EPSG:4490")).first()[0][0]
    assert (web.x, web.y) == (pytest.approx(x, abs=1e-9), pytest.approx(y, abs=1e-9))


def test_unknown_systems_stay(spark):
    assert moved(spark, 1.0, 2.0, "EPSG:26191", "EPSG:4326") == (1.0, 2.0) and moved(spark, 1.0, 2.0, "EPSG:4326", "EPSG:2154") == (1.0, 2.0)
    df = spark.createDataFrame([(c,) for c in ("EPSG:4326", "epsg:32631", "EPSG:32661", "EPSG:2154", None, "EPSG:3857")], "c string")
    assert [r[0] for r in df.select(geo.is_known_crs(F.col("c"))).collect()] == [True, True, False, False, False, True]
