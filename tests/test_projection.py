import math
import random

import pytest
from pyspark.sql import functions as F

from acrelens.functions import projection as J

# Published check points: a conic in survey feet, a transverse Mercator in metres.
TEXAS = J.Projection("conic", 27 + 50 / 60, -99.0, 2_000_000.0, 0.0, parallels=(28 + 23 / 60, 30 + 17 / 60), unit=J.SURVEY_FOOT, a=6_378_206.4, f=1 / 294.978698214)
BRITAIN = J.Projection("transverse", 49.0, -2.0, 400_000.0, -100_000.0, scale=0.9996012717, a=6_377_563.396, f=1 / 299.3249646)
CHECKED = [(TEXAS, -96.0, 28.5, 2_963_503.91, 254_759.80, 0.03), (BRITAIN, 0.5, 50.5, 577_274.99, 69_740.50, 0.01)]
# Published lines in metres: over the Atlantic, and between two survey marks.
LINES = [
    (40.6, -73.8, 51.6, -0.5, 5_551_759.400),
    (-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600, -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600, 54_972.271),
]


@pytest.mark.parametrize("plane, lon, lat, x, y, off", CHECKED)
def test_published_points(spark, plane, lon, lat, x, y, off):
    df = spark.createDataFrame([(lon, lat, x, y)], "lon double, lat double, x double, y double")
    there = df.select(*J.to_plane(plane, F.col("lon"), F.col("lat"))).first()
    assert abs(there[0] - x) < off and abs(there[1] - y) < off
    back = df.select(*J.to_degrees(plane, F.col("x"), F.col("y"))).first()
    assert abs(back[0] - lon) < 3e-7 and abs(back[1] - lat) < 3e-7


def test_there_and_back_within_a_micrometre(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-88, -79), rng.uniform(24, 31.5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    for plane in (*J.ZONES.values(), TEXAS, J.Projection("conic", -30.0, 25.0, 0.0, 0.0, parallels=(-20.0, -35.0))):
        x, y = J.to_plane(plane, F.col("lon"), F.col("lat"))
        lon, lat = J.to_degrees(plane, F.col("x"), F.col("y"))
        off = df.select("lon", "lat", x.alias("x"), y.alias("y")).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
        assert max(off) < 1e-11


def test_planes_as_text():
    for plane in (*J.ZONES.values(), TEXAS, BRITAIN):
        found = J.projection_of(J.projection_text(plane))
        assert found.kind == plane.kind and math.isclose(found.f, plane.f) and (found.lat0, found.lon0, found.parallels, found.unit) == (plane.lat0, plane.lon0, plane.parallels, plane.unit)
    for text in ('GEOGCS["WGS 84",DATUM["D",SPHEROID["S",6378137,298.257223563]],UNIT["Degree",0.0174532925199433]]', 'PROJCS["x",GEOGCS["g",DATUM["d",SPHEROID["s",6378137,298.25]]],PROJECTION["Mercator"],PARAMETER["Central_Meridian",0],UNIT["m",1]]'):
        with pytest.raises(ValueError):
            J.projection_of(text)


def test_published_lines(spark):
    df = spark.createDataFrame(LINES, "a double, b double, c double, d double, m double")
    rows = df.withColumn("metres", J.geodesic_m(*map(F.col, "abcd"))).collect()
    assert all(abs(r["metres"] - r["m"]) < 1e-3 for r in rows) and len(rows) == 2


def test_lines_of_special_places(spark):
    b = J.WGS84_A * (1 - J.WGS84_F)
    rows = [(10.0, 20.0, 10.0, 20.0, 0.0), (0.0, 0.0, 0.0, 1.0, math.radians(1) * J.WGS84_A), (90.0, 0.0, -90.0, 0.0, 20_003_931.4586), (0.0, 179.9, 0.0, -179.9, math.radians(0.2) * J.WGS84_A), (90.0, 5.0, 90.0, 90.0, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double, d double, m double")
    got = {r["id"]: r["metres"] for r in df.withColumn("metres", J.geodesic_m(*map(F.col, "abcd"), steps=6)).collect()}
    assert all(abs(got[i] - r[4]) < 1e-3 for i, r in enumerate(rows)) and b < J.WGS84_A


def test_the_sphere_is_off_by_less_than_its_share(spark):
    from acrelens.operators.spatial import distance_m

    rng = random.Random(2)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(4000)]
    rows = [(a, b, max(-90.0, min(90.0, a + rng.uniform(-s, s))), b + rng.uniform(-s, s)) for s in (0.01, 1.0, 60.0) for a, b in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    both = df.select(J.geodesic_m(*map(F.col, "abcd")).alias("metres"), distance_m(*map(F.col, "abcd")).alias("apart"))
    worst = both.filter("metres > 1").select(F.max(F.abs(F.col("apart") / F.col("metres") - 1)), F.count_if(F.col("metres").isNull())).first()
    assert worst[0] < J.SPHERE_SHARE * 0.99 and worst[1] == 0
