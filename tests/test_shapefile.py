import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from acrelens.functions.projection import ZONES, projection_text
from acrelens.sources import shapefile as S


def square(x, y, half):
    return [(x - half, y - half), (x - half, y + half), (x + half, y + half), (x + half, y - half)]


def shapes(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        parts = []
        for k in range(rng.randrange(0, 4)):
            half = rng.uniform(5, 40)
            x, y = 1e6 + 200 * k + rng.random(), 5e5 + rng.random()
            parts.append((square(x, y, half), [square(x - half / 2, y, half / 8), square(x + half / 2, y, half / 4)][: rng.randrange(0, 3)]))
        rows.append((i, None if not parts else parts, rng.choice(["", None, "O'Brien Ünit", "x" * 60]), rng.choice([None, -5, 10**15]), rng.choice([None, 0.1, -2.5e300])))
    return rows


def plain(parts):
    ring = lambda r: [(p["x"], p["y"]) for p in r]
    return None if parts is None else [(ring(p["ring"]), [ring(h) for h in p["holes"]]) for p in parts]


def same(a, b):
    """Rings equal but for where and which way they run."""
    key = lambda ring: sorted(ring)
    return (a is None) == (b is None) and (a is None or [(key(r), sorted(map(key, h))) for r, h in a] == [(key(r), sorted(map(key, h))) for r, h in b])


def test_what_is_written_comes_back(spark, tmp_path):
    rows = shapes(137)
    df = spark.createDataFrame(rows, f"id long, parts {S.PARTS}, name string, jv long, value double").repartition(3, "id")
    names = S.write_shapefile(df, str(tmp_path / "lots"), ZONES[2883])
    assert 1 <= len(names) <= 3 and {f.suffix for f in (tmp_path / "lots").iterdir()} == {".shp", ".shx", ".dbf", ".prj"}
    back = S.read_shapefile(spark, str(tmp_path / "lots"), records=10)
    assert back.rdd.getNumPartitions() >= 14
    assert back.dtypes[3:] == [("id", "bigint"), ("name", "string"), ("jv", "bigint"), ("value", "double")]
    got = {r["id"]: r for r in back.collect()}
    assert len(got) == 137
    for i, parts, name, jv, value in rows:
        assert same(plain(got[i]["parts"]), parts) and (got[i]["name"], got[i]["jv"], got[i]["value"]) == (name or None, jv, value)
    assert S.plane_of(str(tmp_path / "lots"), ZONES[2883]) == (ZONES[2883], None)
    found, warned = S.plane_of(str(tmp_path / "lots"), ZONES[2882])
    assert found == ZONES[2883] and warned


def test_centroids_in_the_plane(spark, tmp_path):
    from acrelens.functions.projection import _PYTHON, _plane

    x, y = _plane(_PYTHON, ZONES[2883], -87.2, 30.5)
    ell = [(x, y), (x, y + 90), (x + 30, y + 90), (x + 30, y + 30), (x + 90, y + 30), (x + 90, y)]  # 4500 square feet
    at = ((15 * 2700 + 60 * 1800) / 4500, (45 * 2700 + 15 * 1800) / 4500)
    rows = [(1, [(ell, [])]), (2, [(square(x, y, 30), [square(x + 10, y, 5)])]), (3, None), (4, [(square(x, y, 10), []), (square(x + 100, y, 20), [])])]
    df = spark.createDataFrame(rows, f"id long, parts {S.PARTS}")
    got = {r["id"]: r["c"] for r in df.select("id", S.centroid(F.col("parts")).alias("c")).collect()}
    wanted = {1: at, 2: (-10 * 100 / 3500, 0), 4: (100 * 1600 / 2000, 0)}
    assert got[3] is None and all(abs(got[i]["x"] - x - dx) < 1e-6 and abs(got[i]["y"] - y - dy) < 1e-6 for i, (dx, dy) in wanted.items())
    places = {r["id"]: (r["lon"], r["lat"]) for r in S.parcel_places(df, ZONES[2883]).collect()}
    assert set(places) == {1, 2, 4} and abs(places[4][0] - (-87.2 + 80 / (111_320 * 0.8616) * 0.3048)) < 1e-6


def test_a_file_of_another_hand(spark, tmp_path):
    """Heights behind the points, a hole before its outer ring, a record without shape, all kinds of attributes, no plane."""
    outer, hole = square(0, 0, 10) + [(-10, -10)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    points = hole + outer
    body = struct.pack("<i4dii", 15, -10, -10, 10, 10, 2, len(points)) + struct.pack("<2i", 0, len(hole)) + b"".join(struct.pack("<2d", *p) for p in points) + struct.pack(f"<2d{len(points)}d", 0, 0, *[0.0] * len(points))
    bodies = [body, struct.pack("<i", 0)]
    shp, shx = b"", b""
    for i, b in enumerate(bodies, 1):
        shx += struct.pack(">ii", (100 + len(shp)) // 2, len(b) // 2)
        shp += struct.pack(">ii", i, len(b) // 2) + b
    head = bytes(100)
    (tmp_path / "a.shp").write_bytes(head + shp)
    (tmp_path / "a.shx").write_bytes(head + shx)
    columns = [("PIN", "C", 6, 0), ("AREA", "N", 8, 2), ("SINCE", "D", 8, 0), ("OK", "L", 1, 0), ("F", "F", 10, 3)]
    width = 1 + sum(c[2] for c in columns)
    dbf = struct.pack("<4BIHH20x", 3, 1, 1, 1, 2, 33 + 32 * len(columns), width) + b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w, d]) + bytes(14) for n, k, w, d in columns) + b"\r"
    dbf += b" " + b"12-3  " + b"   45.50" + b"20240229" + b"T" + b"     1.250" + b" " + b"      " + b"********" + b"00000000" + b"?" + b"          "
    (tmp_path / "a.dbf").write_bytes(dbf)
    rows = S.read_shapefile(spark, str(tmp_path / "a.shp"), records=1).orderBy("record").collect()
    assert plain(rows[0]["parts"]) == [(outer[:-1], [hole[:-1]])] and rows[1]["parts"] is None
    assert tuple(rows[0])[3:] == ("12-3", 45.5, dt.date(2024, 2, 29), True, 1.25) and tuple(rows[1])[3:] == (None,) * 5
    found, warned = S.plane_of(str(tmp_path), ZONES[2883])
    assert found == ZONES[2883] and "expected" in warned
    (tmp_path / "a.prj").write_text(projection_text(ZONES[2882]))
    assert S.plane_of(str(tmp_path), ZONES[2883])[0] == ZONES[2882]


def test_points_are_refused_and_no_rows_write_nothing(spark, tmp_path):
    with pytest.raises(ValueError):
        S.polygons(struct.pack(">ii", 1, 10) + struct.pack("<i2d", 1, 0.0, 0.0), [0])
    empty = spark.createDataFrame([], f"id long, parts {S.PARTS}")
    assert S.write_shapefile(empty, str(tmp_path / "none")) == []


def test_a_centroid_is_worked_out_once(spark):
    """The plan of places holds the sums of rings once for outer rings and once for holes, and not again for each use of them."""
    import io
    from contextlib import redirect_stdout

    from acrelens.functions.projection import ZONES
    from acrelens.sources import shapefile as S

    shapes = spark.createDataFrame([(1, None)], f"id int, parts {S.PARTS}")
    out = io.StringIO()
    with redirect_stdout(out):
        S.parcel_places(shapes, ZONES[2883]).explain(mode="extended")
    physical = out.getvalue().split("== Physical Plan ==")[1]
    assert physical.count("aggregate(") <= 6
