import datetime as dt
import json

from pyspark.sql import functions as F

import pytest

from acrelens.operators import spatial
from acrelens.sources import files, pages
from acrelens.streaming import signals


def test_roll(spark, tmp_path):
    (tmp_path / "NAL1.csv").write_text('PARCEL_ID,JV,DOR_UC,OWN_STATE,EXTRA\n 01-2 ,"100.9",1,GA,n/a\n,5,2,FL,x\n')
    roll = files.read_roll(spark, str(tmp_path / "NAL*.csv"))
    rows = files.parcels_of_roll(roll, "12033").collect()
    assert [(r["parcel_id"], r["jv"], r["dor_uc"], r["absentee_owner"], r["county_fips"]) for r in rows] == [("01-2", 100, "001", True, "12033")]
    assert "EXTRA" not in json.loads(rows[0]["raw_nal_json"])
    assert files.roll_path("/d", "12113", {"12113": "Santa Rosa"}) == "/d/12113_santa_rosa/nal/NAL*.csv"
    with pytest.raises(KeyError):
        files.roll_path("/d", "1", {})


def test_key_value_blocks(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes('junk,1\nAuction Starts,"05/07/2024 11:00"\nCase #:,2024 CA 1\nParcel ID:,1-2\nFinal Judgment Amount:,"$1,234.56"\nProperty Address:,"1 Peña Rd"\n,"Pace, FL"\nAuction Starts,06/01/2024\nCase Number:,B\nParcel ID:,3\nAuction Starts,none\nCase #:,C\n'.encode("latin-1"))
    rows = sorted(files.read_foreclosures(spark, str(tmp_path / "f.csv")).collect(), key=lambda r: r["block"])
    assert [(r["case_number"], r["judgment"], r["street"], r["city_state_zip"], r["auction_date"]) for r in rows] == [("2024 CA 1", 1234, "1 Peña Rd", "Pace, FL", dt.date(2024, 5, 7)), ("B", None, None, None, dt.date(2024, 6, 1))]


def test_listing_lines(spark, tmp_path):
    (tmp_path / "l.csv").write_text('﻿noise\n"$224,900"\n3 bds2 ba1,319 sqftForeclosure\n"12 Oak St, Pace, FL 32571"\nBIG REALTY\n$1\n', encoding="utf-8")
    rows = sorted(files.read_listings(spark, str(tmp_path / "l.csv")).collect(), key=lambda r: r["block"])
    assert (rows[0]["list_price"], rows[0]["bedrooms"], rows[0]["living_area"], rows[0]["zip"], rows[0]["street"], rows[0]["brokerage"]) == (224900, 3, 1319, "32571", "12 Oak St", "BIG REALTY")
    assert rows[1]["list_price"] == 1 and rows[1]["address"] is None


def test_blocks_go_on_over_the_edges_of_splits(spark, tmp_path):
    lines = ["junk,0"]
    for i in range(120):
        lines += [f"Auction Starts,05/{1 + i % 28:02}/2024", f"Case #:,C{i}", f"Parcel ID:,{i}", "Property Address:," + "x" * (i % 50), ',"Pace, FL"']
    text = "\r\n".join(lines)
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("Auction Starts,05/07/2024\nCase #:,only\nParcel ID:,b\n")
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    seen = []
    for size in (str(1 << 27), str(max(64, len(text) // 10))):
        for name, value in zip(settings, (size, "0", "1")):
            spark.conf.set(name, value)
        try:
            rows = files.read_foreclosures(spark, str(tmp_path / "*.csv"))
            places = files._lines(spark, str(tmp_path / "a.csv"), "UTF-8").select("split").distinct().count()
            seen.append((places, sorted(map(str, rows.collect()))))
        finally:
            for name in settings:
                spark.conf.unset(name)
    assert seen[0][0] == 1 and seen[1][0] >= 10
    assert seen[0][1] == seen[1][1] and len(seen[0][1]) == 121


def test_auctions_and_polygons(spark, tmp_path):
    asset = {"id": "1", "address": {"street": "1 A", "city": "P", "county": "Escambia", "state": "FL", "zip": "1"}, "bid": 0, "value": 5, "asset_type": "REO", "auction_at": "2024-05-07T10:00:00Z"}
    (tmp_path / "a.json").write_text(json.dumps(asset) + "\n" + json.dumps(asset | {"address": asset["address"] | {"state": "GA"}}))
    rows = files.read_auctions(spark, str(tmp_path / "a.json")).collect()
    assert [(r["bid"], r["value"], r["signal_type"], r["auction_date"]) for r in rows] == [(None, 5, "reo", dt.date(2024, 5, 7))]
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": "Pace"}, "geometry": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(shape))
    assert [(r["name"], len(r["ring"])) for r in files.read_polygons(spark, str(tmp_path / "p.geojson")).collect()] == [("Pace", 3)]


HTML = """<b>EXTERIOR WALL</b>-<i>BRICK</i><b>ROOF COVER</b>-<i>COMP SHNGL</i><b>EXTERIOR WALL</b>-<i>VINYL</i> Zoning: <span>R-1</span> Year Built: <b>1984</b>
<table><tr><th>Sale Date</th><th>Value</th><th>Type</th></tr><tr><td>05/2020</td><td>$100,000</td><td>WD</td></tr><tr><td></td><td>$1</td><td>QC</td></tr><tr><td colspan=3>foot</td></tr></table>
<script>window.__remixContext = {"a": {"b": 1}};</script>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, HTML), (2, "Please solve the CAPTCHA"), (3, None)], "page_id int, html string")
    row = pages.building_of(df.filter("page_id = 1")).first()
    assert (row["exterior_wall"], row["roof_type"], row["zoning"], row["act_yr_blt"]) == ("BRICK / VINYL", "COMP SHNGL", "R-1", "1984")
    assert [(r["sale_date"], r["sale_price"], r["instrument_type"]) for r in pages.sales_of(df).collect()] == [(dt.date(2020, 5, 1), 100000, "WD")]
    assert json.loads(df.select(pages.embedded_json(df["html"])).first()[0]) == {"a": {"b": 1}}


def test_kinds_of_pages(spark):
    good = "<b>Parcel ID:</b> 1 General Information"
    rows = [
        (1, "12033", good, None, "OK"), (2, "12033", "<p>Welcome to the portal</p>", None, "SOFT_BLOCK"), (3, "12033", "", None, "SOFT_BLOCK"), (4, "12033", None, None, "TRANSIENT"), (5, "12033", "Parcel ID: 7", [], "TRANSIENT"),
        (6, "12033", good, ["https://www.escpa.org/CAMA/Search.aspx?x=1"], "NOT_FOUND"), (7, "12033", good, ["https://a.org/b", "https://ESCPA.org/"], "SOFT_BLOCK"), (8, "12033", good, ["https://escpa.org/cama"], "OK"), (9, "12033", "x", ["https://escpa.org", "/cama/search.aspx"], "NOT_FOUND"),
        (10, "12113", "window.__remixContext = {}", None, "OK"), (11, "12113", 'window.__remixContext = {"empty":true}', None, "NOT_FOUND"), (12, "12113", 'window.__remixContext = {"empty": true}', None, "NOT_FOUND"), (13, "12113", '{"empty":true}', None, "SOFT_BLOCK"), (14, "12001", good, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, county string, html string, redirects array<string>, kind string")
    assert df.filter(~pages.county_page_kind(F.col("county"), F.col("html"), F.col("redirects")).eqNullSafe(F.col("kind"))).collect() == []


def test_stream_appends_each_signal_once(spark, tmp_path):
    rows = [(i % 3, dt.datetime(2024, 1, 1, i)) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp")
    source = str(tmp_path / "in")
    df.write.parquet(source)
    run = lambda: signals.append_to(signals.once_each(signals.read_signals(spark, source, df.schema), ["id"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    df.write.mode("append").parquet(source)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_polygons_of_several_parts_and_with_holes(spark, tmp_path):
    square = lambda x, y, half: [[x - half, y - half], [x + half, y - half], [x + half, y + half], [x - half, y + half], [x - half, y - half]]
    features = [
        {"type": "Feature", "properties": {"NAME": "ring"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 2), square(0, 0, 1)]}},
        {"type": "Feature", "properties": {"NAME": "isles"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(5, 0, 1)], [square(9, 0, 1), square(9, 0, 0.5)]]}},
        {"type": "Feature", "properties": {"NAME": "point"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "whole.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "lines.geojson").write_text("\n".join(map(json.dumps, features)))
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.5), (3, 0.2, 5.1), (4, 0.1, 9.1), (5, 0.7, 9.6), (6, 0.0, 7.0)], "id int, lat double, lon double")
    for name, lines in (("whole", False), ("lines", True)):
        rows = files.read_polygons(spark, str(tmp_path / f"{name}.geojson"), lines)
        assert sorted((r["name"], round(r["area"], 6)) for r in rows.collect()) == [("isles", 7.0), ("isles", 7.0), ("ring", 12.0)]
        assert {r["id"]: r["name"] for r in spatial.largest_containing(points, rows, ["id"]).collect()} == {2: "ring", 3: "isles", 5: "isles"}


def test_zip_codes_of_auctions_are_no_other_numbers(spark):
    item = lambda address, rest: f'<div class="AUCTION_ITEM"><div class="ad_addr">{address}</div>{rest}</div>'
    case = '<span class="caseNo">2024 CA 32505</span> Opening Bid: $32,506 or $32507,000'
    htmls = [item("32510 OAK ST", " Pensacola FL 32501 " + case), item("32510 OAK ST", " Pensacola FL 32545 " + case), item("32510 OAK ST", case), item("32510 OAK ST", " Pace 32502 " + case), item("9 OAK ST, Pace, FL 32503", case), item("32510 OAK ST 32504", case)]
    landed = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id int, html string")
    assert [r["zip"] for r in pages.auction_items_of(landed).orderBy("page_id").collect()] == ["32501", None, None, "32502", "32503", "32504"]
