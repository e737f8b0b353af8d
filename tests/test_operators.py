import math
import random

import pytest
from pyspark.sql import functions as F

from acrelens.operators import arv, filters, match, merge, search, spatial, workflow

PARCEL = "county_fips string, parcel_id string, dor_uc string, jv long, tot_lvg_area long, eff_yr_blt int, lat double, lon double, list_price long, qual_cd1 string, sale_prc1 long"
SALE = "county_fips string, parcel_id string, sale_price long, qualification_code string, instrument_type string"


def test_valuation_passes_and_floors(spark):
    at = lambda i: 30.4 + i * 0.002
    parcels = [("1", "s", "001", 1000, 1501, 2000, at(0), -87.0, 120000, None, None)]
    parcels += [("1", f"c{i}", "001", 5, 1000, 2000, at(i), -87.0, None, None, None) for i in range(1, 5)]
    parcels += [("1", "far", "001", 77, 1000, 2000, 31.4, -87.0, None, None, None), ("1", "lost", "001", 88, 1000, 2000, None, None, None, None, None), ("1", "none", "001", None, 1, 2000, at(0), -87.0, None, None, None)]
    parcels += [("2", "t", "001", 1000, 1500, 2000, at(0), -87.0, None, None, None)] + [("2", f"r{i}", "001", 5, 1000, 2005, at(i), -87.0, None, "01", p) for i, p in enumerate((100_000, 125_000, 200_000), 1)]
    sales = [("1", f"c{i}", p, q, "WD") for i, (p, q) in enumerate(((90_000, "Q"), (100_000, "C"), (125_000, None), (200_000, "Q")), 1)]
    sales += [("1", "c1", 9_000, "Q", "WD"), ("1", "s", 500_000, "Q", "WD"), ("2", "r1", 900_000, "U", "QC")]
    found = {r["parcel_id"]: r for r in arv.valuation(spark.createDataFrame(parcels, PARCEL), spark.createDataFrame(sales, SALE), arv.Settings(min_pool=3)).collect()}
    assert (found["s"]["arv_estimate"], found["s"]["arv_source"], found["s"]["comps"]) == (168863, "COMP", 4)
    assert found["s"]["arv_spread"] == 168863 - 120000 - 52535
    assert (found["t"]["arv_estimate"], found["t"]["arv_source"]) == (187500, "NAL_COMP")
    assert (found["far"]["arv_source"], found["far"]["arv_estimate"]) == ("JV_FALLBACK", 77)
    assert (found["lost"]["arv_source"], found["lost"]["arv_estimate"]) == ("JV_FALLBACK", 88)
    assert "none" not in found


def test_comparables_ranked_by_spot_give_what_pairs_give(spark, monkeypatch):
    """Counts and medians without a parcel's own sales, null prices and a repeated key too; pairs are made for that key only."""
    rng = random.Random(9)
    lots = [("1", f"p{i}", "001", rng.choice([1990, 1998, 2009]), 30.4 + rng.randrange(3) * 0.01, -87.0) for i in range(60)]
    lots += [("1", "p3", "001", 2009, 30.4, -87.0), ("1", None, "001", 1990, 30.4, -87.0), ("1", "q", "001", 1990, None, -87.0)]
    where = "county_fips string, parcel_id string, dor_uc string, eff_yr_blt int, lat double, lon double"
    sold = [(*rng.choice(lots), rng.choice([None, 0, 900, 1000]), rng.choice([50_000, 60_000, 75_000]), rng.choice(["Q", "U"])) for _ in range(250)]
    subjects, comps = spark.createDataFrame(lots, where), spark.createDataFrame(sold, where + ", tot_lvg_area long, price long, code string")
    tests, settings = {"strict": F.col("r.code") != "U", "wide": F.lit(True)}, arv.Settings()
    pairs = spatial.within_radius(subjects, comps, ["county_fips", "dor_uc"], 1.5 * spatial.MILE_M, "abs(l.eff_yr_blt - r.eff_yr_blt) <= 10 and l.parcel_id <> r.parcel_id")
    told = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    wanted, asked, summary = told(arv._summary(pairs, tests, "price")), [], arv._summary
    monkeypatch.setattr(arv, "_summary", lambda p, *a: asked.append({r["parcel_id"] for r in p.select("l.parcel_id").distinct().collect()}) or summary(p, *a))
    assert told(arv._near_by(subjects, comps, tests, "price", settings)) == wanted and len(wanted) == 60
    assert asked == [{"p3"}]


def apart(a, b):
    """The inverse geodesic on the ellipsoid, step after step until it stands still."""
    big, f = 6_378_137.0, 1 / 298.257223563
    small, (u, v), turn = big * (1 - f), (math.atan((1 - f) * math.tan(math.radians(x[1]))) for x in (a, b)), math.radians(b[2] - a[2])
    l = turn  # noqa: E741
    for _ in range(200):
        ss = math.hypot(math.cos(v) * math.sin(l), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(l))
        if ss == 0:
            return 0.0
        cs = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(l)
        s, sa = math.atan2(ss, cs), math.cos(u) * math.cos(v) * math.sin(l) / ss
        ca = 1 - sa * sa
        cm = cs - 2 * math.sin(u) * math.sin(v) / ca if ca > 1e-15 else 0.0
        c = f / 16 * ca * (4 + f * (4 - 3 * ca))
        before, l = l, turn + (1 - c) * f * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1)))  # noqa: E741
        if abs(l - before) < 1e-12:
            break
    w = ca * (big**2 - small**2) / small**2
    k1, k2 = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))), w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    return small * k1 * (s - k2 * ss * (cm + k2 / 4 * (cs * (2 * cm * cm - 1) - k2 / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))))


def test_cut_cells_give_the_same_pairs(spark):
    rng = random.Random(5)
    near = lambda at: rng.gauss(at, 0.002)
    spots = [(near(30.4), near(-87)) for _ in range(400)] + [(30.5, -87.1)] * 60 + [(30 + rng.random(), -87.5 + rng.random()) for _ in range(100)]
    spots += [(near(-10), near(-180) % 360 - 360 * (rng.random() < 0.5)) for _ in range(150)]
    rows = [(i, i % 2, lat, (lon + 180) % 360 - 180) for i, (lat, lon) in enumerate(spots)] + [(9_999, 0, None, -87.0), (9_998, None, 30.4, -87.0)]
    df = spark.createDataFrame(rows, "id int, k int, lat double, lon double")
    pairs = lambda n: sorted((r["l"]["id"], r["r"]["id"]) for r in spatial.within_radius(df, df, ["k"], 1500.0, "l.id <> r.id", n).select("l", "r").collect())
    assert pairs(16) == pairs(None) != []

    def crowd(n):
        _, held, on = spatial.dealt(df, df, ["k"], 1500.0, n)
        return held.groupBy(*on).count().agg(F.max("count")).first()[0], held.count()

    assert crowd(16)[1] == crowd(None)[1] == len(rows) - 1
    # A smallest cell of places on one spot is dealt by hash, so its parts are nearly even.
    assert crowd(16)[0] <= 32 < 128 < crowd(None)[0]


def test_neighbours_are_counted_without_pairs_of_one_place(spark):
    """Counts are those of the pairs, names on several spots and repeated rows too; 30,000 rows on one spot meet as one."""
    rng = random.Random(7)
    rows = [(rng.choice("ab"), f"p{rng.randrange(120)}", 30.4 + rng.randrange(8) * 0.004, -87 + rng.randrange(8) * 0.004) for _ in range(300)] + [("a", None, 30.4, -87.0), (None, "p1", 30.4, -87.0), ("a", "p1", None, -87.0), ("b", "far", 40.0, -87.0), ("b", "zero", 0.0, 0.0), ("b", "minus", -0.0, -0.0)]
    df = spark.createDataFrame(rows, "k string, id string, lat double, lon double")
    pairs = spatial.within_radius(df, df, ["k"], 700.0, "l.id <> r.id")
    wanted = {(r["k"], r["id"]): r["n"] for r in pairs.groupBy("l.k", "l.id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for cut in (None, 4):
        assert {(r["k"], r["id"]): r["neighbours"] for r in spatial.neighbour_counts(df, ["k"], "id", 700.0, cut).collect()} == wanted
    crowd = spark.range(30_000).selectExpr("'a' AS k", "id", "30.4D AS lat", "-87.0D AS lon")
    assert [tuple(r) for r in spatial.neighbour_counts(crowd, ["k"], "id", 700.0).groupBy("neighbours").count().collect()] == [(29_999, 30_000)]


def test_cut_cells_of_no_rows(spark):
    none = spark.createDataFrame([], "id int, k int, lat double, lon double")
    assert spatial.within_radius(none, none, ["k"], 1500.0, cell_rows=4).count() == 0


def test_radius_join_is_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, 30 + rng.random() * 0.3, -87 + rng.random() * 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k int, lat double, lon double")
    found = {(r["l"]["id"], r["r"]["id"]) for r in spatial.within_radius(df, df, ["k"], 3000.0, "l.id <> r.id").collect()}

    assert found == {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and apart(a[1:], b[1:]) <= 3000}


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    df = spark.createDataFrame([("v", ring)], "name string, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 0.5, 2.0), (2, 3.0, 2.0), (3, 3.0, 3.5), (4, 9.0, 9.0)], "id int, lat double, lon double")
    assert {r["id"] for r in spatial.any_containing(points, df, ["id"]).collect()} == {1, 3}
    area, centre = df.select(spatial.ring_area(F.col("ring")), spatial.ring_centroid(F.col("ring"))).first()
    assert area == 10.0 and abs(centre["lon"] - 2.0) < 1e-12


def test_criteria_and_reasons(spark):
    row = [("001", "1960", None, "0", "12.7", "27", "32501", "FL", "1 OAK ST", "1 OAK ST", "2")]
    df = spark.createDataFrame(row, "DOR_UC string, ACT_YR_BLT string, IMP_QUAL string, TOT_LVG_AREA string, JV string, CO_NO string, PHY_ZIPCD string, OWN_STATE string, OWN_ADDR2 string, PHY_ADDR1 string, DISTR_CD string")
    why = lambda **f: df.select(filters.rejection_reasons({"filters": f})).first()[0]
    assert why(dor_use_code={"include": [1]}, year_built={"min": 1970}, imp_qual={"min": 3}, living_area_sqft={"min": 5}, just_value={"max": 9}) == ["year_built_too_old", "living_area_missing", "just_value_missing"]
    assert why(dor_use_code={"include": []}, absentee_owner={"required": True}, disaster_code_present={"required": False}) == ["dor_uc_mismatch", "absentee_owner_required", "disaster_code_present"]
    assert why() == []
    parcels = spark.createDataFrame([(None, 1, None), (0, 2, 3.0), (25000, 3, 2.5)], "exmpt_01 int, bedrooms int, bathrooms double")
    kept = lambda **f: [r["bedrooms"] for r in filters.matching(parcels, filters.predicates({"filters": f})).collect()]
    assert kept(homestead_status={"required": False}) == [1, 2] and kept(homestead_status={"required": True}) == [3]
    assert kept(bathrooms={"exact": 3.0, "min": 9}) == [2] and kept(bedrooms={"min": 2}) == [2, 3] and kept(zip_codes={"include": []}) == [1, 2, 3]


def test_search_order_reverses_the_whole_key(spark):
    rows = [("1", "a", 0.5, 10), ("1", "b", 0.5, 10), ("2", "b", 0.5, 10), ("1", "c", None, 99), ("1", "d", 0.9, None)]
    df = spark.createDataFrame(rows, "county_fips string, parcel_id string, deal_score double, arv_spread long")
    ids = lambda *a: [(r["county_fips"], r["parcel_id"]) for r in search.page_of(df, {}, *a).orderBy("position").collect()]
    assert ids() == [("1", "d"), ("1", "b"), ("2", "b"), ("1", "a"), ("1", "c")]
    assert ids("deal_score", "ASC") == [("1", "c"), ("1", "a"), ("1", "b"), ("2", "b"), ("1", "d")]
    assert ids("unknown", "ASC") == ids()
    assert len(search.page_of(df, {"filters": {"max_results": {"value": 3}}}, page=2, size=2).collect()) == 1


def test_address_levels(spark):
    parcels = [("1", "p1", "4831 OLIVE RD", "32501"), ("1", "p2", "4831 OLIVE RD 4A", "32501"), ("1", "p3", "9 ELM ST 1", None), ("1", "p4", "9 ELM ST 2", None), ("1", "p5", "77 BAY VIEW LN", None), ("2", "p6", "5 OAK ST", None)]
    listings = [(1, "1", "4831 Olive Road", "32501"), (2, "1", "4831 Olive Rd Apt 4A", None), (3, "1", "9 Elm Street", None), (4, "1", "77 Bay View", ""), (5, "1", "5 Oak St", None), (6, "1", None, None)]
    found = {r["listing_id"]: (r["parcel_id"], r["level"], r["review"]) for r in match.by_address(spark.createDataFrame(listings, "listing_id int, county_fips string, address string, zip string"), spark.createDataFrame(parcels, "county_fips string, parcel_id string, phy_addr1 string, phy_zipcd string")).collect()}
    assert found == {1: ("p1", 1, None), 2: ("p1", 2, None), 3: (None, None, "p3,p4"), 4: ("p5", 5, None), 5: (None, None, None), 6: (None, None, None)}


def test_an_address_that_many_ask_for_meets_the_roll_once(spark):
    """40,000 listings of one address and 4,000 parcels that begin so: pairs would be 160 million."""
    listings = spark.range(40_000).selectExpr("id AS listing_id", "'1' AS county_fips", "'9 Elm Street' AS address", "if(id % 2 = 0, null, if(id % 4 = 1, '32501', '1')) AS zip")
    parcels = spark.range(4_000).selectExpr("'1' AS county_fips", "cast(id % 2000 AS string) AS parcel_id", "concat('9 ELM ST ', id) AS phy_addr1", "if(id = 7, '32501', null) AS phy_zipcd")
    found = match.by_address(listings, parcels).groupBy("level", "parcel_id", F.length("review").alias("length")).count().collect()
    length = sum(len(str(i)) for i in range(2000)) + 1999
    assert sorted(map(tuple, found), key=str) == sorted([(None, None, length, 20_000), (5, "7", None, 10_000), (None, None, None, 10_000)], key=str)


def test_likeness(spark):
    q = spark.createDataFrame([(1, "1", "OAK ST 12"), (2, "1", "zzz")], "query_id int, county_fips string, text string")
    c = spark.createDataFrame([("a", "1", "12 OAK STR"), ("b", "1", "12 ELM ST"), ("c", "2", "12 OAK ST")], "choice_id string, county_fips string, text string")
    assert [tuple(r)[:2] for r in match.by_likeness(q, c, 88.0).collect()] == [(1, "a")]


def test_merges(spark):
    now = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 7), (None, "z", 0)], "k int, x string, y int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(merge.upsert(now, new, ["k"], {"y"})) == [(1, "a", 5), (2, None, None), (3, "c", None)]
    assert rows(merge.fill_nulls(now, new, ["k"], ["x", "y"])) == [(1, "a", 5), (2, "b", 9)]
    assert rows(merge.replace_columns(now, new, ["k"], ["x"])) == [(1, "a", 5), (2, None, None)]
    assert rows(merge.upsert_changed(now, new.filter("k is not null"), ["k"], ["y"])) == [(1, "a", 5, "kept"), (2, "b", 9, "updated"), (3, "c", 7, "inserted")]


def test_workflow(spark):
    events = spark.createDataFrame([(1, None, None), (2, "CLOSED", "x"), (3, "SENT", "x")], "id int, workflow_status string, notes string")
    asked = spark.createDataFrame([(1, "REVIEWED", "n"), (2, "NEW", "n"), (3, "CLOSED", "n")], "id int, new_status string, note string")
    assert sorted(map(tuple, workflow.apply_changes(events, asked).collect())) == [(1, "REVIEWED", "n", True), (2, "CLOSED", "x", False), (3, "CLOSED", "x\nn", True)]


def test_likeness_loses_no_pair(spark):
    rng = random.Random(3)
    base = [f"{rng.randrange(1, 400)} {rng.choice('OAK PALAFOX HILL PINE N'.split())} {rng.choice('ST AVE RD'.split())}" for _ in range(60)]

    def typo(t):
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "X", "QQ"]) + t[at + rng.randrange(2) :]
        return t

    texts = [*base, *map(typo, base), "A", "AB", "", "ST", "100 PALAFOXX", "1001 PALAFOX", "LOT 5 LOT 5 LOT 5"]
    q = [(i, "1" if i % 5 else "2", typo(t)) for i, t in enumerate(texts)]
    c = [(f"c{i:03}", "1" if i % 4 else "2", t) for i, t in enumerate(texts)]
    words = lambda t: " ".join(sorted(t.upper().split()))
    a = spark.createDataFrame(q, "query_id int, county_fips string, text string")
    b = spark.createDataFrame(c, "choice_id string, county_fips string, text string")
    for least in (88.0, 72.0, 95.0):
        best = {}
        for i, county, t in q:
            for j, other, u in c:
                if county == other and (words(t) or words(u)):
                    x, y = words(t), words(u)
                    score = match.likeness(x, y)
                    assert score == pytest.approx(100.0 * difflib_free_ratio(x, y))
                    if score >= least:
                        best[i] = max(best.get(i, (0.0, "")), (score, j))
        found = {r["query_id"]: (r["score"], r["choice_id"]) for r in match.by_likeness(a, b, least).collect()}
        assert found == best
        assert len(best) > 20


def test_equal_texts_are_compared_once(spark):
    """100,000 queries of 40 texts and 60,000 choices of 30: pairs of rows would be hundreds of millions."""
    q = spark.range(100_000).selectExpr("id AS query_id", "'1' AS county_fips", "concat(id % 40, ' PALAFOX ', if(id % 2 = 0, 'STR', 'ST')) AS text")
    c = spark.range(60_000).selectExpr("lpad(cast(id AS string), 6, '0') AS choice_id", "'1' AS county_fips", "concat('PALAFOX ST ', id % 30) AS text")
    found = match.by_likeness(q, c, 72.0)
    told = found.groupBy((F.col("query_id") % 40).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("choice_id").alias("a"), F.max("choice_id").alias("b")).collect()
    assert len(told) == 40 and all(r["n"] == 2500 and r["a"] == r["b"] >= "059970" for r in told)
    assert {r["k"]: r["a"] for r in told if r["k"] < 30} == {k: f"{59_970 + k:06}" for k in range(30)}


def difflib_free_ratio(x, y):
    row = [0] * (len(y) + 1)
    for p in x:
        before = row[:]
        for k, r in enumerate(y, 1):
            row[k] = before[k - 1] + 1 if p == r else max(before[k], row[k - 1])
    return 2 * row[-1] / (len(x) + len(y))


def test_court_records_by_lot_then_section(spark):
    legal = "case_number string, lot string, block string, subdivision string, sec string, twp string, rge string"
    records = spark.createDataFrame(
        [(1, "1", (None, "5/6", "B2", "PINE HILLS", None, None, None)), (2, "1", (None, None, None, "PINE HILS UNIT 4", "3", "2N", "30W")), (3, "1", (None, None, None, "ZZZ", "3", "2S", "30W")), (4, "1", (None,) * 7), (5, "1", (None, "9", "Q", "ELSEWHERE", None, None, None))],
        f"record_id int, county_fips string, legal struct<{legal.replace(' string', ':string')}>",
    )
    parcels = spark.createDataFrame([("1", "a", "LTS 5 6 BLK B2 PINE HILLS", "1", "1N", "1W"), ("1", "b", "PINE HILLS UNIT 4", "3", "2N", "30W"), ("1", "c", None, "4", "4N", "4W"), ("2", "d", "LOT 9 BLK Q ELSEWHERE", "5", "5N", "5W")], "county_fips string, parcel_id string, s_legal string, sec string, twn string, rng string")
    found = {r["record_id"]: (r["parcel_id"], r["method"]) for r in match.by_court_record(records, parcels).collect()}
    assert found == {1: ("a", "fuzzy_legal"), 2: ("b", "fuzzy_legal"), 3: ("b", "str"), 4: (None, "no_match"), 5: (None, "no_match")}


def test_sections_as_written_then_without_their_directions(spark):
    parcels = [("a", "3", "2N", "30W"), ("b", "3", "2S", "30W"), ("c", "4", "1N", "9W"), ("d", "4", "1N", "9W"), ("e", "4", "1", "9"), ("f", "5", "6", "7E "), ("g", "6", "1N", "1W"), ("h", "6", "1S", "1W"), ("i", "6", "1S", "1W"), ("j", "", "1", "1"), ("k", None, "1", "1")]
    wanted = {
        ("3", "2N", "30W"): ("a", "str"), ("3", "2S", "30W"): ("b", "str"), ("3", "2", "30"): ("a", "str"), ("4", "1N", "9W"): (None, "str_ambiguous"), ("4", "1S", "9W"): ("e", "str"), ("4", "1", "9"): ("e", "str"),
        (" 5 ", "6N", "7E"): ("f", "str"), ("5", "6", "7N"): None, ("6", "1", "1"): ("g", "str"), ("6", "1S", "1W"): (None, "str_ambiguous"), ("", "1", "1"): None, (None, "1", "1"): None, ("9", "9", "9"): None,
    }
    records = spark.createDataFrame([(i, "1", *k) for i, k in enumerate(wanted)] + [(99, "2", "3", "2N", "30W")], "record_id int, county_fips string, sec string, twp string, rge string")
    roll = spark.createDataFrame([("1", *p) for p in parcels], "county_fips string, parcel_id string, sec string, twn string, rng string")
    found = {r["record_id"]: (r["parcel_id"], r["method"]) for r in match.by_section(records, roll).collect()}
    assert found == {i: w for i, w in enumerate(wanted.values()) if w}


def test_circles_over_poles_and_the_date_line_and_far_places(spark):
    rng = random.Random(4)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(60, 89.9, 10.0), (61, 89.8, -170.0), (62, 10.0, 179.99), (63, 10.0, -179.99), (64, -60.0, 179.9), (65, 0.0, 0.0)]
    places = [(f"p{i:02}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(12)] + [("pole", 90.0, 0.0), ("line", 10.0, -179.999)]

    points = spark.createDataFrame(spots, "id int, lat double, lon double")
    for metres in (3_000.0, 50_000.0, 900_000.0, 9_000_000.0):
        pairs = {(r["l"]["id"], r["r"]["id"]) for r in spatial.within_radius(points, points, [], metres).collect()}
        assert pairs == {(a[0], b[0]) for a in spots for b in spots if apart(a, b) <= metres}
    found = {r["id"]: r["name"] for r in spatial.nearest_place(points, spark.createDataFrame(places, "name string, lat double, lon double"), ["id"]).collect()}
    assert found == {s[0]: min(places, key=lambda p: (apart(s, p), p[0]))[0] for s in spots}


def test_radius_on_the_ellipsoid(spark):
    """North the sphere is too long, east too short: pairs between the two distances go by the ellipsoid's."""
    at = spark.createDataFrame([(0, 30.5, -87.2)], "id int, lat double, lon double")
    other = spark.createDataFrame([(1, 30.5217, -87.2), (2, 30.5, -87.1749), (3, 30.5215, -87.2), (4, 30.5, -87.17)], "id int, lat double, lon double")
    found = {r["r"]["id"] for r in spatial.within_radius(at, other, [], 2407.0).collect()}
    assert found == {1, 3}
    flat = spark.createDataFrame([(0, 30.5, -87.2, i, a, b) for i, a, b in [(1, 30.5217, -87.2), (2, 30.5, -87.1749)]], "x int, lat double, lon double, id int, a double, b double")
    on_sphere = {r["id"] for r in flat.filter(spatial.distance_m(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")) <= 2407.0).collect()}
    assert on_sphere == {2}


def test_slabs_tell_what_whole_rings_tell(spark):
    """Stars of 20,000 corners with a hole, whose sides are each in few bands; work per point falls with the bands."""
    rng = random.Random(11)

    def star(lat, lon, far, n):
        turns = [2 * math.pi * i / n for i in range(n)]
        return [(lon + far * rng.uniform(0.5, 1) * math.cos(t), lat + far * rng.uniform(0.5, 1) * math.sin(t)) for t in turns]

    shapes = [(f"s{i}", star(30 + i / 10, -87, 0.4, 20_000 if i == 0 else 300), [star(30 + i / 10, -87, 0.1, 50)] if i % 2 == 0 else []) for i in range(4)]
    ring = "array<struct<lon:double,lat:double>>"
    polygons = spark.createDataFrame(shapes, f"name string, ring {ring}, holes array<{ring}>")
    points = spark.createDataFrame([(i, rng.uniform(29.5, 30.8), rng.uniform(-87.5, -86.5)) for i in range(250)] + [(900, 30.0, -87.0), (901, -5.0, 3.0)], "id int, lat double, lon double")
    told = lambda df: {(r["id"], r["name"]) for r in df.collect()}
    whole = told(spatial.containing(points, polygons, ["id"]))
    assert told(spatial.containing_by_slabs(points, polygons, ["id"], band=0.01)) == whole and len(whole) > 100
    assert told(spatial.containing_by_slabs(points, polygons.drop("holes"), ["id"], band=0.3)) == told(spatial.containing(points, polygons.drop("holes"), ["id"]))
    round_one = spark.createDataFrame([("r", [(-87 + math.cos(i / 3000), 30 + math.sin(i / 3000)) for i in range(18_849)], [])], f"shape string, ring {ring}, holes array<{ring}>")
    met = lambda band: spatial.edges(round_one, band).groupBy("shape", "slab").count().agg(F.avg("count")).first()[0]
    assert met(0.01) < met(0.1) / 4


def test_points_of_one_spot_meet_the_sides_once(spark):
    """Rows that repeat a point are told like any other, and 200,000 points on one spot are one for 20,000 sides in a band."""
    flat = [(-87 + i / 20_000, 30.0 + (i % 2) * 1e-4) for i in range(20_000)] + [(-86.0, 30.5), (-87.0, 30.5)]
    polygons = spark.createDataFrame([("w", flat)], "name string, ring array<struct<lon:double,lat:double>>")
    twice = spark.createDataFrame([(1, 30.2, -86.5), (1, 30.2, -86.5), (2, 31.0, -86.5)], "id int, lat double, lon double")
    assert [r["id"] for r in spatial.containing_by_slabs(twice, polygons, ["id"]).collect()] == [1, 1]
    crowd = spark.range(200_000).selectExpr("id", "30.00005D AS lat", "-86.50003D AS lon")
    assert spatial.containing_by_slabs(crowd, polygons, ["id"]).count() in (0, 200_000)


def test_deep_pages_are_those_of_the_whole_order(spark):
    rng = random.Random(13)
    rows = [("1", str(i), None if rng.random() < 0.1 else rng.randrange(5) / 4, rng.choice([None, 1, 2])) for i in range(203)]
    df = spark.createDataFrame(rows, "county_fips string, parcel_id string, deal_score double, arv_spread long").repartition(5)
    for direction in ("DESC", "ASC"):
        for page, size in ((1, 10), (7, 25), (9, 25), (21, 10), (30, 10)):
            told = lambda d: sorted((r["position"], r["parcel_id"]) for r in d.collect())
            assert told(search.deep_page_of(df, {}, direction=direction, page=page, size=size, ranges=7)) == told(search.page_of(df, {}, direction=direction, page=page, size=size))
    last = search.deep_page_of(df, {}, ranges=7).collect()
    assert sorted(r["position"] for r in last) == [201, 202, 203]
    capped = search.deep_page_of(df, {"filters": {"max_results": {"value": 33}}}, size=10, ranges=3).collect()
    assert sorted(r["position"] for r in capped) == [31, 32, 33]
    assert search.deep_page_of(df.limit(0), {}).collect() == []
