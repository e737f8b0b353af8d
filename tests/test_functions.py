import datetime as dt

import pytest
from pyspark.sql import functions as F

from acrelens.functions import parcel as P
from acrelens.functions import text as X

ADDRESSES = {
    "110 FRISCO ROAD": "110 FRISCO RD",
    "2983 North Highway 95 A": "2983 N HWY 95 A",
    "905 N 74th Ave": "905 N 74TH AVE",
    "2301W MICHIGAN AVE": "2301 W MICHIGAN AVE",
    "100 HWY 95A": "100 HWY 95 A",
    "100 OAK NORTH DR": "100 OAK NORTH DR",
    "100 NORTH SOUTH ST": "100 NORTH SOUTH ST",
    "2301 W MICHIGAN AVE 51": "2301 W MICHIGAN AVE 51",
    "": "",
    None: "",
}
ADDRESSES |= {f"123 OAK ST {u}": "123 OAK ST" for u in ("APT 4", "APT. 4", "UNIT B", "STE 100", "SUITE 2A", "#4", "# 4")}
ADDRESSES |= {f"12 OAK ST {u}": f"12 OAK ST {v}" for u, v in (("APT4", "APT4"), ("APT.4B", "APT.4 B"), ("UNIT5", "UNIT5"), ("APTOS", "APTOS"))}
ADDRESSES |= {f"9 ELM {full}": f"9 ELM {short}" for full, short in X.SUFFIXES.items()}
ADDRESSES |= {f"9 {full} ELM ST": f"9 {short} ELM ST" for full, short in X.COMPASS.items()}


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_addresses_take_the_rolls_spelling(spark):
    found = values(spark, [(a,) for a in ADDRESSES], "a string", X.street_address(F.col("a")), X.street_address(X.street_address(F.col("a"))))
    assert found == [(b, b) for b in ADDRESSES.values()]
    kept = values(spark, [("4831 Olive Road #4A",), ("4831 olive rd apt 4a",), ("12B oak st",)], "a string", X.street_address(F.col("a"), strip_unit=False))
    assert kept == [("4831 OLIVE RD #4A",), ("4831 OLIVE RD APT 4A",), ("12 B OAK ST",)]


def test_address_order(spark):
    rows = [("20 OAK ST",), ("3 OAK ST",), ("5 N OAK ST",), ("1 ASH AVE",), (None,), ("OAK",), ("7 BROADWAY",)]
    df = spark.createDataFrame(rows, "a string")
    up = [r[0] for r in df.orderBy(X.address_order(F.col("a"))).collect()]
    assert up == ["1 ASH AVE", "7 BROADWAY", "OAK", "3 OAK ST", "20 OAK ST", "5 N OAK ST", None]
    down = [r[0] for r in df.orderBy(X.address_order(F.col("a"), descending=True).desc()).collect()]
    assert down == up[-2::-1] + [None]


def test_text_parsers(spark):
    one = lambda *c: values(spark, [(0,)], "x int", *c)[0]
    assert one(X.money(F.lit("$225,000")), X.money(F.lit("n/a")), X.number(F.lit("1,319 sqft"))) == (225000.0, None, 1319.0)
    assert one(X.padded_parcel_id(F.lit("12-34 56"))) == ("0" * 12 + "123456",)
    assert one(X.clean_text(F.lit("  a \n b ")), X.first_non_empty(F.lit(" "), F.lit(None).cast("string"), F.lit(" x ")), X.keyword_text(F.lit("A"), F.lit(" B"))) == ("a b", "x", "a b")
    assert one(X.sale_date(F.lit("05/2020")), X.sale_date(F.lit("5/7/2020")), X.sale_date(F.lit(""))) == (dt.date(2020, 5, 1), dt.date(2020, 5, 7), None)
    assert one(X.auction_date(F.lit("May 7 2024")), X.auction_date(F.lit("May 7, 2024"))) == (dt.date(2024, 5, 7), dt.date(2024, 5, 7))
    facts = X.listing_facts(F.lit("$224,900.00"), F.lit("3 bds2 ba1,319 sqftForeclosure"), F.lit("12 Oak St, Pace, FL 32571"))
    assert one(*facts.values()) == (224900, 3, 2.0, 1319, "Foreclosure", "32571", "12 Oak St")
    legal = X.legal_parts(F.lit("CN:2026 CA 000134\nLOT:22 BLK:39 SUB:MONTCLAIR UN 7"))
    assert tuple(one(legal)[0]) == ("2026 CA 000134", "22", "39", "MONTCLAIR UN 7", None, None, None)
    assert tuple(one(X.legal_parts(F.lit("SEC:15 TWP:3N RGE:31W")))[0])[4:] == ("15", "3N", "31W")
    assert one(X.owner_name(F.lit("FIRST BANK NA\n JANE DOE ")), X.owner_name(F.lit("A BANK\nB TRUST")), X.owner_name(F.lit(None).cast("string"))) == ("JANE DOE", "A BANK", "")
    assert one(X.rendered(F.lit("Dear {{ name }}, {{x}}{{gone}}!"), {"name": F.lit("A$1"), "x": F.lit(5)})) == ("Dear A$1, 5!",)


def test_coercions(spark):
    rows = [("0",), ("12.7",), ("-3",), ("x",), (None,), ("1",), ("093",), ("A",), ("1234",)]
    found = values(spark, rows, "a string", P.roll_int(F.col("a")), P.filter_int(F.col("a")), P.use_code(F.col("a")))
    assert found == [(None, None, "000"), (12, None, None), (-3, None, "-03"), (None, None, None), (None, None, None), (1, 1, "001"), (93, 93, "093"), (None, None, None), (1234, 1234, "1234")]


def test_building_guards(spark):
    row = [("1700", "0", "0", "25", "0.1", None, None, None, None, None, None), ("1990", "2000", "1,500 sf", "3", "2.5", " BRICK ", "", "x", "R1", "A", "B")]
    names = "act_yr_blt eff_yr_blt living_area bedrooms bathrooms exterior_wall roof_type foundation zoning quality_code condition_code".split()
    facts, refused = P.building_facts(F.lit(2026))
    found = spark.createDataFrame(row, ", ".join(f"{n} string" for n in names)).select(*[c.alias(n) for n, c in facts.items()], refused.alias("refused")).collect()
    assert sorted(found[0]["refused"]) == ["act_yr_blt", "bathrooms", "bedrooms", "tot_lvg_area"] and found[0]["tot_lvg_area"] is None
    assert (found[1]["tot_lvg_area"], found[1]["bathrooms"], found[1]["exterior_wall"], found[1]["roof_type"], found[1]["refused"]) == (1500, 2.5, "BRICK", None, [])


@pytest.mark.parametrize(
    ("row", "score"),
    [((50000, 200000, 1, 73, True), 0.595 / 1.0), ((50000, 200000, None, None, None), 0.25), ((None, 200000, None, None, True), 1.0), ((-10, 200000, None, None, False), 0.0), ((None, 200000, 4, 400, False), 0.0), ((None, None, None, None, None), None)],
)
def test_deal_score_vectors(spark, row, score):
    weights = {"arv_spread_score": 0.5, "signal_tier_score": 0.25, "dom_score": 0.15, "absentee_score": 0.10}
    columns = [F.col(c) for c in ("s", "jv", "t", "d", "a")]
    schema = "s long, jv long, t int, d int, a boolean"
    assert values(spark, [row], schema, P.deal_score(weights, *columns))[0][0] == (pytest.approx(score) if score is not None else None)
    assert values(spark, [row], schema, P.deal_score({}, *columns))[0][0] is None


def test_absentee_vectors(spark):
    rows = [("GA", "", "1 OAK ST"), ("FL", "", "1 OAK ST"), ("FL", "PO BOX 9", None), ("FL", "1 OAK ST", "1 oak st "), ("FL", "C/O BANK", "1 OAK ST"), (None, "2 OAK ST", "1 OAK ST"), ("FL", "2 OAK ST", "")]
    found = values(spark, rows, "s string, m string, p string", P.absentee(F.col("s"), F.col("m"), F.col("p")))
    assert [f[0] for f in found] == [True, None, True, False, None, True, None]


def test_improvement_ratio_vectors(spark):
    rows = [(100, 0), (100, None), (None, 50), (None, None), (150, 100), (20_000_000, 1), (10, -1), (-20_000_000, 1)]
    found = values(spark, rows, "v long, l long", P.improvement_ratio(F.col("v"), F.col("l")))
    assert [f[0] for f in found] == [None, None, None, None, 0.5, 9999.9999, -11.0, -9999.9999]


def test_spread_vectors(spark):
    found = values(spark, [(187500, 120000, 1500), (187500, None, 1500), (187500, 120000, 0)], "e long, l long, a long", P.spread(F.col("e"), F.col("l"), F.col("a"), 35.0))
    assert [f[0] for f in found] == [15000, None, None]
