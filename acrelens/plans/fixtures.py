"""Parcels, sales, signals and roll rows made from the driver's tables.

The expressions are in the dialect that Spark and DuckDB share, so a query and its
SQL twin start from the same rows and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acrelens.scratch import dealt

_COUNTY = "CASE WHEN {k} % 2 = 0 THEN '12033' ELSE '12113' END"
_STREET = "CASE {k} % 6 WHEN 0 THEN 'OAK' WHEN 1 THEN 'PALAFOX' WHEN 2 THEN '9TH' WHEN 3 THEN 'BAY VIEW' WHEN 4 THEN 'HWY 95A' ELSE 'OLIVE' END"

TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "parcels": (
        "customer",
        {
            "county_fips": _COUNTY.format(k="c_custkey"),
            "parcel_id": "CAST(c_custkey AS STRING)",
            "dor_uc": "CASE WHEN c_custkey % 5 = 4 THEN '002' ELSE '001' END",
            "jv": "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(floor(abs(c_acctbal) * 30e0) AS BIGINT) + 20000 END",
            "av_nsd": "CAST(floor(abs(c_acctbal) * 20e0) AS BIGINT)",
            "lnd_val": "CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN 0 WHEN c_custkey % 43 = 0 THEN 1 ELSE CAST(floor(abs(c_acctbal) * 5e0) AS BIGINT) END",
            "exmpt_01": "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 25000 END",
            "lnd_sqfoot": "4000 + (c_custkey * 97) % 9000",
            "imp_qual": "1 + c_custkey % 5",
            "eff_yr_blt": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 1950 + (c_custkey * 13) % 70 END",
            "act_yr_blt": "1940 + (c_custkey * 7) % 80",
            "tot_lvg_area": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 700 + (c_custkey * 37) % 2600 END",
            "no_buldng": "1 + c_custkey % 3",
            "no_res_unts": "1 + c_custkey % 4",
            "spec_feat_val": "(c_custkey * 11) % 9000",
            "nav_total_assessment": "(c_custkey * 3) % 700 * 1e0",
            "bedrooms": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 1 + c_custkey % 5 END",
            "bathrooms": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 1e0 + (c_custkey % 4) * 5e-1 END",
            "exterior_wall": "CASE c_custkey % 4 WHEN 0 THEN 'BRICK' WHEN 1 THEN 'STUCCO' WHEN 2 THEN 'VINYL' END",
            "roof_type": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END",
            "foundation_type": "CASE WHEN c_custkey % 6 = 0 THEN 'SLAB' ELSE 'PIER' END",
            "qual_cd1": "CASE WHEN c_custkey % 4 = 0 THEN '01' ELSE '11' END",
            "sale_prc1": "CAST(floor(abs(c_acctbal) * 25e0) AS BIGINT) + 5000",
            "asmnt_yr": "2025",
            "sale_yr1": "2000 + c_custkey % 27",
            "par_splt": "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '25' END",
            "own_state": "CASE WHEN c_nationkey = 3 THEN 'GA' WHEN c_nationkey = 4 THEN '' ELSE 'FL' END",
            "own_state_dom": "CASE WHEN c_nationkey = 3 THEN 'GA' WHEN c_nationkey < 20 THEN 'FL' END",
            "own_addr1": f"CASE c_custkey % 7 WHEN 0 THEN 'PO BOX 12' WHEN 1 THEN '' WHEN 2 THEN 'C/O BANK' ELSE CAST(100 + (c_custkey * 3) % 400 AS STRING) || ' ' || {_STREET.format(k='c_custkey')} || ' ST' END",
            "own_addr2": "CASE c_custkey % 5 WHEN 0 THEN NULL ELSE CAST(c_custkey AS STRING) || ' ELM ST' END",
            "phy_addr1": f"CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE CAST(100 + (c_custkey * 3) % 400 AS STRING) || ' ' || {_STREET.format(k='c_custkey')} || ' ST' END",
            "phy_city": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'CITY' || CAST(c_custkey % 6 AS STRING) END",
            "phy_zipcd": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(32500 + c_custkey % 40 AS STRING) END",
            "mkt_ar": "CAST(c_custkey % 12 AS STRING)",
            "nbrhd_cd": "CAST(c_custkey % 30 AS STRING)",
            "census_bk": "CAST(c_custkey % 25 AS STRING)",
            "list_price": "CASE WHEN c_custkey % 3 = 0 THEN CAST(floor(abs(c_acctbal) * 22e0) AS BIGINT) + 15000 END",
            "arv_spread": "CASE WHEN c_custkey % 4 < 3 THEN CAST(floor(c_acctbal * 10e0) AS BIGINT) END",
            "lat": "CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE 303e-1 + (c_custkey * 7919 % 1000) * 4e-4 END",
            "lon": "CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE -873e-1 + (c_custkey * 104729 % 1000) * 4e-4 END",
            "enriched_on": "CASE WHEN c_custkey % 4 <> 0 THEN DATE '2025-03-01' END",
            "sec": "CAST(c_custkey % 36 + 1 AS STRING)",
            "twn": "CAST(c_custkey % 9 AS STRING) || CASE WHEN c_custkey % 5 < 3 THEN 'N' WHEN c_custkey % 5 = 3 THEN 'S' ELSE '' END",
            "rng": "CAST(c_custkey % 31 AS STRING) || CASE WHEN c_custkey % 7 < 5 THEN 'W' WHEN c_custkey % 7 = 5 THEN 'E' ELSE ' ' END",
        },
    ),
    "sales": (
        "orders",
        {
            "id": "o_orderkey",
            "county_fips": _COUNTY.format(k="o_custkey"),
            "parcel_id": "CAST(o_custkey AS STRING)",
            "sale_date": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
            "sale_price": "CASE WHEN o_orderkey % 31 = 0 THEN 100 ELSE CAST(floor(o_totalprice) AS BIGINT) END",
            "qualification_code": "CASE o_orderkey % 6 WHEN 0 THEN 'Q' WHEN 1 THEN 'C' WHEN 2 THEN 'U' WHEN 3 THEN NULL ELSE 'D' END",
            "instrument_type": "CASE WHEN o_orderkey % 2 = 1 THEN 'WD' ELSE 'QC' END",
            "sale_type": "o_orderstatus",
            "grantor": "'G' || CAST(o_orderkey % 50 AS STRING)",
            "grantee": "'E' || CAST(o_orderkey % 70 AS STRING)",
        },
    ),
    "signals": (
        "events",
        {
            "id": "event_id",
            "county_fips": _COUNTY.format(k="user_id"),
            "parcel_id": "CAST(user_id AS STRING)",
            "signal_tier": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(1 + event_id % 4 AS INT) END",
            "signal_type": "event_type",
            "listing_type": "event_type",
            "days_on_market": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 500 AS INT) END",
            "event_arv_source": "CASE event_id % 3 WHEN 0 THEN 'COMP' WHEN 1 THEN 'JV_FALLBACK' END",
            "event_arv_estimate": "CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value * 1000e0) AS BIGINT) END",
            "list_price": "CAST(floor(value * 900e0) AS BIGINT)",
            "workflow_status": "CASE event_id % 8 WHEN 0 THEN 'NEW' WHEN 1 THEN 'REVIEWED' WHEN 2 THEN 'APPROVE_SEND' WHEN 3 THEN 'SENT' WHEN 4 THEN 'RESPONDED' WHEN 5 THEN 'REJECTED' WHEN 6 THEN 'CLOSED' END",
            "notes": "CASE WHEN event_id % 2 = 0 THEN 'first' END",
            "source": "CASE event_id % 3 WHEN 0 THEN 'auction' WHEN 1 THEN 'clerk' ELSE 'file' END",
            "raw_json": "props",
            "created_at": "ts",
        },
    ),
    "listings": (
        "part",
        {
            "listing_id": "p_partkey",
            "county_fips": _COUNTY.format(k="p_partkey"),
            "address": "CAST(100 + (p_partkey * 3) % 400 AS STRING) || CASE p_partkey % 17 WHEN 3 THEN ' North ' WHEN 5 THEN ' southwest ' WHEN 7 THEN ' NORTH South ' WHEN 11 THEN '  ' ELSE ' ' END || lower("
            + _STREET.format(k="p_partkey")
            + ") || CASE p_partkey % 13 WHEN 0 THEN ' Street' WHEN 1 THEN ' st  # 4' WHEN 2 THEN ' ST APT 2B' WHEN 3 THEN '' WHEN 4 THEN ' Str' WHEN 5 THEN ' ST APT4' WHEN 6 THEN ' st #4' WHEN 7 THEN ' ST APT.4' WHEN 8 THEN ' ST UNIT5' WHEN 9 THEN ' st ste 4' WHEN 10 THEN ' st apt. 4' WHEN 11 THEN ' ST Unit  4' ELSE ' Street' END",
            "zip": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(32500 + p_partkey % 40 AS STRING) END",
            "price_text": "'$' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || ',000'",
            "list_price": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 100e0) AS BIGINT) END",
            "raw_id": "'0-' || CAST(p_partkey AS STRING) || ' '",
        },
    ),
    "landed": (
        "part",
        {
            "page_id": "p_partkey",
            "county_fips": _COUNTY.format(k="p_partkey"),
            "card": "'<table><tr><td class=\"w font-bold\">extw</td><td>BRICK (' || CAST(p_partkey AS STRING) || ')</td> <td class=\"font-bold\">BED</td><td>' || CAST(p_partkey % 25 AS STRING) || '</td></tr>"
            " <tr><td class=\"font-bold\">Bath</td><td> <i>' || CAST(1 + p_partkey % 3 AS STRING) || '.5</i> </td><td class=\"font-bold\">qual</td><td>CLASS ' || CAST(p_partkey % 6 AS STRING) || '(04</td></tr></table>"
            "<script>window.__remixContext = {\"state\":{\"loaderData\":{\"routes/_index\":{\"buildings\":{\"units\":[{\"squareFeet\":{\"heated\":' || CAST(p_partkey % 7 * 300 AS STRING) || '},\"yearBuilt\":{\"actual\":' || CAST(1790 + p_partkey % 200 AS STRING) || ',\"effective\":null}}]},"
            "\"zonings\":[{\"code\":\" R' || CAST(p_partkey % 4 AS STRING) || ' \"}]}}}};</script>'",
            "sales_page": "'<div class=\"c\" id=\"salesContainer\"><table><tr role=\"row\"><th>Sale Date</th></tr><tr role=\"row\"><td data-cell=\"Sale Date\">' || CAST(1 + p_partkey % 12 AS STRING) || '/' || CAST(1 + p_partkey % 28 AS STRING) || '/' || CAST(1990 + p_partkey % 30 AS STRING) || '</td>"
            "<td data-cell=\"Book / Page\"><a>1</a></td><td data-cell=\"Sale Price\"><span>$' || CAST(p_partkey AS STRING) || ',500</span></td><td data-cell=\"Instrument\">WD</td><td data-cell=\"Grantor\">A &amp; B ' || CAST(p_partkey AS STRING) || '</td></tr>"
            "<tr role=\"row\"><td data-cell=\"Sale Date\"></td><td data-cell=\"Grantor\">nobody</td></tr></table></div>'",
            "calendar": "'<h1>Auctions</h1><div class=\"AUCTION_ITEM PREVIEW\"><div class=\"ad_addr\">' || CAST(100 + p_partkey AS STRING) || ' OAK ST</div> Pensacola FL 325' || lpad(CAST(p_partkey % 60 AS STRING), 2, '0') || ' <span class=\"caseNo\">2024 CA ' || CAST(p_partkey AS STRING) || '</span>"
            "<a href=\"/d?' || CAST(p_partkey AS STRING) || '\">x</a> Opening Bid: $' || CAST(p_partkey AS STRING) || ',000 on 0' || CAST(1 + p_partkey % 9 AS STRING) || '-' || CAST(1 + p_partkey % 30 AS STRING) || '-2024</div><div class=\"AUCTION_ITEM\">Minimum bid 5</div>'",
            "answer": "CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '<p>Parcel ID: ' || CAST(p_partkey AS STRING) || '</p><h2>General Information</h2>' WHEN 2 THEN '<p>The portal of the county</p>' WHEN 3 THEN '<script>window.__remixContext = {\"empty\":true};</script>'"
            " WHEN 4 THEN '<script>window.__remixContext = {\"empty\":false};</script>' WHEN 5 THEN '<script>window.__remixContext = {\"empty\": true};</script>' WHEN 6 THEN '<p>Parcel ID: none</p>' WHEN 7 THEN '' ELSE '<p>Parcel ID: 7</p> General Information <script>window.__remixContext = {};</script>' END",
            "redirects": "CASE p_partkey % 11 WHEN 3 THEN 'https://www.ESCPA.org/' WHEN 5 THEN 'https://www.escpa.org/CAMA/Search.aspx?id=1' WHEN 7 THEN 'https://escpa.org/cama' END",
            "appraiser": "'<table><tr><td><div id=ctl00_MasterPlaceHolder_MapBodyStats class=m><b>Section Map Id:</b><br>CA12<br><b>Approx. Acreage:</b><br>0.' || CAST(p_partkey % 90 AS STRING) || '<br>Zoned:<br>R-' || CAST(p_partkey % 5 AS STRING) || '</div>"
            "<table border=0 id=\"ctl00_MasterPlaceHolder_tblBldgs\"><tr><td><table><tr><th>Address: 1 OAK ST, Improvement Type: X, Year Built: ' || CAST(1900 + p_partkey % 120 AS STRING) || ', Effective Year: ' || CAST(1950 + p_partkey % 70 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ', <span>' || CAST(800 + p_partkey AS STRING) || ' Total SF</span>' END || '</th><tr><td>"
            "<b>exterior wall</b>-<i>BRICK &amp; STONE</i><br><b>EXTERIOR WALL</b>-<i> VINYL </i><b>ROOF COVER</b>-<i></i><p><b>Foundation</b>-<u>x</u><i>SLAB ' || CAST(p_partkey % 4 AS STRING) || '</i></table>"
            "<table><tr><td><b>ROOF COVER</b>-<i>no head, no facts</i></table><table><tr><th>Year Built: 1800<tr><td><b>ROOF COVER</b>-<i>METAL</i></table></td></tr><tr><td><span style=\"background:LightGrey\">' || CAST(700 + p_partkey AS STRING) || ' Total SF</span></table>"
            "<tr><td align=left id=\"ctl00_MasterPlaceHolder_SalesCell\"><table class=s><tr><th colspan=7>Sales Data<tr><td>Sale Date<td>Book<td>Page<td>Value<td>Type<td>Multi Parcel<td>Records"
            "<tr><td>0' || CAST(1 + p_partkey % 9 AS STRING) || '/2001<td>1<td>2<td>$' || CAST(p_partkey AS STRING) || ',500<td>WD<td>' || CASE WHEN p_partkey % 2 = 0 THEN 'y' ELSE '' END || '<td><table><tr><td>View<td>Instr</table>"
            "<tr><td></td><td>9</td><td>9</td><td>$1</td><td>QC</td><tr><td>' || CASE WHEN p_partkey % 7 = 0 THEN 'soon' ELSE '3/4/1999' END || '</td><td>5<td>6<td>$7<td>CT</tr><tr><td colspan=7>Official Records Inquiry</table></table>'",
            "clerk_page": "'<table><tr><td>Tax sale<table width=100% BGCOLOR=\"#0054A6\"><tr><th>View Image</th><th>Clerk<br>File #<th>Account<th>Sales Date<th>Opening Bid Amount</th><th>Legal Description<th>.</tr>"
            "<tr><td><a href=x>v</a><td>' || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '2024 TD ' || CAST(p_partkey AS STRING) END || '<td>A' || CAST(p_partkey % 9 AS STRING) || '<td>May ' || CAST(1 + p_partkey % 28 AS STRING) || ', 2024<td>$' || CAST(p_partkey AS STRING) || ',001.00<td>LOT 1' || chr(10) || '<br>  BLK ' || CAST(p_partkey % 5 AS STRING) || '<table><tr><td>more</table><td>.</table><table width=100%><tr><td>Count=1</table></table>'",
            "legal": "'CN:2024 CA ' || CAST(p_partkey AS STRING) || ' LOT:' || CAST(p_partkey % 40 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' BLK:B' || CAST(p_partkey % 7 AS STRING) END || ' SUB:PINE  HILLS ' || CAST(p_partkey % 5 AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN ' SEC:1' || CAST(p_partkey % 9 AS STRING) || ' TWP:3N RGE:31W' ELSE '' END",
            "owners": "CASE p_partkey % 3 WHEN 0 THEN 'FIRST BANK NA' ELSE 'TRUST ' || CAST(p_partkey AS STRING) END || chr(10) || CASE p_partkey % 4 WHEN 0 THEN ' LLC CO' ELSE ' JANE DOE ' || CAST(p_partkey AS STRING) END",
            "month": "CASE p_partkey % 3 WHEN 0 THEN 'May' WHEN 1 THEN 'Jun' ELSE 'Dec' END",
        },
    ),
    "roll": (
        "customer",
        {
            "county_fips": _COUNTY.format(k="c_custkey"),
            "PARCEL_ID": "CAST(c_custkey AS STRING)",
            "JV": "CASE c_custkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '12.7' WHEN 2 THEN '-3' WHEN 3 THEN 'x' WHEN 4 THEN NULL ELSE ' ' || CAST(CAST(floor(abs(c_acctbal) * 30e0) AS BIGINT) AS STRING) END",
            "LND_VAL": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING) END",
            "DOR_UC": "CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '093' WHEN 2 THEN 'A' ELSE '1234' END",
            "AV_NSD": "CAST(CAST(floor(abs(c_acctbal) * 20e0) AS BIGINT) AS STRING)",
            "ACT_YR_BLT": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(1940 + c_custkey % 80 AS STRING) END",
            "TOT_LVG_AREA": "CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE CAST(700 + (c_custkey * 37) % 2600 AS STRING) END",
            "IMP_QUAL": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 6 AS STRING) END",
            "NO_BULDNG": "CAST(c_custkey % 4 AS STRING)",
            "NO_RES_UNTS": "CAST(c_custkey % 5 AS STRING)",
            "CO_NO": "CASE WHEN c_custkey % 2 = 0 THEN '27' ELSE '67' END",
            "PHY_ZIPCD": "CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE CAST(32500 + c_custkey % 40 AS STRING) END",
            "OWN_STATE": "CASE WHEN c_nationkey = 3 THEN 'ga' WHEN c_nationkey = 4 THEN '' ELSE 'FL ' END",
            "OWN_ADDR1": "CASE c_custkey % 7 WHEN 0 THEN 'po box 12' WHEN 1 THEN '' WHEN 2 THEN 'C/O BANK' ELSE CAST(c_custkey % 9 AS STRING) || ' OAK ST' END",
            "OWN_ADDR2": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'P.O. 3' ELSE CAST(c_custkey % 9 AS STRING) || ' ELM ST' END",
            "PHY_ADDR1": "CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '4 ELM ST' ELSE CAST(c_custkey % 9 AS STRING) || ' OAK ST' END",
            "DISTR_CD": "CAST(c_custkey % 3 AS STRING)",
        },
    ),
    "places": (
        "nation",
        {
            "name": "n_name",
            "lat": "302e-1 + (n_nationkey * 37 % 25) * 2e-2",
            "lon": "-874e-1 + (n_nationkey * 11 % 25) * 2e-2",
            "half": "1e-2 * (2 + n_nationkey % 7)",
        },
    ),
}


#: Tables whose rows are long or cost much to read, though made from few bytes, and the key that deals them to tasks.
DEALT = {"landed": "p_partkey", "listings": "p_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if name in DEALT:
        rows = dealt(rows, DEALT[name])
    return rows.selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def sql(query: str, *names: str) -> str:
    """A DuckDB query over the named tables."""
    parts = []
    for n in names:
        source, columns = TABLES[n]
        parts.append(f"{n} AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {source})")
    return "WITH " + ",\n".join(parts) + ("\n, " + query[5:] if query.upper().startswith("WITH ") else "\n" + query)
