"""Every registered query of the property engine and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrelens.functions import parcel as P
from acrelens.functions import projection as J
from acrelens.functions import text as X
from acrelens.operators import arv, filters, match, merge, search, sinks, spatial, workflow
from acrelens.plans import reports
from acrelens.plans.fixtures import sql, table
from acrelens.scratch import dealt, scratch_path
from acrelens.sources import county_pages, files, pages, shapefile, workbook

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_ID = ["county_fips", "parcel_id"]

WEIGHTS = {"arv_spread_score": 0.5, "signal_tier_score": 0.25, "dom_score": 0.15, "absentee_score": 0.10}
CRITERIA = {
    "logic": "AND",
    "version": 1,
    "filters": {
        "just_value": {"min": 50_000, "max": 300_000},
        "list_price_to_jv_ratio": {"max": 1.2},
        "year_built": {"min": 1945},
        "living_area_sqft": {"min": 900},
        "bathrooms": {"min": 1.0},
        "num_buildings": {"max": 2},
        "homestead_status": {"required": False},
        "owner_state_dom": {"exclude": ["GA"]},
        "dor_use_code": {"include": [1, 2]},
        "mkt_ar_codes": {"include": ["1", "2", "3", "4", "5", "6"]},
    },
}
#: The raw rows have no listing before the filters of the roll.
ROLL_CRITERIA = {
    "filters": {
        "dor_use_code": {"include": [1, 93]},
        "year_built": {"min": 1950, "max": 2000},
        "imp_qual": {"min": 2, "max": 4},
        "living_area_sqft": {"min": 900},
        "just_value": {"min": 50_000},
        "num_buildings": {"max": 2},
        "num_residential_units": {"max": 3},
        "county_nos": {"include": [27]},
        "zip_codes": {"include": ["32500", "32504", "32510", "32520", "32530"]},
        "absentee_owner": {"required": True},
        "disaster_code_present": {"required": False},
    }
}


def query(oracle: str | None = None, *names: str):
    """Register a function of tables as the query of its name."""

    def register(f):
        inputs = names or f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in inputs])
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle.strip(), *inputs)
        return f

    return register


ABSENTEE_SQL = """CASE WHEN upper(trim(coalesce(own_state, ''))) NOT IN ('', 'FL') THEN true
 WHEN m = '' THEN NULL WHEN m LIKE 'PO %' OR m LIKE 'P.O.%' THEN true
 WHEN NOT regexp_matches(m, '^[0-9]') THEN NULL WHEN upper(trim(coalesce(phy_addr1, ''))) = '' THEN NULL
 ELSE m <> upper(trim(phy_addr1)) END"""
AWAY_SQL = f"""WITH away AS (SELECT *, {ABSENTEE_SQL} AS absentee_owner FROM
 (SELECT *, upper(trim(coalesce(CASE WHEN county_fips = '12033' THEN own_addr1 ELSE own_addr2 END, ''))) AS m FROM parcels))"""
LATEST_SQL = "latest AS (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY county_fips, parcel_id ORDER BY id DESC) = 1)"
SCORE_SQL = """round(CASE WHEN tw = 0 THEN NULL ELSE ts / tw END, 4) AS deal_score FROM (SELECT *,
 CASE WHEN arv_spread IS NOT NULL AND coalesce(jv, 0) <> 0 THEN 0.5e0 * greatest(least(arv_spread / jv, 1e0), 0e0) ELSE 0e0 END
 + CASE WHEN signal_tier IS NULL THEN 0e0 ELSE 0.25e0 * CASE signal_tier WHEN 1 THEN 1e0 WHEN 2 THEN 0.66e0 WHEN 3 THEN 0.33e0 ELSE 0e0 END END
 + CASE WHEN days_on_market IS NULL THEN 0e0 ELSE 0.15e0 * (1e0 - least(days_on_market / 365e0, 1e0)) END
 + CASE WHEN absentee_owner THEN 0.10e0 ELSE 0e0 END AS ts,
 CASE WHEN arv_spread IS NOT NULL AND coalesce(jv, 0) <> 0 THEN 0.5e0 ELSE 0e0 END + CASE WHEN signal_tier IS NULL THEN 0e0 ELSE 0.25e0 END
 + CASE WHEN days_on_market IS NULL THEN 0e0 ELSE 0.15e0 END + CASE WHEN absentee_owner THEN 0.10e0 ELSE 0e0 END AS tw"""
FILTER_SQL = """jv BETWEEN 50000 AND 300000 AND list_price IS NOT NULL AND jv > 0 AND list_price / jv <= 1.2e0 AND act_yr_blt >= 1945
 AND tot_lvg_area >= 900 AND bathrooms >= 1 AND no_buldng <= 2 AND (exmpt_01 IS NULL OR exmpt_01 = 0) AND own_state_dom <> 'GA'
 AND dor_uc IN ('001', '002') AND mkt_ar IN ('1', '2', '3', '4', '5', '6')"""


def _with_absentee(parcels):
    line = P.mailing_line(F.col("county_fips"), F.col("own_addr1"), F.col("own_addr2"))
    return parcels.withColumn("absentee_owner", P.absentee(F.col("own_state"), line, F.col("phy_addr1")))


# Coercion and derived fields.


@query(
    """SELECT county_fips, PARCEL_ID AS "parcel_id",
 CAST(nullif(trunc(try_cast(trim(JV) AS DOUBLE)), 0) AS INT) AS jv,
 CASE WHEN regexp_matches(trim(JV), '^[+-]?[0-9]+$') AND CAST(trim(JV) AS BIGINT) > 0 THEN CAST(trim(JV) AS BIGINT) END AS jv_strict,
 CASE WHEN length(u) < 3 THEN lpad(u, 3, '0') ELSE u END AS dor_uc, nullif(trim(PHY_ZIPCD), '') AS phy_zipcd, substr(nullif(trim(OWN_ADDR1), ''), 1, 4) AS addr_cut
 FROM (SELECT *, CAST(CAST(trunc(try_cast(trim(DOR_UC) AS DOUBLE)) AS BIGINT) AS VARCHAR) AS u FROM roll)"""
)
def roll_coercion(roll):
    return roll.select(
        "county_fips", F.col("PARCEL_ID").alias("parcel_id"), P.roll_int(F.col("JV")).alias("jv"), P.filter_int(F.col("JV")).alias("jv_strict"), P.use_code(F.col("DOR_UC")).alias("dor_uc"), X.non_empty(F.col("PHY_ZIPCD")).alias("phy_zipcd"), X.non_empty(F.col("OWN_ADDR1"), 4).alias("addr_cut")
    )


@query(
    """SELECT county_fips, parcel_id, CASE WHEN jv IS NULL OR lnd_val IS NULL OR lnd_val = 0 THEN NULL
 WHEN (jv - lnd_val) / lnd_val > 9999.9999e0 THEN 9999.9999e0 WHEN (jv - lnd_val) / lnd_val < -9999.9999e0 THEN -9999.9999e0 ELSE round((jv - lnd_val) / lnd_val, 4) END AS improvement_ratio,
 round(CASE WHEN jv <> 0 THEN av_nsd / jv END, 4) AS cap_ratio, CASE WHEN asmnt_yr - sale_yr1 >= 0 THEN asmnt_yr - sale_yr1 END AS years_since_sale FROM parcels"""
)
def derived_ratios(parcels):
    return parcels.select(
        *_ID,
        P.improvement_ratio(F.col("jv"), F.col("lnd_val")).alias("improvement_ratio"),
        P.cap_ratio(F.col("av_nsd"), F.col("jv")).alias("cap_ratio"),
        P.years_since_sale(F.col("asmnt_yr"), F.col("sale_yr1")).alias("years_since_sale"),
    )


@query(AWAY_SQL + " SELECT county_fips, parcel_id, absentee_owner, coalesce(absentee_owner, false) AS absentee_flag FROM away")
def absentee_owners(parcels):
    rows = _with_absentee(parcels)
    return rows.select(*_ID, "absentee_owner", F.coalesce("absentee_owner", F.lit(False)).alias("absentee_flag"))


_MARKED = r"""regexp_replace(regexp_replace(regexp_replace({x}, '([0-9])([A-Z])', '\1~\2', 'g'), '~(ST|ND|RD|TH)\b', '\1', 'g'), '~', ' ', 'g')"""


# The two patterns of a unit, as they must be.
_UNIT_SQL = r"(\b(APT\.?|UNIT|STE|SUITE)\s+[\w-]+|#\s*[\w-]+)"
_UNIT_END_SQL = r"^(.*?)\s*(?:#|APT\.?\s*|UNIT\s+|STE\.?\s*|SUITE\s+)([A-Z0-9][\w-]*)\s*$"


def _address_sql(column: str, strip_unit: bool = True) -> str:
    squeeze = lambda t: f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    text = squeeze(f"upper(coalesce({column}, ''))")
    if strip_unit:
        text = _MARKED.format(x=squeeze(f"regexp_replace({text}, '{_UNIT_SQL}', '', 'g')"))
    else:
        head = f"regexp_extract(t, '^(.*?)(?:{_UNIT_SQL}.*)?$', 1)"
        text = f"list_transform([{text}], lambda t: {_MARKED.format(x=head)} || substr(t, length({head}) + 1))[1]"
    text = squeeze(text)
    for full, short in X.SUFFIXES.items():
        text = f"regexp_replace({text}, '\\b{full}\\b', '{short}', 'g')"
    text, words = squeeze(text), "|".join(X.COMPASS)
    shorts = " ".join(f"WHEN '{full}' THEN '{short}'" for full, short in X.COMPASS.items())
    led = f"^([0-9]+\\s+)({words})\\s+"
    return f"list_transform([{text}], lambda t: CASE WHEN regexp_matches(t, '{led}') AND NOT regexp_matches(t, '{led}({words})\\b') THEN regexp_replace(t, '{led}', '\\1' || CASE regexp_extract(t, '{led}', 2) {shorts} END || ' ') ELSE t END)[1]"


@query(f"SELECT listing_id, {_address_sql('address')} AS street, {_address_sql('address', False)} AS kept FROM listings")
def address_normal_form(listings):
    return listings.select("listing_id", X.street_address(F.col("address")).alias("street"), X.street_address(F.col("address"), strip_unit=False).alias("kept"))


@query(
    """SELECT listing_id, CAST(replace(regexp_extract(price_text, '^\\$([0-9,]+)', 1), ',', '') AS BIGINT) AS price, CAST(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE) AS dollars,
 regexp_replace(upper(raw_id), '[^A-Z0-9]', '', 'g') AS parcel_key, lpad(regexp_replace(upper(raw_id), '[^A-Z0-9]', '', 'g'), 18, '0') AS padded, regexp_replace(upper(trim(address)), '^[0-9]+\\s*', '') AS street_name FROM listings"""
)
def text_parsers(listings):
    return listings.select(
        "listing_id", X.listing_facts(F.col("price_text"), F.lit(""), F.lit(""))["list_price"].alias("price"), X.money(F.col("price_text")).alias("dollars"), X.parcel_key(F.col("raw_id")).alias("parcel_key"), X.padded_parcel_id(F.col("raw_id")).alias("padded"), X.street_name(F.col("address")).alias("street_name")
    )


# Filters.


@query(f"SELECT county_fips, parcel_id, jv FROM parcels WHERE {FILTER_SQL}")
def criteria_filter(parcels):
    return filters.matching(parcels, filters.predicates(CRITERIA)).select(*_ID, "jv")


@query(
    """SELECT county_fips, PARCEL_ID AS parcel_id, concat_ws(',',
 CASE WHEN coalesce(i(DOR_UC), 0) NOT IN (1, 93) THEN 'dor_uc_mismatch' END,
 CASE WHEN i(ACT_YR_BLT) IS NULL THEN 'year_built_missing' END, CASE WHEN i(ACT_YR_BLT) < 1950 THEN 'year_built_too_old' END, CASE WHEN i(ACT_YR_BLT) > 2000 THEN 'year_built_too_new' END,
 CASE WHEN i(IMP_QUAL) < 2 THEN 'imp_qual_too_low' END, CASE WHEN i(IMP_QUAL) > 4 THEN 'imp_qual_too_high' END,
 CASE WHEN i(TOT_LVG_AREA) IS NULL THEN 'living_area_missing' END, CASE WHEN i(TOT_LVG_AREA) < 900 THEN 'living_area_too_small' END,
 CASE WHEN i(JV) IS NULL THEN 'just_value_missing' END, CASE WHEN i(JV) < 50000 THEN 'just_value_too_low' END,
 CASE WHEN i(NO_BULDNG) > 2 THEN 'num_buildings_exceeded' END, CASE WHEN i(NO_RES_UNTS) > 3 THEN 'num_res_units_exceeded' END,
 CASE WHEN coalesce(i(CO_NO), 0) <> 27 THEN 'county_no_mismatch' END,
 CASE WHEN coalesce(trim(PHY_ZIPCD), '') NOT IN ('32500', '32504', '32510', '32520', '32530') THEN 'zip_code_excluded' END,
 CASE WHEN NOT coalesce(away, false) THEN 'absentee_owner_required' END, CASE WHEN i(DISTR_CD) > 0 THEN 'disaster_code_present' END) AS reasons
 FROM (SELECT *, AWAY AS away FROM (SELECT *, upper(trim(coalesce(OWN_ADDR2, ''))) AS m FROM roll))""".replace("AWAY AS", ABSENTEE_SQL + " AS").replace("i(", "intpos(")
)
def rejection_reasons(roll):
    return roll.select("county_fips", F.col("PARCEL_ID").alias("parcel_id"), F.array_join(filters.rejection_reasons(ROLL_CRITERIA), ",").alias("reasons"))


def _inline(name: str) -> None:
    """DuckDB runs one statement, so the helper is written out."""
    import re

    ORACLE_SQL[name] = re.sub(r"intpos\((\w+)\)", r"CASE WHEN regexp_matches(trim(\1), '^[+-]?[0-9]+$') AND CAST(trim(\1) AS BIGINT) > 0 THEN CAST(trim(\1) AS BIGINT) END", ORACLE_SQL[name])


_inline("rejection_reasons")


@query("SELECT id, county_fips FROM signals WHERE workflow_status = 'NEW' AND signal_tier = 1 AND county_fips IN ('12033')")
def events_by_facts(signals):
    return filters.events_where(filters.visible_to(signals, ["12033"]), status="NEW", tier=1).select("id", "county_fips")


# Search.


@query("WITH " + LATEST_SQL + " SELECT county_fips, parcel_id, id, signal_tier, listing_type FROM latest")
def latest_event_per_parcel(signals):
    return search.latest_events(signals).select(*_ID, "id", "signal_tier", "listing_type")


_SCORED_SQL = AWAY_SQL + ", " + LATEST_SQL + f""", joined AS (SELECT p.*, e.signal_tier, e.days_on_market, e.listing_type, e.event_arv_source
 FROM away p LEFT JOIN latest e USING (county_fips, parcel_id)), scored AS (SELECT county_fips, parcel_id, jv, arv_spread, phy_addr1, act_yr_blt, {SCORE_SQL} FROM joined))"""


@query(_SCORED_SQL + " SELECT county_fips, parcel_id, deal_score FROM scored")
def deal_scores(parcels, signals):
    return search.scored(_with_absentee(parcels), signals, {}, WEIGHTS).select(*_ID, "deal_score")


def _searched(parcels, signals, extra=None):
    criteria = {"filters": {**CRITERIA["filters"], **(extra or {})}}
    return search.scored(_with_absentee(parcels), signals, criteria, WEIGHTS), criteria


@query(
    _SCORED_SQL.replace("FROM away p LEFT", f"FROM (SELECT * FROM away WHERE {FILTER_SQL}) p LEFT")
    + """ SELECT county_fips, parcel_id, deal_score, position FROM (SELECT *, row_number() OVER (ORDER BY coalesce(deal_score, -1) DESC, coalesce(arv_spread, -1) DESC, parcel_id DESC, county_fips) AS position FROM scored)
 WHERE position > 10 AND position <= 20"""
)
def search_page(parcels, signals):
    rows, criteria = _searched(parcels, signals, {"max_results": {"value": 40}})
    return search.page_of(rows, criteria, page=2, size=10).select(*_ID, "deal_score", "position")


@query(
    _SCORED_SQL
    + """ SELECT county_fips, parcel_id, deal_score, position FROM (SELECT *, row_number() OVER (ORDER BY coalesce(deal_score, -1) DESC, coalesce(arv_spread, -1) DESC, parcel_id DESC, county_fips) AS position, count(*) OVER () AS n FROM scored)
 WHERE position > (n - 1) // 25 * 25"""
)
def search_last_page(parcels, signals):
    """The last page of a search without criteria, by ranges."""
    return search.deep_page_of(search.scored(_with_absentee(parcels), signals, {}, WEIGHTS), {}).select(*_ID, "deal_score", "position")


@query(
    _SCORED_SQL.replace("FROM away p LEFT", f"FROM (SELECT * FROM away WHERE {FILTER_SQL}) p LEFT")
    + " SELECT least(count(*), 40) AS total, CAST(greatest(1, ceil(least(count(*), 40) / 10)) AS BIGINT) AS total_pages FROM scored"
)
def search_totals(parcels, signals):
    rows, criteria = _searched(parcels, signals, {"max_results": {"value": 40}})
    return search.totals(rows, criteria, size=10)


@query(
    """SELECT county_fips, parcel_id, position FROM (SELECT *, row_number() OVER (ORDER BY street, suffix, house, txt, county_fips, parcel_id) AS position FROM (
 SELECT *, CASE WHEN phy_addr1 IS NULL THEN '~' WHEN len(t) > 2 THEN array_to_string(t[2:-2], ' ') ELSE t[2] END AS street, CASE WHEN phy_addr1 IS NULL THEN '' WHEN len(t) > 2 THEN t[-1] ELSE '' END AS suffix,
 CASE WHEN phy_addr1 IS NULL THEN 999999999 ELSE CAST(t[1] AS BIGINT) END AS house, coalesce(phy_addr1, '') AS txt FROM (SELECT *, string_split(phy_addr1, ' ') AS t FROM parcels))) WHERE position <= 25"""
)
def search_by_address(parcels):
    rows = parcels.withColumn("deal_score", F.lit(None).cast("double"))
    return search.page_of(rows, {}, field="address", direction="ASC", page=1, size=25).select(*_ID, "position")


@query(
    "WITH " + LATEST_SQL + """ SELECT county_fips, parcel_id, l.id AS event_id, coalesce(nullif(l.event_arv_estimate, 0), p.jv) AS estimate, n AS n_sales, newest FROM parcels p LEFT JOIN latest l USING (county_fips, parcel_id)
 LEFT JOIN (SELECT county_fips, parcel_id, count(*) AS n, max(sale_date) AS newest FROM sales GROUP BY ALL) s USING (county_fips, parcel_id)"""
)
def parcel_details(parcels, signals, sales):
    rows = search.details(parcels, signals, sales)
    latest = search.latest_events(signals).select(*_ID, "event_arv_estimate")
    return rows.join(latest, _ID, "left").select(
        *_ID, F.col("event.id").alias("event_id"), search.shown_estimate(F.col("event_arv_estimate"), F.col("jv")).alias("estimate"), F.when(F.col("sales").isNotNull(), F.size("sales").cast("long")).alias("n_sales"), F.array_max(F.transform("sales", lambda s: s["sale_date"])).alias("newest")
    )


# Valuation and space.

# Metres between places some miles apart: arcs of the meridian and of the parallel at the middle latitude, good to a hundredth of a millimetre.
_E2 = J.WGS84_F * (2 - J.WGS84_F)
_MID = "radians((a.lat + b.lat) / 2)"
_MILES = f"sqrt(power({J.WGS84_A} * (1 - {_E2!r}) / power(1 - {_E2!r} * power(sin({_MID}), 2), 1.5e0) * radians(b.lat - a.lat), 2) + power({J.WGS84_A} / sqrt(1 - {_E2!r} * power(sin({_MID}), 2)) * cos({_MID}) * radians(b.lon - a.lon), 2))"


def _geodesic_sql(rows: str, steps: int = 6) -> str:
    """Rows with lat1, lon1, lat2, lon2 and metres between them: the inverse geodesic, a subquery per step."""
    f, a = J.WGS84_F, J.WGS84_A
    b = a * (1 - f)
    out = f"(SELECT *, atan(tan(radians(lat1)) * {1 - f!r}) AS u, atan(tan(radians(lat2)) * {1 - f!r}) AS v, radians(lon2 - lon1) AS l0, radians(lon2 - lon1) AS l, 0 AS w, 0 AS z, 0 AS y, 0 AS q, 0 AS m FROM {rows})"
    for _ in range(steps):
        out = f"(SELECT * EXCLUDE (l), sqrt(power(cos(v) * sin(l), 2) + power(cos(u) * sin(v) - sin(u) * cos(v) * cos(l), 2)) AS ss, sin(u) * sin(v) + cos(u) * cos(v) * cos(l) AS cs, l FROM {out})"
        out = f"(SELECT *, atan2(ss, cs) AS s, CASE WHEN ss = 0 THEN 0 ELSE cos(u) * cos(v) * sin(l) / ss END AS sa FROM {out})"
        out = f"(SELECT *, 1 - sa * sa AS ca, CASE WHEN sa * sa >= 1 THEN 0 ELSE cs - 2 * sin(u) * sin(v) / (1 - sa * sa) END AS cm, {f!r} / 16 * (1 - sa * sa) * (4 + {f!r} * (4 - 3 * (1 - sa * sa))) AS c FROM {out})"
        out = f"(SELECT * EXCLUDE (l, c, ss, cs, s, sa, ca, cm, w, z, y, q, m), l0 + (1 - c) * {f!r} * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS l, ca AS w, ss AS z, cs AS y, s AS q, cm AS m FROM {out})"
    out = f"(SELECT *, w * {(a * a - b * b) / (b * b)!r} AS g FROM {out})"
    out = f"(SELECT *, 1 + g / 16384 * (4096 + g * (-768 + g * (320 - 175 * g))) AS k1, g / 1024 * (256 + g * (-128 + g * (74 - 47 * g))) AS k2 FROM {out})"
    return f"(SELECT *, {b!r} * k1 * (q - k2 * z * (m + k2 / 4 * (y * (2 * m * m - 1) - k2 / 6 * m * (4 * z * z - 3) * (4 * m * m - 3)))) AS metres FROM {out})"
_NEAR = f"a.county_fips = b.county_fips AND a.dor_uc = b.dor_uc AND abs(a.eff_yr_blt - b.eff_yr_blt) <= 10 AND a.parcel_id <> b.parcel_id AND {_MILES} <= 1.5e0 * 1609.344e0"
_ARV_SQL = f"""WITH viable AS (SELECT county_fips FROM sales WHERE (qualification_code IN ('Q', 'C') OR (qualification_code IS NULL AND instrument_type = 'WD')) AND sale_price >= 10000 GROUP BY 1 HAVING count(*) >= 1000),
 comps AS (SELECT p.*, s.sale_price, s.qualification_code AS qc FROM sales s JOIN parcels p USING (county_fips, parcel_id) WHERE s.sale_price >= 10000 AND (s.qualification_code IN ('Q', 'C', 'U') OR (s.qualification_code IS NULL AND s.instrument_type = 'WD'))),
 subjects AS (SELECT * FROM parcels WHERE jv IS NOT NULL AND tot_lvg_area > 0),
 sold AS (SELECT a.county_fips, a.parcel_id, count(*) FILTER (b.qc IS DISTINCT FROM 'U') AS n1, count(*) AS n2,
  median(CASE WHEN b.tot_lvg_area > 0 THEN b.sale_price / b.tot_lvg_area END) FILTER (b.qc IS DISTINCT FROM 'U') AS m1, median(CASE WHEN b.tot_lvg_area > 0 THEN b.sale_price / b.tot_lvg_area END) AS m2
  FROM subjects a JOIN comps b ON {_NEAR} WHERE a.county_fips IN (SELECT county_fips FROM viable) GROUP BY ALL),
 roll_comps AS (SELECT * FROM parcels WHERE qual_cd1 = '01' AND sale_prc1 >= 10000 AND tot_lvg_area > 0),
 own AS (SELECT a.county_fips, a.parcel_id, count(*) AS n3, median(b.sale_prc1 / b.tot_lvg_area) AS m3 FROM subjects a JOIN roll_comps b ON {_NEAR} GROUP BY ALL),
 picked AS (SELECT p.*, CASE WHEN n1 >= 3 AND m1 IS NOT NULL THEN 1 WHEN n2 >= 3 AND m2 IS NOT NULL THEN 2 WHEN n3 >= 3 AND m3 IS NOT NULL THEN 3 ELSE 4 END AS way, n1, n2, n3, m1, m2, m3
  FROM parcels p LEFT JOIN sold USING (county_fips, parcel_id) LEFT JOIN own USING (county_fips, parcel_id) WHERE jv IS NOT NULL),
 valued AS (SELECT *, CASE way WHEN 4 THEN jv ELSE CAST(floor(CASE way WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END * tot_lvg_area + 0.5e0) AS BIGINT) END AS arv FROM picked)
 SELECT county_fips, parcel_id, arv AS arv_estimate, CASE way WHEN 1 THEN 'COMP' WHEN 2 THEN 'COMP_WIDE' WHEN 3 THEN 'NAL_COMP' ELSE 'JV_FALLBACK' END AS arv_source,
 CASE way WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE 0 END AS comps, round(CASE WHEN tot_lvg_area > 0 THEN jv / tot_lvg_area END, 6) AS jv_per_sqft,
 CASE WHEN list_price IS NOT NULL AND tot_lvg_area <> 0 THEN arv - list_price - CAST(trunc(tot_lvg_area * 35e0) AS BIGINT) END AS arv_spread FROM valued"""


@query(_ARV_SQL)
def arv_valuation(parcels, sales):
    return arv.valuation(parcels, sales)


@query("""SELECT county_fips, count(*) AS pool, count(*) >= 1000 AS viable FROM sales WHERE (qualification_code IN ('Q', 'C') OR (qualification_code IS NULL AND instrument_type = 'WD')) AND sale_price >= 10000 GROUP BY 1""")
def county_viability(sales):
    return arv.viable_counties(sales)


@query(f"SELECT a.county_fips, a.parcel_id, count(*) AS neighbours FROM parcels a JOIN parcels b ON a.county_fips = b.county_fips AND a.parcel_id <> b.parcel_id AND {_MILES} <= 1000e0 GROUP BY ALL")
def radius_neighbours(parcels):
    return spatial.neighbour_counts(parcels, ["county_fips"], "parcel_id", 1000.0)


# Two thirds of the parcels drawn together round one spot, a fifteenth exactly on it.
_DRAWN = "CASE WHEN CAST(parcel_id AS BIGINT) % 15 = 1 THEN {at} WHEN CAST(parcel_id AS BIGINT) % 3 < 2 THEN {at} + ({c} - ({at})) / 20e0 ELSE {c} END"
_LAT, _LON = _DRAWN.format(c="lat", at="305e-1"), _DRAWN.format(c="lon", at="-871e-1")


@query(f"WITH drawn AS (SELECT county_fips, parcel_id, {_LAT} AS lat, {_LON} AS lon FROM parcels WHERE lat IS NOT NULL) SELECT a.county_fips, a.parcel_id, count(*) AS neighbours FROM drawn a JOIN drawn b ON a.county_fips = b.county_fips AND a.parcel_id <> b.parcel_id AND {_MILES} <= 750e0 GROUP BY ALL")
def crowded_neighbours(parcels):
    drawn = parcels.filter("lat is not null").select(*_ID, F.expr(_LAT).alias("lat"), F.expr(_LON).alias("lon"))
    return spatial.neighbour_counts(drawn, ["county_fips"], "parcel_id", 750.0, cell_rows=32)


def _diamonds(places):
    """Squares on a corner, with a smaller one cut out."""
    def ring(half):
        corner = lambda dy, dx: F.struct((F.col("lon") + dx * half).alias("lon"), (F.col("lat") + dy * half).alias("lat"))
        return F.array(corner(-1, 0), corner(0, 1), corner(1, 0), corner(0, -1))

    return places.select("name", ring(F.col("half") + 1.3e-4).alias("ring"), F.array(ring(F.col("half") * 0.31 + 1.3e-4)).alias("holes"))


_IN_DIAMOND = "abs(p.lat - q.lat) + abs(p.lon - q.lon) < q.half + 1.3e-4 AND abs(p.lat - q.lat) + abs(p.lon - q.lon) > q.half * 0.31e0 + 1.3e-4"


@query(f"SELECT p.county_fips, p.parcel_id, arg_min(q.name, (-round(q.half, 6), q.name)) AS name FROM parcels p JOIN places q ON {_IN_DIAMOND} GROUP BY ALL")
def city_by_polygon(parcels, places):
    return spatial.largest_containing(parcels.filter("lat is not null"), _diamonds(places).withColumn("area", F.round(spatial.ring_area(F.col("ring")), 9)), _ID)


@query(f"SELECT p.county_fips, p.parcel_id, min(q.name) AS name FROM parcels p JOIN places q ON {_IN_DIAMOND} GROUP BY ALL")
def zip_by_polygon(parcels, places):
    return spatial.any_containing(parcels.filter("lat is not null"), _diamonds(places), _ID)


def _many_corners(places, corners):
    """The diamonds with so many corners more on every side."""
    def ring(half):
        turn = F.sequence(F.lit(0), F.lit(4 * corners - 1))

        def corner(i):
            # How far the corner is from the diamond's middle, in halves: round the square on its corner.
            t = i % corners / corners
            side = F.floor(i / corners)
            dx = F.when(side == 0, t).when(side == 1, 1 - t).when(side == 2, -t).otherwise(t - 1)
            dy = F.when(side == 0, t - 1).when(side == 1, t).when(side == 2, 1 - t).otherwise(-t)
            return F.struct((F.col("lon") + dx * half).alias("lon"), (F.col("lat") + dy * half).alias("lat"))

        return F.transform(turn, corner)

    half = F.col("half")
    return places.select("name", ring(half + 1.3e-4).alias("ring"), F.array(ring(half * 0.31 + 1.3e-4)).alias("holes"), half.alias("area"))


@query(f"SELECT p.county_fips, p.parcel_id, q.name, round(q.half, 6) AS half FROM parcels p JOIN places q ON {_IN_DIAMOND}")
def places_by_slabs(parcels, places):
    held = spatial.containing_by_slabs(parcels.filter("lat is not null"), _many_corners(places, 700), _ID)
    return held.select(*_ID, "name", F.round("area", 6).alias("half"))


@query(f"SELECT county_fips, parcel_id, name, round(metres, 3) AS metres FROM {_geodesic_sql('(SELECT a.county_fips, a.parcel_id, b.name, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM parcels a CROSS JOIN places b WHERE a.lat IS NOT NULL)')} QUALIFY row_number() OVER (PARTITION BY county_fips, parcel_id ORDER BY metres, name) = 1")
def nearest_place(parcels, places):
    return spatial.nearest_place(parcels.filter("lat is not null"), places, _ID).select(*_ID, "name", F.round("metres", 3).alias("metres"))


@query(
    """SELECT street, value, votes, share FROM (SELECT street, value, n AS votes, n / sum(n) OVER (PARTITION BY street) AS share, row_number() OVER (PARTITION BY street ORDER BY n DESC, value) AS r
 FROM (SELECT regexp_replace(upper(trim(phy_addr1)), '^[0-9]+\\s*', '') AS street, phy_city AS value, count(*) AS n FROM parcels WHERE phy_city IS NOT NULL AND phy_addr1 IS NOT NULL GROUP BY ALL)) WHERE r = 1 AND share >= 0.2"""
)
def street_majority(parcels):
    return spatial.street_vote(parcels, X.street_name(F.col("phy_addr1")), "phy_city", 0.2)


@query("SELECT count(*) AS total, count(*) FILTER (NOT (lat BETWEEN 30.4e0 AND 30.6e0 AND lon BETWEEN -87.2e0 AND -87.0e0)) AS outside FROM parcels")
def bounding_box(parcels):
    return spatial.outside_box(parcels, 30.4, 30.6, -87.2, -87.0)


# Matching.

_ASKED = f"""asked AS MATERIALIZED (SELECT *, CASE WHEN u <> '' THEN trim(b) || ' ' || u END AS with_unit, CASE WHEN u <> '' THEN trim(b) ELSE street END AS base FROM
 (SELECT *, regexp_extract(kept, '{_UNIT_END_SQL}', 1) AS b, regexp_extract(kept, '{_UNIT_END_SQL}', 2) AS u FROM
  (SELECT listing_id, county_fips, nullif(trim(zip), '') AS zip, {_address_sql("address")} AS street, {_address_sql("address", False)} AS kept FROM listings)))"""


def _levels_sql(roll: str) -> str:
    """CTEs: what was asked, the keys of ``roll``, and the first level that hits; then the prefixes of the others."""
    return f"""WITH {_ASKED},
 keys AS (SELECT county_fips, parcel_id, phy_zipcd, upper(trim(phy_addr1)) AS key FROM {roll} WHERE phy_addr1 IS NOT NULL),
 tried AS (SELECT listing_id, zip, county_fips, street AS key, 1 AS level FROM asked UNION ALL SELECT listing_id, zip, county_fips, with_unit, 3 FROM asked WHERE with_unit IS NOT NULL),
 hits AS MATERIALIZED (SELECT listing_id, min(struct_pack(level := level + CASE WHEN p.phy_zipcd = t.zip THEN 0 ELSE 1 END, id := parcel_id)) AS h FROM tried t JOIN keys p ON t.county_fips = p.county_fips AND t.key = p.key WHERE t.key <> '' GROUP BY 1),
 met AS MATERIALIZED (SELECT listing_id, count(DISTINCT parcel_id) AS n, min(parcel_id) AS one, string_agg(DISTINCT parcel_id, ',' ORDER BY parcel_id) AS every FROM
  (SELECT m.*, p.parcel_id FROM (SELECT *, trim(regexp_extract(base, '^([0-9]+\\s+\\S+(\\s+\\S+)?)', 1)) AS prefix FROM asked ANTI JOIN hits USING (listing_id)) m
   JOIN keys p ON m.county_fips = p.county_fips AND starts_with(p.key, prefix) AND (m.zip IS NULL OR m.zip = p.phy_zipcd) WHERE prefix <> '') GROUP BY 1)"""


@query(_levels_sql("parcels") + " SELECT listing_id, h.id AS parcel_id, CAST(h.level AS INT) AS level FROM hits WHERE h.level <= 2")
def address_match(listings, parcels):
    return match.by_address(listings, parcels).filter("level <= 2").select("listing_id", "parcel_id", "level")


@query(_levels_sql("parcels") + " SELECT listing_id, CASE WHEN n = 1 THEN one END AS parcel_id, CASE WHEN n > 1 THEN every END AS review FROM met")
def address_prefix_match(listings, parcels):
    return match.by_address(listings, parcels).filter("level = 5 or review is not null").select("listing_id", "parcel_id", "review")


@query("SELECT listing_id AS record_id, min(p.parcel_id) AS parcel_id FROM listings l JOIN parcels p ON l.county_fips = p.county_fips AND ltrim(regexp_replace(upper(raw_id), '[^A-Z0-9]', '', 'g'), '0') = p.parcel_id WHERE substr(regexp_replace(upper(raw_id), '[^A-Z0-9]', '', 'g'), 2) = p.parcel_id GROUP BY 1")
def parcel_id_match(listings, parcels):
    records = listings.select(F.col("listing_id").alias("record_id"), "county_fips", F.substring(X.parcel_key(F.col("raw_id")), 2, 30).alias("raw_id"))
    return match.by_parcel_id(records.filter("raw_id not like '0%'"), parcels)


_DIRECTED = "CASE {k} % 4 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' WHEN 2 THEN ' ' ELSE '{a} ' END"


@query(
    f"""WITH asked AS (SELECT CAST(listing_id AS BIGINT) AS record_id, county_fips, CAST(listing_id % 36 + 1 AS VARCHAR) AS s, trim(CAST(listing_id % 9 AS VARCHAR) || {_DIRECTED.format(k="listing_id", a="N", b="S")}) AS t, trim(CAST(listing_id % 31 AS VARCHAR) || {_DIRECTED.format(k="(listing_id + 1)", a="W", b="E")}) AS r FROM listings),
 keys AS (SELECT county_fips, trim(sec) AS s, trim(twn) AS t, trim(rng) AS r, count(*) AS n, min(parcel_id) AS one FROM parcels WHERE coalesce(sec, '') <> '' AND coalesce(twn, '') <> '' AND coalesce(rng, '') <> '' GROUP BY ALL),
 exact AS (SELECT record_id, CASE WHEN n = 1 THEN one END AS parcel_id, CASE WHEN n = 1 THEN 'str' ELSE 'str_ambiguous' END AS method FROM asked JOIN keys USING (county_fips, s, t, r))
 SELECT * FROM exact UNION ALL
 SELECT record_id, min(one), 'str' FROM asked a JOIN keys k ON a.county_fips = k.county_fips AND a.s = k.s AND rtrim(a.t, 'NS') = rtrim(k.t, 'NS') AND rtrim(a.r, 'EW') = rtrim(k.r, 'EW') AND n = 1
 WHERE record_id NOT IN (SELECT record_id FROM exact) GROUP BY 1"""
)
def section_match(listings, parcels):
    k = F.col("listing_id")
    town = F.concat((k % 9).cast("string"), F.expr(_DIRECTED.format(k="listing_id", a="N", b="S")))
    range_ = F.concat((k % 31).cast("string"), F.expr(_DIRECTED.format(k="(listing_id + 1)", a="W", b="E")))
    records = listings.select(k.cast("long").alias("record_id"), "county_fips", (k % 36 + 1).cast("string").alias("sec"), town.alias("twp"), range_.alias("rge"))
    return match.by_section(records, parcels)


_WITH_UNIT = "CASE WHEN CAST(parcel_id AS BIGINT) % 4 < 2 THEN phy_addr1 || ' 4' ELSE phy_addr1 END"


@query(_levels_sql(f"(SELECT * REPLACE ({_WITH_UNIT} AS phy_addr1) FROM parcels)") + " SELECT listing_id, h.id AS parcel_id, CAST(h.level AS INT) AS level FROM hits WHERE h.level IN (3, 4)")
def address_unit_match(listings, parcels):
    return match.by_address(listings, parcels.withColumn("phy_addr1", F.expr(_WITH_UNIT))).filter("level in (3, 4)").select("listing_id", "parcel_id", "level")


@query(
    _levels_sql("parcels")
    + """, found AS (SELECT county_fips, coalesce(h.h.id, CASE WHEN n = 1 THEN one END) AS parcel_id, coalesce(n, 0) > 1 AS several FROM asked LEFT JOIN hits h USING (listing_id) LEFT JOIN met USING (listing_id))
 SELECT county_fips, count(*) AS listings, count(parcel_id) AS matched, count(*) - count(parcel_id) AS unmatched, count(*) FILTER (several) AS to_review,
  count(DISTINCT parcel_id) FILTER (parcel_id NOT IN (SELECT parcel_id FROM signals WHERE id % 9 = 0)) AS inserted FROM found GROUP BY 1"""
)
def match_cycle_counts(listings, parcels, signals):
    return match.match_cycle(listings, parcels, signals.filter("id % 9 = 0").select(*_ID))


@query(None)
def fuzzy_address_match(listings, parcels):
    queries = listings.select(F.col("listing_id").alias("query_id"), "county_fips", X.street_address(F.col("address")).alias("text"))
    choices = parcels.filter("phy_addr1 is not null").select(F.col("parcel_id").alias("choice_id"), "county_fips", F.col("phy_addr1").alias("text"))
    return match.by_likeness(queries, choices, 88.0).select("query_id", "choice_id", F.round("score", 6).alias("score"))


@query(None)
def court_record_match(landed, parcels):
    k = F.col("parcel_id").cast("long")
    roll = parcels.withColumn("s_legal", F.concat(F.lit("LT "), (k % 50).cast("string"), F.lit(" BLK B"), (k % 7).cast("string"), F.lit(" PINE HILLS "), (k % 5).cast("string")))
    return match.by_court_record(landed.select(F.col("page_id").alias("record_id"), "county_fips", X.legal_parts(F.col("legal")).alias("legal")), roll)


@query("""SELECT listing_id, p.parcel_id, p.jv AS arv_estimate, round(CASE WHEN l.list_price <> 0 AND tot_lvg_area > 0 THEN l.list_price / tot_lvg_area END, 2) AS price_per_sqft, CASE WHEN p.jv <> 0 AND l.list_price > 0 THEN p.jv - l.list_price END AS arv_spread FROM listings l JOIN parcels p ON l.county_fips = p.county_fips AND CAST(listing_id AS VARCHAR) = p.parcel_id""")
def match_financials(listings, parcels):
    p = parcels.select(*_ID, "jv", "tot_lvg_area")
    rows = listings.withColumn("parcel_id", F.col("listing_id").cast("string")).join(p, _ID)
    facts = P.listing_financials(F.lit(None).cast("long"), F.col("jv"), F.col("list_price"), F.col("tot_lvg_area"))
    return rows.select("listing_id", "parcel_id", *[c.alias(n) for n, c in facts.items()])


# Merges.


@query(
    """SELECT county_fips, parcel_id, CASE WHEN u THEN jv + 1 ELSE jv END AS jv, bedrooms, lnd_val FROM (SELECT *, CAST(parcel_id AS BIGINT) % 3 = 0 AS u FROM parcels)
 UNION ALL SELECT county_fips, 'N' || parcel_id, jv + 1, NULL, lnd_val FROM parcels WHERE CAST(parcel_id AS BIGINT) % 3 = 1"""
)
def roll_upsert(parcels):
    current = parcels.select(*_ID, "jv", "bedrooms", "lnd_val")
    third = F.col("parcel_id").cast("long") % 3
    moved = parcels.filter(third < 2).select("county_fips", F.when(third == 1, F.concat(F.lit("N"), "parcel_id")).otherwise(F.col("parcel_id")).alias("parcel_id"), (F.col("jv") + 1).alias("jv"), F.lit(99).cast("long").alias("bedrooms"), "lnd_val")
    return merge.upsert(current, moved, _ID, protected={"bedrooms"})


@query(
    """SELECT county_fips, parcel_id, CASE WHEN k % 3 = 0 THEN jv + 1 ELSE jv END AS jv, bedrooms FROM (SELECT *, CAST(parcel_id AS BIGINT) AS k FROM parcels)
 UNION ALL SELECT county_fips, 'N' || parcel_id, jv + 1, NULL FROM parcels WHERE CAST(parcel_id AS BIGINT) % 3 = 1"""
)
def keyed_table_upsert(parcels):
    """The roll's upsert into a table of files, done twice as after a run that failed at its end."""
    third = F.col("parcel_id").cast("long") % 3
    kept = sinks.KeyedTable(parcels.sparkSession, scratch_path(parcels.sparkSession, "keyed"), _ID, 16)
    kept.create(parcels.select(*_ID, "jv", "bedrooms"))
    moved = parcels.filter(third < 2).select("county_fips", F.when(third == 1, F.concat(F.lit("N"), "parcel_id")).otherwise(F.col("parcel_id")).alias("parcel_id"), (F.col("jv") + 1).alias("jv"))
    for _ in range(2):
        kept.upsert(moved, lambda now, changes: merge.upsert(now, changes, _ID, protected={"bedrooms"}))
    return kept.read()


@query("""SELECT source, CASE source WHEN 'clerk' THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS written, count(*) FILTER (workflow_status IS NULL) AS open, source = 'clerk' AS told FROM signals GROUP BY 1""")
def source_runs(signals):
    """A run of every source; one fails after it has written, and the others are not touched by that."""
    spark = signals.sparkSession
    path = scratch_path(spark, "sources")

    def work(source):
        def one(run):
            rows = signals.filter(F.col("source") == source).select("id", "source", "workflow_status")
            run.write(rows, lambda df: df.write.parquet(f"{path}/{source}"), open=F.col("workflow_status").isNull())
            if source == "clerk":
                raise ValueError("the clerk's last page is missing")

        return one

    log = sinks.run_sources(spark, f"{path}/log", {s: work(s) for s in ("auction", "clerk", "file")})
    return log.select("source", "status", F.col("counts")["written"].alias("written"), F.col("counts")["open"].alias("open"), F.coalesce(F.col("error").contains("last page"), F.lit(False)).alias("told"))


@query("""SELECT county_fips, parcel_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 AND k % 4 <> 0 THEN 7 ELSE bedrooms END AS bedrooms, CASE WHEN k % 2 = 0 THEN 'TILE' ELSE roof_type END AS roof_type FROM (SELECT *, CAST(parcel_id AS BIGINT) AS k FROM parcels)""")
def partial_enrichment(parcels):
    k = F.col("parcel_id").cast("long")
    incoming = parcels.filter((k % 2 == 0) | (k % 5 == 0)).select(*_ID, F.when((k % 2 == 0) & (k % 4 != 0), F.lit(7)).cast("long").alias("bedrooms"), F.when(k % 2 == 0, F.lit("TILE")).alias("roof_type"), F.when(k % 5 == 0, F.array(F.lit("bedrooms"))).otherwise(F.array().cast("array<string>")).alias("refused"))
    return merge.partial_update(parcels.select(*_ID, "bedrooms", "roof_type"), incoming, _ID, ["bedrooms", "roof_type"], "refused")


_SALE_KEY = ["county_fips", "parcel_id", "sale_date", "grantor", "grantee"]


@query("SELECT county_fips, parcel_id, sale_date, grantor, grantee FROM sales WHERE sale_date IS NOT NULL GROUP BY ALL")
def insert_absent_sales(sales):
    rows = sales.filter("sale_date is not null").select(*_SALE_KEY)
    current = rows.filter(F.col("parcel_id").cast("long") % 2 == 0).distinct()
    return merge.insert_absent(current, rows, _SALE_KEY)


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN sale_price + 1 ELSE sale_price END AS sale_price, qualification_code, CASE WHEN id % 3 = 0 THEN 'inserted' WHEN id % 5 = 0 THEN 'kept' WHEN id % 4 = 0 THEN 'updated' ELSE 'same' END AS change FROM sales WHERE id % 3 = 0 OR id % 5 <> 0 OR id % 4 <> 0
 UNION ALL SELECT id, sale_price, qualification_code, 'kept' FROM sales WHERE id % 3 <> 0 AND id % 5 = 0 AND id % 4 = 0""")
def upsert_changed_sales(sales):
    rows = sales.select("id", "sale_price", "qualification_code")
    bumped = rows.withColumn("sale_price", F.when(F.col("id") % 4 == 0, F.col("sale_price") + 1).otherwise(F.col("sale_price")))
    return merge.upsert_changed(rows.filter("id % 3 <> 0"), bumped.filter("id % 3 = 0 or id % 5 <> 0"), ["id"], ["sale_price", "qualification_code"])


@query("SELECT county_fips, parcel_id, coalesce(bedrooms, 3) AS bedrooms FROM parcels")
def fill_missing_bedrooms(parcels):
    return merge.fill_nulls(parcels.select(*_ID, "bedrooms"), parcels.select(*_ID, F.lit(3).cast("long").alias("bedrooms")), _ID, ["bedrooms"])


@query(
    """WITH runs AS (SELECT *, CASE WHEN id % 7 < 3 AND NOT (id > 500 AND source = 'auction') THEN 'SUCCESS' ELSE 'FAILED' END AS st FROM signals WHERE NOT (id > 500 AND source = 'clerk'))
 SELECT source, county_fips, arg_max(st, id) AS status, max(id) AS last_run_at, max(id) FILTER (st = 'SUCCESS') AS last_success_at FROM runs GROUP BY ALL"""
)
def source_health(signals):
    # Of the later runs, one source has failures only and one has none: their last success comes from the table before.
    good = (F.col("id") % 7 < 3) & ~((F.col("id") > 500) & (F.col("source") == "auction"))
    runs = signals.filter("not (id > 500 and source = 'clerk')").select("source", "county_fips", F.when(good, "SUCCESS").otherwise("FAILED").alias("status"), F.col("id").alias("run_at"))
    empty = runs.limit(0).select("source", "county_fips", "status", F.col("run_at").alias("last_run_at"), F.col("run_at").alias("last_success_at"))
    before = merge.source_status(empty, runs.filter("run_at <= 500"))
    return merge.source_status(before, runs.filter("run_at > 500"))


@query("SELECT parcel_id AS user_id, signal_tier AS profile_id, count(*) AS run_count, arg_max_null(list_price, id) AS last_total, min(id) AS first_run_at, max(id) AS last_run_at FROM signals GROUP BY ALL")
def profile_counters(signals):
    return merge.run_counters(signals.select(F.col("parcel_id").alias("user_id"), F.col("signal_tier").alias("profile_id"), F.col("list_price").alias("total"), F.col("id").alias("run_at")))


@query("""SELECT min(id) AS id FROM signals s WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM signals o WHERE o.id % 2 = 0 AND o.parcel_id = s.parcel_id AND o.list_price = s.list_price) GROUP BY parcel_id, list_price""")
def unseen_listings(signals):
    key = ["parcel_id", "list_price"]
    return merge.unseen(signals.filter("id % 2 = 1"), signals.filter("id % 2 = 0"), key, "id").select("id")


@query("SELECT parcel_id AS run_id, count(*) AS n_read, count(*) FILTER (id % 4 = 0) AS n_inserted, count(*) FILTER (id % 4 = 1) AS n_updated, count(*) FILTER (id % 4 = 2) AS n_rejected, count(*) FILTER (id % 4 = 3) AS n_skipped, nullif(count(*) FILTER (id % 4 = 2), 0) AS n_reason FROM signals GROUP BY 1")
def run_summaries(signals):
    names = F.array(*map(F.lit, ("inserted", "updated", "rejected", "skipped")))
    outcome = F.element_at(names, (F.col("id") % 4 + 1).cast("int"))
    rows = signals.select(F.col("parcel_id").alias("run_id"), outcome.alias("outcome"), F.when(outcome == "rejected", F.array("listing_type")).otherwise(F.array().cast("array<string>")).alias("reasons"))
    out = merge.run_summary(rows)
    return out.withColumn("n_reason", F.aggregate(F.map_values("reasons"), F.lit(0).cast("long"), lambda a, x: a + x)).drop("reasons")


# Workflow.


@query(
    """SELECT id, CASE WHEN ok THEN n ELSE workflow_status END AS workflow_status, CASE WHEN ok THEN CASE WHEN notes IS NULL THEN 'seen' ELSE notes || chr(10) || 'seen' END ELSE notes END AS notes, ok AS changed FROM (SELECT *, coalesce(n IS NOT NULL AND CASE coalesce(workflow_status, 'NEW')
 WHEN 'NEW' THEN n IN ('REVIEWED', 'REJECTED') WHEN 'REVIEWED' THEN n IN ('APPROVE_SEND', 'REJECTED') WHEN 'APPROVE_SEND' THEN n IN ('SENT', 'REVIEWED') WHEN 'SENT' THEN n IN ('RESPONDED', 'CLOSED', 'REJECTED')
 WHEN 'RESPONDED' THEN n IN ('CLOSED', 'REVIEWED') WHEN 'REJECTED' THEN n IN ('REVIEWED', 'CLOSED') ELSE false END, false) AS ok FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'REVIEWED' WHEN 1 THEN 'CLOSED' END AS n FROM signals))"""
)
def workflow_changes(signals):
    requests = signals.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "REVIEWED").otherwise("CLOSED").alias("new_status"), F.lit("seen").alias("note"))
    return workflow.apply_changes(signals.select("id", "workflow_status", "notes"), requests)


@query("SELECT DISTINCT id AS listing_event_id, signal_tier AS filter_profile_id FROM signals WHERE id % 2 = 1 AND signal_tier IS NOT NULL")
def outreach_scores_once(signals):
    rows = signals.filter("signal_tier is not null").select(F.col("id").alias("listing_event_id"), F.col("signal_tier").alias("filter_profile_id"))
    return workflow.new_score_rows(rows, rows.filter("listing_event_id % 2 = 0"))


# Joins and aggregates that stand alone.


@query("SELECT county_fips, parcel_id, max(sale_date) AS last_sale, 2025 - CAST(year(max(sale_date)) AS INT) AS years FROM parcels JOIN sales USING (county_fips, parcel_id) WHERE sale_date IS NOT NULL GROUP BY ALL")
def last_sale(parcels, sales):
    last = sales.filter("sale_date is not null").groupBy(*_ID).agg(F.max("sale_date").alias("last_sale"))
    return parcels.select(*_ID).join(last, _ID).withColumn("years", F.lit(2025) - F.year("last_sale"))


@query("SELECT county_fips, parcel_id FROM parcels p WHERE EXISTS (SELECT 1 FROM sales s WHERE s.county_fips = p.county_fips AND s.parcel_id = p.parcel_id AND sale_date IS NOT NULL)")
def parcels_with_dated_sale(parcels, sales):
    return parcels.select(*_ID).join(sales.filter("sale_date is not null").select(*_ID), _ID, "left_semi")


@query("SELECT county_fips, parcel_id FROM parcels p WHERE NOT EXISTS (SELECT 1 FROM signals s WHERE s.county_fips = p.county_fips AND s.parcel_id = p.parcel_id)")
def parcels_without_signal(parcels, signals):
    return parcels.select(*_ID).join(signals.select(*_ID), _ID, "left_anti")


@query("SELECT DISTINCT lpad(trim(phy_zipcd), 5, '0') AS zip_code FROM parcels WHERE phy_zipcd IS NOT NULL ORDER BY 1")
def distinct_zips(parcels):
    return parcels.select(F.lpad(F.trim("phy_zipcd"), 5, "0").alias("zip_code")).distinct().filter(F.col("zip_code").rlike(r"^\d+$")).orderBy("zip_code")


@query("SELECT county_fips, parcel_id FROM parcels WHERE enriched_on IS NULL AND dor_uc IN ('001') ORDER BY county_fips, parcel_id LIMIT 50")
def next_to_enrich(parcels):
    return parcels.filter("enriched_on is null").filter(F.col("dor_uc").isin("001")).orderBy(*_ID).limit(50).select(*_ID)


# Reports.

_ALL_HOMES = "parcels WHERE dor_uc = '001'"
_HOMES = _ALL_HOMES + " AND enriched_on IS NOT NULL"


@query(f"SELECT county_fips, count(*) AS total, count(enriched_on) AS enriched, count(*) FILTER (enriched_on IS NULL) AS remaining, min(enriched_on) AS first_on, max(enriched_on) AS last_on, round(100e0 * count(enriched_on) / count(*), 1) AS percent_done FROM {_ALL_HOMES} GROUP BY 1")
def report_progress(parcels):
    return reports.progress(parcels)


@query(
    "WITH r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, round(100e0 * count({c}) FILTER (county_fips = '12033') / count(*) FILTER (county_fips = '12033'), 1) AS rate_a, round(100e0 * count({c}) FILTER (county_fips = '12113') / count(*) FILTER (county_fips = '12113'), 1) AS rate_b FROM {_HOMES}" for c in reports.RATE_FIELDS)
    + ") SELECT *, abs(rate_a - rate_b) <= 5 AS parity FROM r"
)
def report_population_rates(parcels):
    return reports.population_rates(parcels)


def _bucket_sql(column, bounds, last):
    cases = " ".join(f"WHEN {column} < {b} THEN '{n}'" for b, n in bounds)
    return f"SELECT CASE WHEN {column} IS NULL THEN 'NULL' {cases} ELSE '{last}' END AS bucket, count(*) FILTER (county_fips = '12033') AS county_12033, count(*) FILTER (county_fips = '12113') AS county_12113 FROM {_HOMES} GROUP BY 1"


@query(_bucket_sql("act_yr_blt", reports.ERAS, "2010+"))
def report_eras(parcels):
    return reports.histogram(parcels, "act_yr_blt", reports.ERAS, "2010+")


@query(_bucket_sql("tot_lvg_area", reports.SIZES, "5000+"))
def report_sizes(parcels):
    return reports.histogram(parcels, "tot_lvg_area", reports.SIZES, "5000+")


@query(f"SELECT county_fips, round(avg(tot_lvg_area), 4) AS average, min(tot_lvg_area) AS least, max(tot_lvg_area) AS most, median(tot_lvg_area) AS median FROM {_HOMES} GROUP BY 1")
def report_area_statistics(parcels):
    return reports.area_statistics(parcels)


@query(f"SELECT roof_type AS code, count(*) AS n FROM {_HOMES} AND roof_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, code LIMIT 10")
def report_top_roofs(parcels):
    return reports.top_codes(parcels, "roof_type")


@query(f"SELECT coalesce(exterior_wall, 'NULL') AS code, count(*) FILTER (county_fips = '12033') AS county_12033, count(*) FILTER (county_fips = '12113') AS county_12113 FROM {_HOMES} GROUP BY 1")
def report_walls_by_county(parcels):
    return reports.pivoted(parcels, "exterior_wall")


@query(f"SELECT county_fips, count(*) AS enriched, count(*) FILTER (eff_yr_blt > act_yr_blt) AS remodelled, count(*) FILTER (eff_yr_blt - act_yr_blt > 10) AS major, round(avg(eff_yr_blt - act_yr_blt) FILTER (eff_yr_blt > act_yr_blt), 1) AS average_gap FROM {_HOMES} GROUP BY 1")
def report_remodel_gap(parcels):
    return reports.remodel_gap(parcels)


@query(
    f"""SELECT p.county_fips, count(DISTINCT p.parcel_id) AS homes, count(DISTINCT p.parcel_id) FILTER (s.id IS NOT NULL) AS sold, count(s.id) AS sales, count(s.sale_date) AS dated, round(count(s.id) / nullif(count(DISTINCT p.parcel_id) FILTER (s.id IS NOT NULL), 0), 4) AS per_sold,
 round(100e0 * count(DISTINCT p.parcel_id) FILTER (s.id IS NOT NULL) / count(DISTINCT p.parcel_id), 1) AS coverage FROM (SELECT * FROM {_HOMES}) p LEFT JOIN sales s USING (county_fips, parcel_id) GROUP BY 1"""
)
def report_sale_coverage(parcels, sales):
    return reports.sale_coverage(parcels, sales)


@query("SELECT county_fips, count(*) AS dated, count(*) FILTER (day(sale_date) = 1) AS on_first FROM sales WHERE sale_date IS NOT NULL GROUP BY 1")
def report_first_of_month(sales):
    return reports.first_of_month(sales)


@query(
    f"""SELECT county_fips, CASE WHEN n = 0 THEN '0 (no history)' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 6 THEN '4-6' ELSE '7+' END AS bucket, count(*) AS homes FROM
 (SELECT p.county_fips, p.parcel_id, count(s.id) AS n FROM (SELECT * FROM {_HOMES}) p LEFT JOIN sales s USING (county_fips, parcel_id) GROUP BY ALL) GROUP BY ALL"""
)
def report_sales_per_home(parcels, sales):
    return reports.sales_per_home(parcels, sales)


@query(
    f"""SELECT county_fips, count(*) AS deed_sales, count(e) AS priced, round(avg(e), 2) AS average, round(median(e), 2) AS median, round(min(e), 2) AS least, round(max(e), 2) AS most
 FROM (SELECT p.county_fips, CASE WHEN tot_lvg_area > 0 THEN sale_price / tot_lvg_area END AS e FROM sales s JOIN (SELECT * FROM {_HOMES}) p USING (county_fips, parcel_id) WHERE (instrument_type = 'WD' OR sale_type = 'WD') AND sale_price > 10000) GROUP BY 1"""
)
def report_price_per_sqft(parcels, sales):
    return reports.price_per_sqft(parcels, sales)


_HOT_COUNTY = "CASE WHEN id % 10 < 9 THEN '12033' WHEN id % 20 = 9 THEN '12113' END"


@query(f"""SELECT {_HOT_COUNTY} AS "group", count(sale_price) AS n, round(quantile_cont(sale_price, 0.25e0), 4) AS lower, round(quantile_cont(sale_price, 0.5e0), 4) AS median, round(quantile_cont(sale_price, 0.75e0), 4) AS upper FROM sales GROUP BY 1""")
def report_price_quartiles(sales):
    """Nine tenths of the sales in one county; no more than 256 of them in a row."""
    return reports.price_quartiles(sales, F.expr(_HOT_COUNTY), 256)


@query(
    f"""SELECT p.county_fips, count(*) AS n_rows, count(*) FILTER (tot_lvg_area < 100) AS tiny_area, count(*) FILTER (act_yr_blt > 2026) AS future_year, count(*) FILTER (act_yr_blt < 1800) AS ancient_year,
 count(*) FILTER (sale_price > 0 AND sale_price < 500 AND (instrument_type = 'WD' OR sale_type = 'WD')) AS token_deed FROM (SELECT * FROM {_HOMES}) p LEFT JOIN sales s USING (county_fips, parcel_id) GROUP BY 1"""
)
def report_suspicious(parcels, sales):
    return reports.suspicious(parcels, sales)


@query("SELECT coalesce(qualification_code, 'NULL') AS code, instrument_type, count(*) AS n, round(avg(sale_price), 2) AS mean_price FROM sales GROUP BY ALL")
def report_code_distribution(sales):
    return reports.code_distribution(sales)


@query("SELECT source, count(*) AS n, count(raw_json) AS with_json, count(*) FILTER (raw_json = '{}') AS empty_json, max(try_cast(json_extract_string(raw_json, '$.k') AS BIGINT)) AS top_k FROM signals GROUP BY 1")
def report_source_tags(signals):
    return reports.source_tags(signals)


# Access, caches and landed pages.


_PROFILE = "(CAST(parcel_id AS BIGINT) + CASE WHEN CAST(parcel_id AS BIGINT) % 5 = 0 AND id % 3 = 0 THEN 1 ELSE 0 END) % 40"


@query(f"SELECT profile, counties FROM (SELECT {_PROFILE} AS profile, string_agg(DISTINCT county_fips, ',' ORDER BY county_fips) AS counties FROM signals GROUP BY 1) WHERE counties = '12033'")
def granted_profiles(signals):
    profiles = signals.groupBy(F.expr(_PROFILE).alias("profile")).agg(F.sort_array(F.collect_set("county_fips")).alias("county_fips"))  # two counties at most
    return filters.fully_granted(profiles, ["12033"]).select("profile", F.array_join("county_fips", ",").alias("counties"))


@query("SELECT county_fips, parcel_id, contact IS NOT NULL AS cached, contact FROM parcels LEFT JOIN (SELECT county_fips, parcel_id, arg_max('c' || CAST(id AS VARCHAR), id) AS contact FROM signals WHERE id > 5000 GROUP BY ALL) USING (county_fips, parcel_id)")
def contact_cache(parcels, signals):
    cache = signals.select(*_ID, F.concat(F.lit("c"), F.col("id").cast("string")).alias("contact"), F.col("id").alias("expires_at"))
    return workflow.cached_or_missing(parcels.select(*_ID), cache, F.lit(5000)).select(*_ID, "cached", "contact")


@query("SELECT id FROM (SELECT id, CASE WHEN id % 13 = 0 THEN 'PARKED' ELSE workflow_status END AS workflow_status FROM signals) WHERE workflow_status IS NOT NULL AND workflow_status NOT IN ('NEW', 'REVIEWED', 'APPROVE_SEND', 'SENT', 'RESPONDED', 'REJECTED', 'CLOSED')")
def unknown_states(signals):
    return workflow.invalid_states(signals.withColumn("workflow_status", F.when(F.col("id") % 13 == 0, "PARKED").otherwise(F.col("workflow_status")))).select("id")


@query("SELECT profile, county_fips, favourite FROM (SELECT DISTINCT signal_tier AS profile, county_fips, signal_tier = 1 AS favourite FROM signals) ORDER BY favourite DESC NULLS LAST, profile NULLS FIRST, county_fips")
def profiles_in_order(signals):
    rows = signals.select(F.col("signal_tier").alias("profile"), "county_fips", (F.col("signal_tier") == 1).alias("favourite")).distinct()
    return rows.orderBy(F.desc_nulls_last("favourite"), F.asc_nulls_first("profile"), "county_fips")


@query("SELECT count(*) FILTER (workflow_status = 'NEW') AS drafts, count(*) FILTER (workflow_status = 'SENT' AND created_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY) AS sent_in_week FROM signals")
def dashboard_counts(signals):
    since = F.expr("timestamp '2024-01-20 00:00:00' - interval 7 days")
    return signals.agg(F.count_if(F.col("workflow_status") == "NEW").alias("drafts"), F.count_if((F.col("workflow_status") == "SENT") & (F.col("created_at") >= since)).alias("sent_in_week"))


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


_LIST_RULE = pages.PageRule("<li", "</h1>", ("404",))
QUERIES["landed_page_kinds"] = lambda spark, sf_dir: _pages(spark, sf_dir).groupBy(pages.page_kind(F.col("html"), _LIST_RULE).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
ORACLE_SQL["landed_page_kinds"] = r"""SELECT CASE WHEN html IS NULL THEN 'TRANSIENT' WHEN NOT contains(html, '<li') THEN 'SOFT_BLOCK' WHEN contains(html, '404') THEN 'NOT_FOUND' WHEN NOT contains(html, '</h1>') THEN 'TRANSIENT' ELSE 'OK' END AS kind, count(*) AS n FROM pages GROUP BY 1"""
QUERIES["landed_page_titles"] = lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", pages.tag_text(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"), F.size(pages.all_matches(F.col("html"), r"(?is)<li[^>]*>(.*?)</li>")).alias("items"))
ORACLE_SQL["landed_page_titles"] = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
 CAST(len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) AS INT) AS items FROM pages"""


@query(
    r"""SELECT page_id, CASE WHEN answer IS NULL THEN 'TRANSIENT'
 WHEN county_fips = '12033' THEN CASE WHEN contains(lower(redirects), '/cama/search.aspx') THEN 'NOT_FOUND' WHEN regexp_matches(lower(redirects), '^https://(www\.)?escpa\.org/*$') THEN 'SOFT_BLOCK'
  WHEN NOT contains(answer, 'Parcel ID:') THEN 'SOFT_BLOCK' WHEN NOT contains(answer, 'General Information') THEN 'TRANSIENT' ELSE 'OK' END
 WHEN NOT contains(answer, 'window.__remixContext') THEN 'SOFT_BLOCK' WHEN regexp_matches(answer, '"empty": ?true') THEN 'NOT_FOUND' ELSE 'OK' END AS kind FROM landed"""
)
def page_kinds(landed):
    return landed.select("page_id", pages.county_page_kind(F.col("county_fips"), F.col("answer"), F.split("redirects", " ")).alias("kind"))


@query(
    """SELECT page_id, 'BRICK' AS exterior_wall, CASE WHEN page_id % 7 > 0 THEN page_id % 7 * 300 END AS tot_lvg_area, CASE WHEN page_id % 25 BETWEEN 1 AND 20 THEN page_id % 25 END AS bedrooms, 1 + page_id % 3 + 0.5e0 AS bathrooms,
 CASE WHEN page_id % 200 >= 10 THEN 1790 + page_id % 200 END AS act_yr_blt, 'R' || CAST(page_id % 4 AS VARCHAR) AS zoning, 'CLASS ' || CAST(page_id % 6 AS VARCHAR) AS cama_quality_code,
 concat_ws(',', CASE WHEN page_id % 200 < 10 THEN 'act_yr_blt' END, CASE WHEN page_id % 25 NOT BETWEEN 1 AND 20 THEN 'bedrooms' END) AS refused FROM landed"""
)
def card_buildings(landed):
    facts, refused = P.building_facts(F.lit(2026))
    wanted = ("exterior_wall", "tot_lvg_area", "bedrooms", "bathrooms", "act_yr_blt", "zoning", "cama_quality_code")
    return pages.card_of(landed.select("page_id", F.col("card").alias("html"))).select("page_id", *[facts[c].alias(c) for c in wanted], F.array_join(refused, ",").alias("refused"))


@query("SELECT page_id, CAST(make_date(1990 + page_id % 30, 1 + page_id % 12, 1 + page_id % 28) AS DATE) AS sale_date, page_id * 1000 + 500 AS sale_price, 'WD' AS instrument_type, CAST(NULL AS VARCHAR) AS qualification_code, 'A & B ' || CAST(page_id AS VARCHAR) AS grantor FROM landed")
def named_cell_sales(landed):
    return pages.cell_sales_of(landed.select("page_id", F.col("sales_page").alias("html"))).select("page_id", "sale_date", "sale_price", "instrument_type", "qualification_code", "grantor")


@query(
    """SELECT page_id, CAST(100 + page_id AS VARCHAR) || ' OAK ST' AS address, CASE WHEN page_id % 60 < 40 THEN '325' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') END AS zip, '2024 CA ' || CAST(page_id AS VARCHAR) AS case_number,
 page_id * 1000 AS opening_bid, CASE WHEN page_id % 9 = 1 AND page_id % 30 > 28 THEN NULL ELSE make_date(2024, 1 + page_id % 9, 1 + page_id % 30) END AS auction_date FROM landed"""
)
def auction_items(landed):
    return pages.auction_items_of(landed.select("page_id", F.col("calendar").alias("html"))).select("page_id", "address", "zip", "case_number", "opening_bid", "auction_date")


@query(
    """SELECT page_id, '2024 CA ' || CAST(page_id AS VARCHAR) AS case_number, CAST(page_id % 40 AS VARCHAR) AS lot, CASE WHEN page_id % 3 <> 0 THEN 'B' || CAST(page_id % 7 AS VARCHAR) END AS block, 'PINE HILLS ' || CAST(page_id % 5 AS VARCHAR) AS subdivision,
 CASE WHEN page_id % 4 = 0 THEN '1' || CAST(page_id % 9 AS VARCHAR) END AS sec, CASE WHEN page_id % 4 = 0 THEN '3N' END AS twp, CASE WHEN page_id % 4 = 0 THEN '31W' END AS rge FROM landed"""
)
def legal_fields(landed):
    return landed.select("page_id", F.explode(F.array(X.legal_parts(F.col("legal")))).alias("p")).select("page_id", "p.*")


@query(
    """SELECT page_id, CASE WHEN page_id % 4 > 0 THEN 'JANE DOE ' || CAST(page_id AS VARCHAR) WHEN page_id % 3 = 0 THEN 'FIRST BANK NA' ELSE 'TRUST ' || CAST(page_id AS VARCHAR) END AS owner,
 make_date(2024, CASE page_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 12 END, 1 + page_id % 28) AS auction_date, make_date(2001, 1 + page_id % 12, 1) AS sale_date, 'Dear ' || CAST(page_id AS VARCHAR) || '$1, !' AS letter FROM landed"""
)
def owners_and_dates(landed):
    k = F.col("page_id").cast("string")
    day = (F.col("page_id") % 28 + 1).cast("string")
    return landed.select(
        "page_id", X.owner_name(F.col("owners")).alias("owner"), X.auction_date(F.concat_ws(" ", "month", F.concat(day, F.when(F.col("page_id") % 2 == 0, ",").otherwise("")), F.lit("2024"))).alias("auction_date"),
        X.sale_date(F.concat_ws("/", (F.col("page_id") % 12 + 1).cast("string"), F.lit("2001"))).alias("sale_date"), X.rendered(F.lit("Dear {{ name }}, {{none}}!"), {"name": F.concat(k, F.lit("$1"))}).alias("letter"),
    )


@query("SELECT county_fips, parcel_id FROM parcels WHERE jv IS NOT NULL AND CAST(parcel_id AS BIGINT) % 3 <> 0")
def arv_resumed(parcels, sales):
    done = parcels.withColumn("arv_estimate", F.when(F.col("parcel_id").cast("long") % 3 == 0, F.lit(1).cast("long")))
    return arv.valuation(done, sales, resume=True).select(*_ID)


@query(
    _SCORED_SQL.replace("SELECT county_fips, parcel_id, jv, arv_spread", "SELECT listing_type, county_fips, parcel_id, jv, arv_spread").replace("AS tw FROM joined", "AS tw FROM joined WHERE listing_type IN ('click', 'purchase', 'view') AND days_on_market BETWEEN 20 AND 400")
    + " SELECT county_fips, parcel_id, deal_score FROM scored WHERE deal_score >= 0.3"
)
def search_by_event_dimensions(parcels, signals):
    criteria = {"filters": {"listing_types": {"include": ["click", "purchase", "view"]}, "days_on_market": {"min": 20, "max": 400}, "min_deal_score": {"value": 0.3}}}
    return search.scored(_with_absentee(parcels), signals, criteria, WEIGHTS).select(*_ID, "deal_score")


@query("WITH " + LATEST_SQL + " SELECT p.county_fips, p.parcel_id, p.jv, CAST(NULL AS DOUBLE) AS deal_score, e.signal_tier FROM parcels p LEFT JOIN latest e USING (county_fips, parcel_id) WHERE p.parcel_id IN ('17', '18', '20', '99999999') AND p.county_fips IN ('12033')")
def parcel_lookup(parcels, signals):
    return search.lookup(parcels, signals, ["17", "18", "20", "99999999"], ["12033"]).select(*_ID, "jv", "deal_score", "signal_tier")


@query("SELECT county_fips, parcel_id, jv, CASE WHEN CAST(parcel_id AS BIGINT) % 3 = 0 THEN CASE WHEN CAST(parcel_id AS BIGINT) % 2 = 0 THEN 7 END ELSE bedrooms END AS bedrooms FROM parcels")
def replaced_columns(parcels):
    k = F.col("parcel_id").cast("long")
    computed = parcels.filter(k % 3 == 0).select(*_ID, F.when(k % 2 == 0, F.lit(7).cast("long")).alias("bedrooms"))
    return merge.replace_columns(parcels.select(*_ID, "jv", "bedrooms"), computed, _ID, ["bedrooms"])


# Shapefiles and planes.


def _square(x, y, half):
    corner = lambda dx, dy: F.struct((x + dx * half).alias("x"), (y + dy * half).alias("y"))
    return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1))


def _lots(parcels):
    """Parcels as squares in feet with a hole, some of two parts, some without geometry; the centroid is the parcel's place."""
    k = F.col("parcel_id").cast("long")
    x, y = J.to_plane(J.ZONES[2883], F.col("lon"), F.col("lat"))
    at = parcels.filter("lat is not null").select("parcel_id", "county_fips", "jv", x.alias("x"), y.alias("y"), (40 + k % 60).cast("double").alias("half"), k.alias("k"))
    x, y, half = F.col("x"), F.col("y"), F.col("half")
    part = lambda dx, hole: F.struct(_square(x + dx, y, half).alias("ring"), (F.array(_square(x + dx, y, half / 3)) if hole else F.array().cast("array<array<struct<x:double,y:double>>>")).alias("holes"))
    parts = F.when(F.col("k") % 11 == 0, None).when(F.col("k") % 5 == 0, F.array(part(-3 * half, True), part(3 * half, True))).when(F.col("k") % 3 == 0, F.array(part(F.lit(0.0), False))).otherwise(F.array(part(F.lit(0.0), True)))
    return at.select("parcel_id", "county_fips", "jv", parts.alias("parts"))


@query(
    """SELECT parcel_id, county_fips, jv, CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS INT) AS n_parts, CAST(CASE WHEN k % 5 = 0 THEN 2 WHEN k % 3 = 0 THEN 0 ELSE 1 END AS INT) AS n_holes, round(lat, 7) AS lat, round(lon, 7) AS lon
 FROM (SELECT *, CAST(parcel_id AS BIGINT) AS k FROM parcels) WHERE lat IS NOT NULL AND k % 11 <> 0"""
)
def shapefile_parcels(parcels):
    spark, plane = parcels.sparkSession, J.ZONES[2883]
    path = scratch_path(spark, "shapefile")
    shapefile.write_shapefile(_lots(dealt(parcels, *_ID)), path, plane)
    found, _ = shapefile.plane_of(path, plane)
    rows = shapefile.parcel_places(shapefile.read_shapefile(spark, path, records=200), found)
    holes = F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(p["holes"]))
    return rows.select("parcel_id", F.col("county_fip").alias("county_fips"), "jv", F.size("parts").alias("n_parts"), holes.alias("n_holes"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def _conic_sql(lon: str, lat: str) -> str:
    """Easting and northing of the northern zone as the textbook writes them: 2 standard parallels, whole formulas, no series."""
    p = J.ZONES[2883]
    e = f"sqrt({p.f * (2 - p.f)!r}e0)" if "e" not in repr(p.f * (2 - p.f)) else f"sqrt({p.f * (2 - p.f)!r})"
    t = lambda f: f"(tan(pi() / 4 - ({f}) / 2) / pow((1 - {e} * sin({f})) / (1 + {e} * sin({f})), {e} / 2))"
    m = lambda f: f"(cos({f}) / sqrt(1 - {e} * {e} * sin({f}) * sin({f})))"
    a, b, o = (f"radians({v!r})" for v in (*p.parallels, p.lat0))
    n = f"((ln({m(a)}) - ln({m(b)})) / (ln({t(a)}) - ln({t(b)})))"
    r = lambda f: f"({p.a!r} / {p.unit!r} * {m(a)} / ({n} * pow({t(a)}, {n})) * pow({t(f)}, {n}))"
    return f"round({p.east!r} + {r(f'radians({lat})')} * sin({n} * radians({lon} - ({p.lon0!r}))), 4) AS x, round({r(o)} - {r(f'radians({lat})')} * cos({n} * radians({lon} - ({p.lon0!r}))), 4) AS y"


@query(f"SELECT county_fips, parcel_id, {_conic_sql('lon', 'lat')} FROM parcels WHERE lat IS NOT NULL")
def plane_coordinates(parcels):
    x, y = J.to_plane(J.ZONES[2883], F.col("lon"), F.col("lat"))
    return parcels.filter("lat is not null").select(*_ID, F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


# Landed pages by table functions.


@query(
    """SELECT page_id, 'BRICK & STONE / VINYL' AS exterior_wall, 'METAL' AS roof_type, 'SLAB ' || CAST(page_id % 4 AS VARCHAR) AS foundation, CAST(CASE WHEN page_id % 3 = 0 THEN 700 ELSE 800 END + page_id AS VARCHAR) AS living_area,
 CAST(1900 + page_id % 120 AS VARCHAR) AS act_yr_blt, CAST(1950 + page_id % 70 AS VARCHAR) AS eff_yr_blt, 'R-' || CAST(page_id % 5 AS VARCHAR) AS zoning FROM landed"""
)
def appraiser_buildings(landed):
    rows = county_pages.rows_of(landed.select("page_id", F.col("appraiser").alias("html")), "escambia_building")
    return rows.select("page_id", "exterior_wall", "roof_type", "foundation", "living_area", "act_yr_blt", "eff_yr_blt", "zoning")


@query(
    """SELECT page_id, CAST(0 AS INT) AS at, make_date(2001, 1 + page_id % 9, 1) AS sale_date, page_id * 1000 + 500 AS sale_price, 'WD' AS instrument_type, CASE WHEN page_id % 2 = 0 THEN 'Y' ELSE 'N' END AS multi_parcel FROM landed
 UNION ALL SELECT page_id, 1, DATE '1999-03-04', 7, 'CT', 'N' FROM landed WHERE page_id % 7 <> 0"""
)
def appraiser_sales(landed):
    rows = county_pages.rows_of(landed.select("page_id", F.col("appraiser").alias("html")), "escambia_sales")
    return county_pages.typed_sales(rows).select("page_id", "at", "sale_date", "sale_price", "instrument_type", "multi_parcel")


@query(
    """SELECT page_id, '2024 TD ' || CAST(page_id AS VARCHAR) AS clerk_file, 'A' || CAST(page_id % 9 AS VARCHAR) AS account, make_date(2024, 5, 1 + page_id % 28) AS sales_date, page_id * 1000 + 1 AS opening_bid_amount,
 'LOT 1 BLK ' || CAST(page_id % 5 AS VARCHAR) || ' more' AS legal_description FROM landed WHERE page_id % 6 <> 0"""
)
def clerk_tax_sales(landed):
    spark = landed.sparkSession
    county_pages.register(spark)
    landed.select("page_id", F.col("clerk_page").alias("html")).createOrReplaceTempView("clerk_pages")
    rows = spark.sql("SELECT page_id, s.* FROM clerk_pages, LATERAL escambia_clerk_sales(html) s")
    return county_pages.typed_clerk_sales(rows).select("page_id", "clerk_file", "account", "sales_date", "opening_bid_amount", "legal_description")


@query("SELECT page_id, 'BRICK' AS exterior_wall, CAST(page_id % 25 AS VARCHAR) AS bedrooms, CAST(1 + page_id % 3 AS VARCHAR) || '.5' AS bathrooms, 'CLASS ' || CAST(page_id % 6 AS VARCHAR) AS quality_code FROM landed")
def card_grids(landed):
    return county_pages.rows_of(landed.select("page_id", F.col("card").alias("html")), "santa_rosa_card").select("page_id", "exterior_wall", "bedrooms", "bathrooms", "quality_code")


# Files of lines: written from the listings, then read in splits.


def _written_lines(listings, *lines):
    path = scratch_path(listings.sparkSession, "lines")
    listings.select(F.explode(F.array(*[F.expr(line) for line in lines])).alias("value")).write.text(path)
    return path


@query(
    """SELECT '2024 CA ' || CAST(listing_id AS VARCHAR) AS case_number, 'P' || CAST(listing_id AS VARCHAR) AS parcel_id, listing_id * 1000 + 500 AS judgment, CASE WHEN listing_id % 4 = 0 THEN NULL ELSE listing_id END AS assessed_value,
 CAST(listing_id AS VARCHAR) || ' OAK ST' AS street, 'Pace, FL' AS city_state_zip, make_date(2024, 1 + listing_id % 9, 10 + listing_id % 9) AS auction_date FROM listings WHERE listing_id % 10 <> 0"""
)
def foreclosure_files(listings):
    path = _written_lines(
        listings, "concat('Auction Starts:,\"0', 1 + listing_id % 9, '/', 10 + listing_id % 9, '/2024 11:00 AM\"')", "concat('Case #:,2024 CA ', listing_id)", "concat('Parcel ID:,', if(listing_id % 10 = 0, ' ', concat('P', listing_id)))", "''",
        "concat('Final Judgment Amount:,\"$', listing_id, ',500.75\"')", "concat('Assessed Value:,', if(listing_id % 4 = 0, 'n/a', concat('$', listing_id)))", "concat('Property Address:,', listing_id, ' OAK ST')", "',\"Pace, FL\"'",
    )
    return files.read_foreclosures(listings.sparkSession, path).select("case_number", "parcel_id", "judgment", "assessed_value", "street", "city_state_zip", "auction_date")


@query(
    """SELECT listing_id * 1000 AS list_price, CAST(CASE WHEN listing_id % 5 > 0 THEN listing_id % 5 END AS INT) AS bedrooms, CAST(listing_id AS VARCHAR) || ' Oak St, Pace, FL 32571' AS address, 'REALTY ' || CAST(listing_id AS VARCHAR) AS brokerage FROM listings"""
)
def listing_files(listings):
    path = _written_lines(listings, "concat('\"$', listing_id, ',000\"')", "'Save'", "concat(if(listing_id % 5 > 0, concat(listing_id % 5, ' bds2 ba'), ''), '1,319 sqftForeclosure')", "concat('\"', listing_id, ' Oak St, Pace, FL 32571\"')", "concat('REALTY ', listing_id)", "'More'")
    return files.read_listings(listings.sparkSession, path).select("list_price", F.col("bedrooms").cast("int").alias("bedrooms"), "address", "brokerage")


# Access and seeds.

_COUNTIES = "(VALUES ('12033', 'Escambia', 27, true), ('12113', 'Santa Rosa', 67, true), ('12091', 'Okaloosa', 56, false))"


def _counties(spark):
    return spark.createDataFrame([("12033", "Escambia", 27, True), ("12113", "Santa Rosa", 67, True), ("12091", "Okaloosa", 56, False)], "county_fips string, county_name string, county_no int, active boolean")


@query(f"SELECT user_id, county_name, county_no FROM (SELECT DISTINCT parcel_id AS user_id, CASE WHEN id % 5 = 0 THEN '12091' ELSE county_fips END AS county_fips FROM signals) JOIN {_COUNTIES} AS c(county_fips, county_name, county_no, active) USING (county_fips) WHERE active")
def granted_counties(signals):
    access = signals.select(F.col("parcel_id").alias("user_id"), F.when(F.col("id") % 5 == 0, "12091").otherwise(F.col("county_fips")).alias("county_fips"))
    return workflow.granted(access, _counties(signals.sparkSession).filter("active"), ["county_fips"]).select("user_id", "county_name", "county_no")


@query(
    """WITH prefs AS (SELECT parcel_id AS user_id, signal_tier AS profile_id, max(id % 3 = 0) AS favourite, max(created_at) AS searched, count(*) AS runs FROM signals GROUP BY ALL), profiles AS (SELECT DISTINCT signal_tier AS profile_id, 'profile ' || CAST(signal_tier AS VARCHAR) AS name FROM signals WHERE signal_tier < 4)
 SELECT user_id, profile_id, name, runs, row_number() OVER (PARTITION BY user_id ORDER BY favourite DESC, searched DESC NULLS LAST, runs DESC, profile_id) AS place FROM prefs JOIN profiles USING (profile_id)"""
)
def profile_activity(signals):
    prefs = signals.groupBy(F.col("parcel_id").alias("user_id"), F.col("signal_tier").alias("profile_id")).agg(F.max(F.col("id") % 3 == 0).alias("favourite"), F.max("created_at").alias("last_searched_at"), F.count(F.lit(1)).alias("runs"))
    profiles = signals.filter("signal_tier < 4").select(F.col("signal_tier").alias("profile_id"), F.concat(F.lit("profile "), F.col("signal_tier").cast("string")).alias("name")).distinct()
    rows = workflow.granted(prefs, profiles, ["profile_id"])
    place = spatial.rank_within(["user_id"], F.desc("favourite"), F.desc_nulls_last("last_searched_at"), F.desc("runs"), F.asc("profile_id"))
    return rows.select("user_id", "profile_id", "name", "runs", place.cast("long").alias("place"))


@query("SELECT county_fips, parcel_id, jv, seeded FROM (SELECT county_fips, parcel_id, jv, false AS seeded FROM parcels WHERE CAST(parcel_id AS BIGINT) % 3 > 0 UNION ALL SELECT county_fips, parcel_id, 0, true FROM parcels WHERE CAST(parcel_id AS BIGINT) % 3 = 0)")
def seeds_do_nothing(parcels):
    """Seeds of every key join those that are there; keys that are there stay as they are."""
    there = parcels.filter(F.col("parcel_id").cast("long") % 3 > 0).select(*_ID, "jv", F.lit(False).alias("seeded"))
    seeds = parcels.select(*_ID, F.lit(0).cast("long").alias("jv"), F.lit(True).alias("seeded"))
    return merge.insert_absent(there, seeds.unionByName(seeds), _ID)


@query("SELECT 'Lis Pendens ' || CAST(listing_id % 2 AS VARCHAR) AS kind, '2024 <CA> & ' || CAST(listing_id AS VARCHAR) AS number, 'R' || CAST(listing_id % 3 AS VARCHAR) AS status FROM listings WHERE listing_id % 3 > 0 AND listing_id % 5 > 0")
def court_workbooks(listings):
    """Court rows written to workbooks, a task each, and read again."""
    spark, k = listings.sparkSession, F.col("listing_id")
    path = scratch_path(spark, "workbooks")
    kind = F.when(k % 5 == 0, "Deed").otherwise(F.concat(F.lit("Lis Pendens "), (k % 2).cast("string")))
    rows = listings.select(kind.alias("Doc Type "), F.concat(F.lit("2024 <CA> & "), k.cast("string")).alias("Case"), F.when(k % 3 > 0, F.concat(F.lit("R"), (k % 3).cast("string"))).alias("Status"))
    workbook.write_workbooks(rows.repartition(4, "Case"), path)
    return files.read_court_records(spark, f"{path}/*.xlsx").select(F.col("Doc Type").alias("kind"), F.col("Case").alias("number"), F.col("Status").alias("status"))
