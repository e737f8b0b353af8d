"""Coercions and derived fields of parcels as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrelens.functions.text import digits, non_empty, number

#: Which mailing line holds the street, by county; others use the second.
MAILING_LINE = {"12033": "OWN_ADDR1", "12113": "OWN_ADDR2"}

# Roll column, parcel column, kind (i: integer, u: use code, s: text, s<n>: text cut to n).
ROLL_COLUMNS = """
PARCEL_ID parcel_id s
STATE_PAR_ID state_par_id s30
CO_NO co_no i
ASMNT_YR asmnt_yr i
DOR_UC dor_uc u
PA_UC pa_uc s10
JV jv i
AV_NSD av_nsd i
TV_NSD tv_nsd i
AV_SD av_sd i
TV_SD tv_sd i
JV_HMSTD jv_hmstd i
LND_VAL lnd_val i
EXMPT_01 exmpt_01 i
NCONST_VAL nconst_val i
DEL_VAL del_val i
PAR_SPLT par_splt s5
DISTR_CD distr_cd i
DISTR_YR distr_yr i
SPASS_CD spass_cd s1
LND_SQFOOT lnd_sqfoot i
DT_LAST_INSPT dt_last_inspt s4
IMP_QUAL imp_qual i
CONST_CLASS const_class i
EFF_YR_BLT eff_yr_blt i
ACT_YR_BLT act_yr_blt i
TOT_LVG_AREA tot_lvg_area i
NO_BULDNG no_buldng i
NO_RES_UNTS no_res_unts i
SPEC_FEAT_VAL spec_feat_val i
MULTI_PAR_SAL1 multi_par_sal1 s1
QUAL_CD1 qual_cd1 s2
VI_CD1 vi_cd1 s1
SALE_PRC1 sale_prc1 i
SALE_YR1 sale_yr1 i
SALE_MO1 sale_mo1 i
SAL_CHNG_CD1 sal_chng_cd1 s1
MULTI_PAR_SAL2 multi_par_sal2 s1
QUAL_CD2 qual_cd2 s2
VI_CD2 vi_cd2 s1
SALE_PRC2 sale_prc2 i
SALE_YR2 sale_yr2 i
SALE_MO2 sale_mo2 i
SAL_CHNG_CD2 sal_chng_cd2 s1
OWN_NAME own_name s50
OWN_ADDR1 own_addr1 s40
OWN_ADDR2 own_addr2 s40
OWN_CITY own_city s40
OWN_STATE own_state s25
OWN_ZIPCD own_zipcd s5
OWN_STATE_DOM own_state_dom s2
PHY_ADDR1 phy_addr1 s40
PHY_CITY phy_city s40
PHY_ZIPCD phy_zipcd s5
MKT_AR mkt_ar s3
NBRHD_CD nbrhd_cd s10
TWN twn s3
RNG rng s3
SEC sec s3
CENSUS_BK census_bk s16
ALT_KEY alt_key s26
S_LEGAL s_legal s30
"""


def roll_int(c: Column) -> Column:
    """Number text truncated to an integer; null if no number or zero."""
    return F.nullif(F.trim(c).try_cast("double").try_cast("int"), F.lit(0))


def filter_int(c: Column) -> Column:
    """Plain positive integer text; null for anything else, decimals included."""
    value = F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))
    return F.when(value > 0, value)


def use_code(c: Column) -> Column:
    """Land use code as at least three characters with leading zeros; null if no whole number."""
    value = F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))
    text = F.abs(value).cast("string")
    sign, width = F.when(value < 0, "-").otherwise(""), F.when(value < 0, 2).otherwise(3)
    return F.concat(sign, F.when(F.length(text) < width, F.lpad(text, width, F.lit("0"))).otherwise(text))


def improvement_ratio(jv: Column, land: Column) -> Column:
    """(value - land) / land in four places, within +-9999.9999; null without value or land value."""
    ratio = F.try_divide((jv - land).cast("double"), land.cast("double"))
    # greatest and least skip nulls, so a missing ratio must not reach them.
    return F.when(ratio.isNotNull(), F.round(F.greatest(F.least(ratio, F.lit(9999.9999)), F.lit(-9999.9999)), 4))


def cap_ratio(assessed: Column, jv: Column) -> Column:
    return F.round(F.try_divide(assessed.cast("double"), jv.cast("double")), 4)


def years_since_sale(assessed_in: Column, sold_in: Column) -> Column:
    years = assessed_in - sold_in
    return F.when(years >= 0, years)


def absentee(state: Column, mailing: Column, situs: Column) -> Column:
    """Whether the owner lives elsewhere; null where it can't be told."""
    clean = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    state, mailing, situs = clean(state), clean(mailing), clean(situs)
    return (
        F.when((state != "") & (state != "FL"), True)
        .when(mailing == "", None)
        .when(mailing.startswith("PO ") | mailing.startswith("P.O."), True)
        .when(~mailing.rlike(r"^\d"), None)
        .when(situs == "", None)
        .otherwise(mailing != situs)
    )


def absentee_or_not(state: Column, mailing: Column, situs: Column) -> Column:
    return F.coalesce(absentee(state, mailing, situs), F.lit(False))


def mailing_line(county: Column, line1: Column, line2: Column) -> Column:
    first = [fips for fips, column in MAILING_LINE.items() if column == "OWN_ADDR1"]
    return F.when(county.isin(first), line1).otherwise(line2)


def roll_projection(county: Column) -> list[Column]:
    """All parcel columns of a raw roll row, typed, with the derived ones."""
    kinds = {"i": roll_int, "u": use_code}
    out = [county.alias("county_fips")]
    for line in ROLL_COLUMNS.split("\n"):
        if line:
            source, name, kind = line.split()
            column = F.col(source)
            typed = kinds[kind](column) if kind in kinds else non_empty(column, int(kind[1:]) if kind[1:] else None)
            out.append(typed.alias(name))
    i = lambda name: roll_int(F.col(name))
    return [
        *out,
        absentee(F.col("OWN_STATE"), mailing_line(county, F.col("OWN_ADDR1"), F.col("OWN_ADDR2")), F.col("PHY_ADDR1")).alias("absentee_owner"),
        improvement_ratio(i("JV"), i("LND_VAL")).alias("improvement_to_land_ratio"),
        cap_ratio(i("AV_NSD"), i("JV")).alias("soh_compression_ratio"),
        years_since_sale(i("ASMNT_YR"), i("SALE_YR1")).alias("years_since_last_sale"),
    ]


def building_facts(year: Column) -> tuple[dict[str, Column], Column]:
    """Typed building columns of a raw page row, and the names of those that a sanity guard rejected.

    ``year`` is the latest year a building may have.
    """
    built, effective, area, beds = (digits(F.col(c)) for c in ("act_yr_blt", "eff_yr_blt", "living_area", "bedrooms"))
    baths = number(F.col("bathrooms"))
    bad = {
        "act_yr_blt": (built != 0) & ~built.between(1800, year),
        "tot_lvg_area": area <= 0,
        "bedrooms": ~beds.between(1, 20),
        "bathrooms": ~baths.between(0.5, 20.0),
    }
    values = {"act_yr_blt": built, "eff_yr_blt": effective, "tot_lvg_area": area, "bedrooms": beds, "bathrooms": baths}
    values = {n: F.when(~F.coalesce(bad[n], F.lit(False)), v) if n in bad else v for n, v in values.items()}
    texts = {"exterior_wall": ("exterior_wall", 100), "roof_type": ("roof_type", 100), "foundation_type": ("foundation", 100), "zoning": ("zoning", 20), "cama_quality_code": ("quality_code", 10), "cama_condition_code": ("condition_code", 10)}
    values |= {n: non_empty(F.col(c), most) for n, (c, most) in texts.items()}
    return values, F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), n) for n, b in bad.items()]))


def bucket(c: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that the value is below; 'NULL' for null."""
    out = F.when(c.isNull(), "NULL")
    for bound, label in bounds:
        out = out.when(c < bound, label)
    return out.otherwise(last)


def percent(n: Column, total: Column) -> Column:
    return F.round(100.0 * F.try_divide(n.cast("double"), total.cast("double")), 1)


def deal_score(weights: dict[str, float], spread: Column, jv: Column, tier: Column, days: Column, absentee_owner: Column) -> Column:
    """Weighted mean of the terms that are present, in four places; null if none is."""
    terms = {
        "arv_spread_score": (spread.isNotNull() & jv.isNotNull() & (jv != 0), F.greatest(F.least(F.try_divide(spread.cast("double"), jv.cast("double")), F.lit(1.0)), F.lit(0.0))),
        "signal_tier_score": (tier.isNotNull(), F.when(tier == 1, 1.0).when(tier == 2, 0.66).when(tier == 3, 0.33).otherwise(0.0)),
        "dom_score": (days.isNotNull(), 1.0 - F.least(days / F.lit(365.0), F.lit(1.0))),
        "absentee_score": (F.coalesce(absentee_owner, F.lit(False)), F.lit(1.0)),
    }
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, (present, value) in terms.items():
        w = float(weights.get(name) or 0.0)
        if w:
            total = total + F.when(present, w * value).otherwise(0.0)
            weight = weight + F.when(present, w).otherwise(0.0)
    return F.round(F.try_divide(total, weight), 4)


def spread(estimate: Column, price: Column, area: Column, rehab: float) -> Column:
    """Estimate less price less rehabilitation; null without price or area."""
    cost = (area.cast("double") * rehab).cast("long")
    return F.when(price.isNotNull() & (F.coalesce(area, F.lit(0)) != 0), estimate - price - cost)


def listing_financials(estimate: Column, jv: Column, price: Column, area: Column) -> dict[str, Column]:
    """Estimate, price per square foot and spread of a matched listing."""
    value = F.coalesce(F.nullif(estimate, F.lit(0)), jv)
    return {
        "arv_estimate": value,
        "price_per_sqft": F.when((price != 0) & (area > 0), F.round(price / area.cast("double"), 2)),
        "arv_spread": F.when((value != 0) & (price > 0), value - price),
    }
