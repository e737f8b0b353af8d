"""Search criteria as predicates, and their explaining twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.functions.parcel import absentee_or_not, filter_int, non_empty

# Criterion, parcel column, kind (range, exact: equality or range, max, in).
DIMENSIONS = """
just_value jv range
list_price list_price range
year_built act_yr_blt range
effective_year_built eff_yr_blt range
living_area_sqft tot_lvg_area range
lot_sqft lnd_sqfoot range
bedrooms bedrooms exact
bathrooms bathrooms exact
imp_qual imp_qual range
num_buildings no_buldng max
num_residential_units no_res_unts max
assessed_value av_nsd range
land_value lnd_val range
nav_total_assessment nav_total_assessment max
special_feature_value spec_feat_val max
years_since_last_sale years_since_last_sale range
soh_compression_ratio soh_compression_ratio range
improvement_to_land_ratio improvement_to_land_ratio range
zip_codes phy_zipcd in
mkt_ar_codes mkt_ar in
nbrhd_codes nbrhd_cd in
census_block_groups census_bk in
ext_wall_codes exterior_wall in
foundation_codes foundation_type in
prior_sale_qualification qual_cd1 in
"""
_TABLE = {line.split()[0]: tuple(line.split()[1:]) for line in DIMENSIONS.split("\n") if line}


def _bounds(c: Column, spec: dict, low: bool = True) -> list[Column]:
    out = [c >= spec["min"]] if low and spec.get("min") is not None else []
    return out + ([c <= spec["max"]] if spec.get("max") is not None else [])


def predicates(criteria: dict) -> list[Column]:
    """Parcel predicates of a criteria document; dimensions that are absent or unset don't constrain, null never passes a range."""
    filters = criteria.get("filters") or {}
    out: list[Column] = []
    for name, (column, kind) in _TABLE.items():
        spec, c = filters.get(name) or {}, F.col(column)
        if kind == "in":
            out += [c.isin(list(spec["include"]))] if spec.get("include") else []
        elif kind == "exact" and spec.get("exact") is not None:
            out.append(c == spec["exact"])
        else:
            out += _bounds(c, spec, low=kind != "max")
    get = lambda name: filters.get(name) or {}
    ratio = _bounds(F.try_divide(F.col("list_price").cast("double"), F.col("jv").cast("double")), get("list_price_to_jv_ratio"))
    if ratio:
        out += [F.col("list_price").isNotNull() & F.col("jv").isNotNull() & (F.col("jv") > 0), *ratio]
    if get("absentee_owner").get("required") is not None:
        out.append(F.col("absentee_owner") == bool(get("absentee_owner")["required"]))
    if get("homestead_status").get("required") is not None:
        homestead = F.col("exmpt_01")
        out.append(homestead > 0 if get("homestead_status")["required"] else homestead.isNull() | (homestead == 0))
    if get("owner_state_dom").get("exclude"):
        out.append(~F.col("own_state_dom").isin(list(get("owner_state_dom")["exclude"])))
    if get("dor_use_code").get("include"):
        out.append(F.col("dor_uc").isin([str(x).zfill(3) for x in get("dor_use_code")["include"]]))
    if get("par_split_recent").get("required"):
        out.append(F.col("par_splt").isNotNull() & (F.col("par_splt") != ""))
    if get("min_arv_spread").get("value") is not None:
        out.append(F.col("arv_spread") >= get("min_arv_spread")["value"])
    return out


def event_predicates(criteria: dict) -> list[Column]:
    """Predicates on a parcel's latest event; a parcel without event fails those that are set."""
    filters = criteria.get("filters") or {}
    out: list[Column] = []
    if (filters.get("listing_types") or {}).get("include"):
        out.append(F.col("listing_type").isin(list(filters["listing_types"]["include"])))
    return out + _bounds(F.col("days_on_market"), filters.get("days_on_market") or {})


def score_predicates(criteria: dict) -> list[Column]:
    least = ((criteria.get("filters") or {}).get("min_deal_score") or {}).get("value")
    return [] if least is None else [F.col("deal_score") >= least]


def matching(parcels: DataFrame, conditions: list[Column]) -> DataFrame:
    return parcels.filter(reduce(lambda a, b: a & b, conditions)) if conditions else parcels


def rejection_reasons(criteria: dict) -> Column:
    """Array of the reasons why a raw roll row fails; empty if it passes. An empty list of allowed values rejects all."""
    filters = criteria.get("filters") or {}
    get = lambda name: filters.get(name) or {}
    whys: list[Column] = []

    def listed(name: str, value: Column, reason: str) -> None:
        allowed = get(name).get("include")
        if allowed is not None:
            ok = value.isin(list(allowed)) if len(allowed) else F.lit(False)
            whys.append(F.when(~F.coalesce(ok, F.lit(False)), reason))

    def ranged(name: str, column: str, missing: str | None, low: str | None, high: str) -> None:
        spec, value = get(name), filter_int(F.col(column))
        floor = spec.get("min") if low else None
        if floor is None and spec.get("max") is None:
            return
        if missing:
            whys.append(F.when(value.isNull(), missing))
        if floor is not None:
            whys.append(F.when(value < floor, low))
        if spec.get("max") is not None:
            whys.append(F.when(value > spec["max"], high))

    listed("dor_use_code", filter_int(F.col("DOR_UC")), "dor_uc_mismatch")
    ranged("year_built", "ACT_YR_BLT", "year_built_missing", "year_built_too_old", "year_built_too_new")
    ranged("imp_qual", "IMP_QUAL", None, "imp_qual_too_low", "imp_qual_too_high")
    ranged("living_area_sqft", "TOT_LVG_AREA", "living_area_missing", "living_area_too_small", "living_area_too_large")
    ranged("just_value", "JV", "just_value_missing", "just_value_too_low", "just_value_too_high")
    ranged("num_buildings", "NO_BULDNG", None, None, "num_buildings_exceeded")
    ranged("num_residential_units", "NO_RES_UNTS", None, None, "num_res_units_exceeded")
    listed("county_nos", filter_int(F.col("CO_NO")), "county_no_mismatch")
    listed("zip_codes", non_empty(F.col("PHY_ZIPCD")), "zip_code_excluded")
    wanted = get("absentee_owner").get("required")
    if wanted is not None:
        away = absentee_or_not(F.col("OWN_STATE"), F.col("OWN_ADDR2"), F.col("PHY_ADDR1"))
        whys.append(F.when(~away, "absentee_owner_required") if wanted else F.when(away, "owner_occupied_required"))
    if get("disaster_code_present").get("required") is False:
        whys.append(F.when(filter_int(F.col("DISTR_CD")).isNotNull(), "disaster_code_present"))
    return F.array_compact(F.array(*whys)) if whys else F.array().cast("array<string>")


def visible_to(rows: DataFrame, granted: list[str], superuser: bool = False) -> DataFrame:
    """Rows of the counties that a user may see."""
    return rows if superuser else rows.filter(F.col("county_fips").isin(list(granted)) if granted else F.lit(False))


def fully_granted(profiles: DataFrame, granted: list[str]) -> DataFrame:
    """Profiles all of whose counties a user may see."""
    allowed = F.array(*map(F.lit, granted)).cast("array<string>")
    return profiles.filter(F.forall("county_fips", lambda c: F.array_contains(allowed, c)))


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(F.col("expires_at") > now)


def events_where(events: DataFrame, status: str | None = None, tier: int | None = None, kind: str | None = None) -> DataFrame:
    """Events with the given facts, newest first."""
    for column, value in (("workflow_status", status), ("signal_tier", tier), ("signal_type", kind)):
        events = events if value is None else events.filter(F.col(column) == value)
    return events.orderBy(F.desc("created_at"), F.desc("id"))
