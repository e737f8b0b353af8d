"""After-repair value from comparable sales, for all parcels in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelens.functions.parcel import spread
from acrelens.operators.spatial import MILE_M, within_radius
from acrelens.scratch import materialize


@dataclass(frozen=True)
class Settings:
    radius_miles: float = 1.5
    min_comps: int = 3
    year_tolerance: int = 10
    rehab_per_sqft: float = 35.0
    min_pool: int = 1000
    min_price: int = 10_000
    #: Comparables that a cell of the radius join may hold before it is cut.
    cell_rows: int = 4096


_ID = ["county_fips", "parcel_id"]


def viable_counties(sales: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counties with enough qualified sales for a spatial search."""
    qualified = F.col("qualification_code").isin("Q", "C") | (F.col("qualification_code").isNull() & (F.col("instrument_type") == "WD"))
    pool = sales.filter(qualified & (F.col("sale_price") >= settings.min_price)).groupBy("county_fips").agg(F.count(F.lit(1)).alias("pool"))
    return pool.withColumn("viable", F.col("pool") >= settings.min_pool)


def _summary(pairs: DataFrame, passes: dict[str, Column], price: str) -> DataFrame:
    """Per subject and pass: number of comparables and median price per square foot of those with an area."""
    each = F.when((F.col("r.tot_lvg_area") > 0) & (F.col(f"r.{price}") != 0), F.col(f"r.{price}") / F.col("r.tot_lvg_area").cast("double"))
    columns = []
    for name, test in passes.items():
        columns += [F.count_if(test).alias(f"n_{name}"), F.median(F.when(test, each)).alias(f"ppsf_{name}")]
    return pairs.groupBy("l.county_fips", "l.parcel_id").agg(*columns)


_SPOT = ["county_fips", "dor_uc", "eff_yr_blt", "lat", "lon"]


def _near_by(subjects: DataFrame, comps: DataFrame, passes: dict[str, Column], price: str, settings: Settings) -> DataFrame:
    """``_summary`` of the pairs of subjects and comparables, without making them.

    Subjects of one spot and year (a class) have the same comparables but for their own, so a
    class ranks its comparables once, and a subject's median is found by its place among
    the ranks that are not the subject's own. A key that stands several times among subjects
    goes by its pairs. ``passes`` speak of r.*.
    """
    radius = settings.radius_miles * MILE_M
    years = f"abs(l.eff_yr_blt - r.eff_yr_blt) <= {settings.year_tolerance}"
    told = " and ".join(f"{c} is not null" for c in ["parcel_id", *_SPOT])
    # Zeros of either sign are one place.
    plain = lambda df: df.filter(told).withColumns({c: F.col(c) + F.lit(0.0) for c in ("lat", "lon")})
    subjects, comps = plain(subjects), plain(comps)
    subjects, comps = materialize(subjects, "subjects"), materialize(comps, "comparables")
    repeated = subjects.groupBy(*_ID).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*_ID)
    alone = subjects.join(repeated, _ID, "left_anti")

    classes = materialize(alone.select(*_SPOT).distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    met = within_radius(classes, comps.select(*_SPOT).distinct(), ["county_fips", "dor_uc"], radius, years, settings.cell_rows)
    met = materialize(met.select("l.class", *[F.col(f"r.{c}").alias(c) for c in _SPOT]), "met")
    each = F.when((F.col("r.tot_lvg_area") > 0) & (F.col(f"r.{price}") != 0), F.col(f"r.{price}") / F.col("r.tot_lvg_area").cast("double"))
    rows = comps.select(*_SPOT, "parcel_id", F.struct("*").alias("r")).withColumns({"value": each} | {f"in_{p}": test for p, test in passes.items()}).drop("r")
    rows = met.join(rows, _SPOT).select("class", "parcel_id", "value", *[f"in_{p}" for p in passes])
    up = Window.partitionBy("class").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    priced = lambda p: F.col(f"in_{p}") & F.col("value").isNotNull()
    ranked = materialize(rows.withColumns({f"at_{p}": F.count_if(priced(p)).over(up) for p in passes}), "ranked")

    sizes = ranked.groupBy("class").agg(*[F.count_if(f"in_{p}").alias(f"all_{p}") for p in passes], *[F.count_if(priced(p)).alias(f"priced_{p}") for p in passes])
    of = alone.join(classes, _SPOT).select(*_ID, "class")
    own = ranked.join(of.select("class", "parcel_id"), ["class", "parcel_id"]).groupBy("class", "parcel_id")
    own = own.agg(*[F.count_if(f"in_{p}").alias(f"own_{p}") for p in passes], *[F.sort_array(F.collect_list(F.when(priced(p), F.col(f"at_{p}")))).alias(f"ranks_{p}") for p in passes])  # sales of one parcel
    asked = of.join(sizes, "class").join(own, ["class", "parcel_id"], "left")
    for p in passes:
        ranks = F.coalesce(f"ranks_{p}", F.array().cast("array<bigint>"))
        left = F.col(f"priced_{p}") - F.size(ranks)
        place = lambda j, ranks=ranks: F.aggregate(ranks, j.cast("long"), lambda a, r: F.when(r <= a, a + 1).otherwise(a))
        asked = asked.withColumns({f"n_{p}": F.col(f"all_{p}") - F.coalesce(f"own_{p}", F.lit(0)), f"low_{p}": F.when(left > 0, place(F.floor((left + 1) / 2))), f"high_{p}": F.when(left > 0, place(F.floor(left / 2) + 1))})
    asked = materialize(asked, "asked")
    for p in passes:
        found = ranked.filter(priced(p))
        for end in ("low", "high"):
            asked = asked.join(found.select("class", F.col(f"at_{p}").alias(f"{end}_{p}"), F.col("value").alias(f"{end}_value_{p}")), ["class", f"{end}_{p}"], "left")
    middle = lambda p: F.when(F.col(f"low_{p}") == F.col(f"high_{p}"), F.col(f"low_value_{p}")).otherwise(0.5 * F.col(f"low_value_{p}") + 0.5 * F.col(f"high_value_{p}"))
    out = asked.select(*_ID, *[c for p in passes for c in (F.col(f"n_{p}"), middle(p).alias(f"ppsf_{p}"))])
    out = materialize(out, "summary")
    if repeated.isEmpty():
        return out
    again = within_radius(subjects.join(repeated, _ID, "left_semi"), comps, ["county_fips", "dor_uc"], radius, years + " and l.parcel_id <> r.parcel_id", settings.cell_rows)
    return out.unionByName(_summary(again, passes, price))


def valuation(parcels: DataFrame, sales: DataFrame, settings: Settings = Settings(), resume: bool = False) -> DataFrame:
    """Estimate, its source, comparables used, value per square foot and spread of every parcel with a just value.

    Qualified sales nearby come first, then unqualified ones too, then neighbours' own
    last sale; a parcel that none of them values keeps its just value. Spots and years of
    subjects and comparables meet once per kind of sale in grid cells, and every subject is one
    row of ``_near_by``, so no parcel costs a query of its own. Cells where comparables
    stand close are cut until none holds more than ``cell_rows``.
    """
    eligible = parcels.filter("jv is not null")
    if resume:
        eligible = eligible.filter("arv_estimate is null")
    subjects = eligible.filter("tot_lvg_area > 0 and eff_yr_blt is not null and dor_uc is not null").select(*_ID, "dor_uc", "eff_yr_blt", "lat", "lon")
    located = parcels.filter("eff_yr_blt is not null and dor_uc is not null")

    priced = sales.filter(F.col("sale_price") >= settings.min_price).select(*_ID, "sale_price", "qualification_code", "instrument_type")
    priced = priced.filter("qualification_code in ('Q', 'C', 'U') or (qualification_code is null and instrument_type = 'WD')")
    comps = priced.join(located.select(*_ID, "dor_uc", "eff_yr_blt", "tot_lvg_area", "lat", "lon"), _ID)
    in_pool = subjects.join(viable_counties(sales, settings).filter("viable").select("county_fips"), "county_fips", "left_semi")
    strict = F.coalesce(F.col("r.qualification_code") != "U", F.lit(True))
    sold = _near_by(in_pool, comps, {"strict": strict, "wide": F.lit(True)}, "sale_price", settings)

    enough = lambda p: (F.col(f"n_{p}") >= settings.min_comps) & F.col(f"ppsf_{p}").isNotNull()
    settled = sold.filter(enough("strict") | enough("wide")).select(*_ID)
    own = located.filter(f"qual_cd1 = '01' and sale_prc1 >= {settings.min_price} and tot_lvg_area > 0").select(*_ID, "dor_uc", "eff_yr_blt", "tot_lvg_area", "sale_prc1", "lat", "lon")
    roll = _near_by(subjects.join(settled, _ID, "left_anti"), own, {"roll": F.lit(True)}, "sale_prc1", settings)

    chosen = F.when(enough("strict"), F.struct(F.lit("COMP").alias("source"), F.col("n_strict").alias("n"), F.col("ppsf_strict").alias("ppsf")))
    chosen = chosen.when(enough("wide"), F.struct(F.lit("COMP_WIDE").alias("source"), F.col("n_wide").alias("n"), F.col("ppsf_wide").alias("ppsf")))
    chosen = chosen.when(enough("roll"), F.struct(F.lit("NAL_COMP").alias("source"), F.col("n_roll").alias("n"), F.col("ppsf_roll").alias("ppsf")))
    joined = eligible.select(*_ID, "jv", "list_price", "tot_lvg_area").join(sold, _ID, "left").join(roll, _ID, "left").withColumn("c", chosen)
    estimate = F.coalesce(F.floor(F.col("c.ppsf") * F.col("tot_lvg_area") + 0.5).cast("long"), F.col("jv"))
    return joined.withColumn("arv_estimate", estimate).select(
        *_ID,
        "arv_estimate",
        F.coalesce("c.source", F.lit("JV_FALLBACK")).alias("arv_source"),
        F.coalesce("c.n", F.lit(0)).cast("long").alias("comps"),
        F.when(F.col("tot_lvg_area") > 0, F.round(F.col("jv") / F.col("tot_lvg_area").cast("double"), 6)).alias("jv_per_sqft"),
        spread(F.col("arv_estimate"), F.col("list_price"), F.col("tot_lvg_area"), settings.rehab_per_sqft).alias("arv_spread"),
    )
