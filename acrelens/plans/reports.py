"""Data quality reports over parcels and sales; each is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.functions.parcel import bucket, percent
from acrelens.operators.quantile import FEW, exact_quantiles
from acrelens.scratch import materialize

_ID = ["county_fips", "parcel_id"]
RATE_FIELDS = ["exterior_wall", "roof_type", "foundation_type", "tot_lvg_area", "act_yr_blt", "eff_yr_blt", "bedrooms", "bathrooms"]
ERAS = [(1950, "pre-1950"), (1970, "1950-1969"), (1990, "1970-1989"), (2010, "1990-2009")]
SIZES = [(500, "<500"), (1000, "500-999"), (1500, "1000-1499"), (2000, "1500-1999"), (3000, "2000-2999"), (5000, "3000-4999")]


def homes(parcels: DataFrame, enriched: bool = True) -> DataFrame:
    """Single-family parcels, those that have been enriched unless all are asked for."""
    rows = parcels.filter("dor_uc = '001'")
    return rows.filter("enriched_on is not null") if enriched else rows


def progress(parcels: DataFrame) -> DataFrame:
    """Enriched and remaining homes per county, with the share done."""
    out = homes(parcels, enriched=False).groupBy("county_fips").agg(
        F.count(F.lit(1)).alias("total"), F.count("enriched_on").alias("enriched"), F.count_if(F.col("enriched_on").isNull()).alias("remaining"), F.min("enriched_on").alias("first_on"), F.max("enriched_on").alias("last_on")
    )
    return out.withColumn("percent_done", percent(F.col("enriched"), F.col("total")))


def population_rates(parcels: DataFrame, counties: tuple[str, str] = ("12033", "12113"), parity: float = 5.0) -> DataFrame:
    """Share of enriched homes with each field in two counties, and whether they are within ``parity`` points."""
    rows = homes(parcels).groupBy("county_fips").agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in RATE_FIELDS])
    long = rows.select("county_fips", "total", F.explode(F.create_map(*[x for c in RATE_FIELDS for x in (F.lit(c), F.col(c))])).alias("field", "n"))
    a, b = counties
    side = lambda fips, c: F.max(F.when(F.col("county_fips") == fips, F.col(c)))
    wide = long.groupBy("field").agg(side(a, "n").alias("n_a"), side(a, "total").alias("total_a"), side(b, "n").alias("n_b"), side(b, "total").alias("total_b"))
    wide = wide.select("field", percent(F.col("n_a"), F.col("total_a")).alias("rate_a"), percent(F.col("n_b"), F.col("total_b")).alias("rate_b"))
    return wide.withColumn("parity", F.abs(F.col("rate_a") - F.col("rate_b")) <= parity)


def histogram(parcels: DataFrame, column: str, bounds: list, last: str) -> DataFrame:
    """Homes per bucket, counties side by side."""
    rows = homes(parcels).withColumn("bucket", bucket(F.col(column), bounds, last))
    return rows.groupBy("bucket").agg(F.count_if(F.col("county_fips") == "12033").alias("county_12033"), F.count_if(F.col("county_fips") == "12113").alias("county_12113"))


def area_statistics(parcels: DataFrame) -> DataFrame:
    area = F.col("tot_lvg_area")
    return homes(parcels).groupBy("county_fips").agg(F.round(F.avg(area), 4).alias("average"), F.min(area).alias("least"), F.max(area).alias("most"), F.median(area).alias("median"))


def top_codes(parcels: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The commonest codes of all homes, ties in order of the code."""
    return homes(parcels).filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("code")).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "code").limit(n)


def pivoted(parcels: DataFrame, column: str, counties: tuple[str, ...] = ("12033", "12113")) -> DataFrame:
    out = homes(parcels).groupBy(F.coalesce(column, F.lit("NULL")).alias("code")).pivot("county_fips", list(counties)).count()
    return out.select("code", *[F.coalesce(c, F.lit(0)).alias(f"county_{c}") for c in counties])


def remodel_gap(parcels: DataFrame, major: int = 10) -> DataFrame:
    """How often and how far the effective year is after the built year."""
    gap = F.col("eff_yr_blt") - F.col("act_yr_blt")
    return homes(parcels).groupBy("county_fips").agg(
        F.count(F.lit(1)).alias("enriched"), F.count_if(gap > 0).alias("remodelled"), F.count_if(gap > major).alias("major"), F.round(F.avg(F.when(gap > 0, gap)), 1).alias("average_gap")
    )


def sale_coverage(parcels: DataFrame, sales: DataFrame) -> DataFrame:
    """Homes with sales, sales per home and per home with any."""
    joined = homes(parcels).select(*_ID).join(sales.select(*_ID, "id", "sale_date"), _ID, "left")
    out = joined.groupBy("county_fips").agg(F.countDistinct("parcel_id").alias("homes"), F.countDistinct(F.when(F.col("id").isNotNull(), F.col("parcel_id"))).alias("sold"), F.count("id").alias("sales"), F.count("sale_date").alias("dated"))
    return out.withColumn("per_sold", F.round(F.try_divide(F.col("sales").cast("double"), F.col("sold").cast("double")), 4)).withColumn("coverage", percent(F.col("sold"), F.col("homes")))


def first_of_month(sales: DataFrame) -> DataFrame:
    return sales.filter("sale_date is not null").groupBy("county_fips").agg(F.count(F.lit(1)).alias("dated"), F.count_if(F.day("sale_date") == 1).alias("on_first"))


def sales_per_home(parcels: DataFrame, sales: DataFrame) -> DataFrame:
    """Homes by how many sales they have."""
    per = homes(parcels).select(*_ID).join(sales.groupBy(*_ID).agg(F.count(F.lit(1)).alias("n")), _ID, "left")
    label = F.when(F.col("n").isNull(), "0 (no history)").when(F.col("n") == 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 6, "4-6").otherwise("7+")
    return per.groupBy("county_fips", label.alias("bucket")).agg(F.count(F.lit(1)).alias("homes"))


_DEED = "(instrument_type = 'WD' or sale_type = 'WD')"


def price_per_sqft(parcels: DataFrame, sales: DataFrame, least: int = 10_000) -> DataFrame:
    """Price per square foot of homes' warranty deed sales above a price: mean, median and range.

    Nearly all prices differ, so the median is found by counting passes; that of living
    areas (``area_statistics``) is left to the built-in one, whose buffer holds a few thousand
    distinct numbers whatever the number of homes.
    """
    joined = sales.filter(_DEED).filter(F.col("sale_price") > least).join(homes(parcels).select(*_ID, "tot_lvg_area"), _ID)
    each = F.when(F.col("tot_lvg_area") > 0, F.col("sale_price") / F.col("tot_lvg_area").cast("double"))
    priced = materialize(joined.select("county_fips", each.alias("each")), "prices")
    facts = {"average": F.avg("each"), "least": F.min("each"), "most": F.max("each")}
    out = priced.groupBy("county_fips").agg(F.count(F.lit(1)).alias("deed_sales"), F.count("each").alias("priced"), *[F.round(c, 2).alias(n) for n, c in facts.items()])
    return out.join(exact_quantiles(priced, ["county_fips"], F.col("each")).select("county_fips", F.round("quantile", 2).alias("median")), "county_fips")


def price_quartiles(sales: DataFrame, group: Column, few: int = FEW) -> DataFrame:
    """Sales with a price by group, and the quartiles of their prices."""
    names = {"lower": 0.25, "median": 0.5, "upper": 0.75}
    found = exact_quantiles(sales.select(group.alias("group"), "sale_price"), ["group"], F.col("sale_price"), tuple(names.values()), few)
    return found.groupBy("group", "n").agg(*[F.round(F.max(F.when(F.col("share") == share, F.col("quantile"))), 4).alias(name) for name, share in names.items()])


def suspicious(parcels: DataFrame, sales: DataFrame, tiny: int = 100, latest: int = 2026, earliest: int = 1800, token: int = 500) -> DataFrame:
    """Flags over homes joined with their sales; rows are counted, not homes."""
    joined = homes(parcels).select(*_ID, "tot_lvg_area", "act_yr_blt").join(sales.select(*_ID, "sale_price", "sale_type", "instrument_type"), _ID, "left")
    return joined.groupBy("county_fips").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("tot_lvg_area") < tiny).alias("tiny_area"), F.count_if(F.col("act_yr_blt") > latest).alias("future_year"),
        F.count_if(F.col("act_yr_blt") < earliest).alias("ancient_year"), F.count_if((F.col("sale_price") > 0) & (F.col("sale_price") < token) & F.expr(_DEED)).alias("token_deed"),
    )


def code_distribution(sales: DataFrame) -> DataFrame:
    """Sales by qualification and instrument, with the mean price."""
    return sales.groupBy(F.coalesce("qualification_code", F.lit("NULL")).alias("code"), "instrument_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sale_price"), 2).alias("mean_price"))


def source_tags(signals: DataFrame) -> DataFrame:
    """Signals by source, how many have a raw document, and how many an empty one."""
    return signals.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("raw_json").alias("with_json"), F.count_if(F.col("raw_json") == "{}").alias("empty_json"), F.max(F.get_json_object("raw_json", "$.k").try_cast("long")).alias("top_k"))
