"""Readers of roll, listing, court and auction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelens.functions.parcel import ROLL_COLUMNS, roll_projection
from acrelens.functions.text import auction_date, listing_facts, whole_dollars
from acrelens.operators.spatial import ring_area
from acrelens.sources.workbook import read_workbooks

# Texts that a roll file's reader takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def roll_path(root: str, county_fips: str, counties: dict[str, str]) -> str:
    """Where a county's roll files lie; an error for a county that isn't registered."""
    if county_fips not in counties:
        raise KeyError(f"no county is registered as {county_fips}")
    return f"{root}/{county_fips}_{counties[county_fips].lower().replace(' ', '_')}/nal/NAL*.csv"


def read_roll(spark: SparkSession, path: str) -> DataFrame:
    """A roll CSV with header, every column text, missing marks as null; no inference pass."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def parcels_of_roll(roll: DataFrame, county_fips: str) -> DataFrame:
    """Typed parcels of a raw roll, with the raw row as JSON; columns that a file lacks are null."""
    wanted = [line.split()[0] for line in ROLL_COLUMNS.split("\n") if line]
    full = roll.select("*", *[F.lit(None).cast("string").alias(c) for c in wanted if c not in roll.columns])
    raw = F.to_json(F.struct(*roll.columns)).alias("raw_nal_json")
    return full.select(*roll_projection(F.lit(county_fips)), raw).filter("parcel_id is not null")


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, split, at, line) of text files; a large file is read in splits, ``at`` orders the lines of each."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.decode(F.col("value").cast("binary"), encoding).alias("line"))
    return rows.withColumn("line", F.regexp_replace("line", "^\ufeff", ""))


def blocks(lines: DataFrame, opens: Column) -> DataFrame:
    """Lines with the number of the block of their file that they stand in; lines before the first are left out.

    Two levels of sums: what all earlier splits of a file open, a row per split, and the
    running sum within a split. A block may so go on over any number of splits, and no
    task holds more than one split's lines.
    """
    marked = lines.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    opened = marked.groupBy("file", "split").agg(F.sum("opens").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked.join(opened, ["file", "split"]).withColumn("block", F.col("before") + F.sum("opens").over(within))
    return rows.filter("block > 0").withColumn("at", F.struct("split", "at")).drop("opens", "before", "split")


def read_key_values(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Records of a two-column file, a column per field, and the lines of the address.

    A line whose key begins with "Auction Starts" begins a record. ``fields`` maps keys
    (lower case, spaces as underscores, # as num, no colon) to columns; the last value of
    a key counts. Records without parcel or case number are left out.
    """
    lines = _lines(spark, path, "ISO-8859-1").filter("trim(line) <> ''")
    key = F.regexp_replace(F.replace(F.replace(F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce("p.k", F.lit("")))), ":+$", "")), F.lit(" "), F.lit("_")), F.lit("#"), F.lit("num")), "_+", "_")
    keyed = lines.withColumn("p", F.from_csv("line", F.lit("k string, v string"))).select("file", "split", "at", key.alias("key"), F.nullif(F.trim("p.v"), F.lit("")).alias("value"))
    grouped = blocks(keyed, F.regexp_replace("key", "[^a-z]", "").startswith("auctionstarts")).groupBy("file", "block")
    columns: dict[str, list[str]] = {}
    for k, c in fields.items():
        columns.setdefault(c, []).append(k)
    address = F.col("key").isin("address", "property_address", "") & F.col("value").isNotNull()
    values = [F.max_by("value", F.when(F.col("key").isin(*ks) & F.col("value").isNotNull(), F.col("at"))).alias(c) for c, ks in columns.items()]
    rows = grouped.agg(*values, F.array_sort(F.collect_list(F.when(address, F.struct("at", "value")))).alias("_address"))  # lines of one record
    at = lambda i: F.try_element_at("_address", F.lit(i))["value"]
    rows = rows.withColumns({"street": at(1), "city_state_zip": at(2), "auction_date": auction_date(F.regexp_extract("auction_starts", r"(\d{1,2}/\d{1,2}/\d{4})", 1))})
    return rows.drop("_address").filter("parcel_id is not null and case_number is not null")


# Keys of foreclosure and tax deed files and their columns.
_COMMON = {"auction_starts": "auction_starts", "case_num": "case_number", "parcel_id": "parcel_id", "assessed_value": "assessed_value"}
FORECLOSURE = _COMMON | {"case_number": "case_number", "final_judgment_amount": "judgment", "plaintiff_max_bid": "plaintiff_max_bid"}
TAX_DEED = _COMMON | {"certificate_num": "certificate_number", "opening_bid": "opening_bid"}


def read_foreclosures(spark: SparkSession, path: str) -> DataFrame:
    rows = read_key_values(spark, path, FORECLOSURE)
    return rows.withColumns({c: whole_dollars(F.col(c)) for c in ("judgment", "assessed_value", "plaintiff_max_bid")})


def read_tax_deeds(spark: SparkSession, path: str) -> DataFrame:
    rows = read_key_values(spark, path, TAX_DEED)
    return rows.withColumns({c: whole_dollars(F.col(c)) for c in ("opening_bid", "assessed_value")})


# Lines of a saved listing page that tell nothing.
NOISE = r"(?i)^(More|Save|Previous photoNext photo|Save this search.*|.*to get email alerts.*)$"


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings of a file with one value per line: a price line opens one; then specs, address, brokerage."""
    lines = _lines(spark, path, "UTF-8").select("file", "split", "at", F.trim(F.regexp_replace("line", '^"+|"+$', "")).alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike(NOISE))
    parts = blocks(lines, F.col("line").rlike(r"^\$[\d,]+(\.\d{2})?$")).groupBy("file", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("l"))  # lines of one listing
    specs_at = F.array_position(F.transform("l", lambda x: x.rlike(r"(?i)\d+\s*bds?|[\d,]+\s*sqft")), F.lit(True)).cast("int")
    after = lambda at: F.slice("l", at + 1, F.size("l"))
    is_address = lambda x: x.rlike(r"(?i),\s*FL\s+\d{5}$")
    rest = F.when(specs_at > 0, after(specs_at)).otherwise(F.array().cast("array<string>"))
    address = F.try_element_at(F.filter(rest, is_address), F.lit(1))
    at = F.array_position(rest, address).cast("int")
    agency = F.try_element_at(F.filter(F.when(at > 0, F.slice(rest, at + 1, F.size(rest))), lambda x: ~is_address(x)), F.lit(1))
    facts = listing_facts(F.col("l")[0], F.when(specs_at > 0, F.element_at("l", specs_at)), address)
    return parts.select("file", "block", *[c.alias(n) for n, c in facts.items()], address.alias("address"), agency.alias("brokerage"))


def read_auctions(spark: SparkSession, path: str, county: str = "ESCAMBIA", state: str = "FL") -> DataFrame:
    """Assets of auction JSON files in one county; zero stands for unknown."""
    schema = "id string, address struct<street:string, city:string, county:string, state:string, zip:string>, bid long, value long, asset_type string, auction_at string"
    rows = spark.read.schema(schema).json(path).filter((F.upper("address.state") == state) & (F.upper("address.county") == county))
    kinds = F.create_map(*[F.lit(x) for kv in {"FORECLOSURE": "foreclosure", "REO": "reo", "SHORT_SALE": "short_sale"}.items() for x in kv])
    return rows.select("id", "address.*", F.nullif("bid", F.lit(0)).alias("bid"), F.nullif("value", F.lit(0)).alias("value"), F.coalesce(F.try_element_at(kinds, F.upper("asset_type")), F.lit("auction")).alias("signal_type"), F.substring("auction_at", 1, 10).try_cast("date").alias("auction_date"))


def read_court_records(spark: SparkSession, path: str) -> DataFrame:
    """Lis pendens rows exported as CSV or as workbooks, a file in a task."""
    if path.endswith(".xlsx"):
        rows = read_workbooks(spark, path)
    else:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    return rows.filter(F.upper(F.trim("`Doc Type`")).contains("LIS PENDENS") & (F.trim(F.coalesce("Status", F.lit(""))) != ""))


def read_polygons(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(name, ring, holes, area) of GeoJSON polygons; rings are array<struct<lon,lat>>.

    A feature of several parts gives a row for each, with the area of the whole, holes
    taken off. With ``lines`` a file holds a feature per line and can be read in splits.
    """
    feature = "properties map<string, string>, geometry struct<type: string, coordinates: string>"
    if lines:
        features = spark.read.schema(feature).json(path)
    else:
        whole = f"features array<struct<{feature.replace('properties map', 'properties: map').replace('geometry struct', 'geometry: struct')}>>"
        features = spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    single = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    several = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("geometry.type") == "Polygon", F.array(single)).when(F.col("geometry.type") == "MultiPolygon", several)
    rings = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))
    rows = features.select(F.coalesce(*[F.col("properties")[k] for k in ("ZCTA5CE20", "NAME", "name")]).alias("name"), rings.alias("parts")).filter("parts is not null")
    covered = lambda part: ring_area(part[0]) - F.aggregate(F.slice(part, F.lit(2), F.size(part)), F.lit(0.0), lambda a, hole: a + ring_area(hole))
    rows = rows.withColumn("area", F.aggregate("parts", F.lit(0.0), lambda a, part: a + covered(part)))
    return rows.select("name", "area", F.explode("parts").alias("part")).select("name", F.col("part")[0].alias("ring"), F.slice("part", F.lit(2), F.size("part")).alias("holes"), "area")
