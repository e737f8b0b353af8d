"""Text, address, money and date parsing as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street suffixes and their postal abbreviations, compass words.
SUFFIXES = {
    "ROAD": "RD", "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR",
    "COURT": "CT", "PLACE": "PL", "LANE": "LN", "CIRCLE": "CIR", "TRAIL": "TRL",
    "TERRACE": "TER", "HIGHWAY": "HWY", "PARKWAY": "PKWY", "EXPRESSWAY": "EXPY", "FREEWAY": "FWY",
}
COMPASS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
# How a unit is written. The first is stripped from an address and wants white space behind a unit
# word; the second splits the end off an address that kept its unit, and takes a unit right behind APT or STE, too.
UNIT = r"(?:\b(?:APT\.?|UNIT|STE|SUITE)\s+[\w-]+|#\s*[\w-]+)"
UNIT_AT_END = r"^(.*?)\s*(?:#|APT\.?\s*|UNIT\s+|STE\.?\s*|SUITE\s+)([A-Z0-9][\w-]*)\s*$"


def squeezed(c: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    return squeezed(F.coalesce(c, F.lit("")))


def keyword_text(*parts: Column) -> Column:
    return F.lower(clean_text(F.concat_ws(" ", *parts)))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(clean_text(v), F.lit("")) for v in values], F.lit(""))


def non_empty(c: Column, most: int | None = None) -> Column:
    """Trimmed text, null if empty, cut to ``most`` characters."""
    text = F.nullif(F.trim(c), F.lit(""))
    return text if most is None else F.substring(text, 1, most)


def money(c: Column) -> Column:
    """Price text as double: dollar signs and commas go; null if the rest is no number."""
    return F.trim(F.regexp_replace(c, r"[\$,]", "")).try_cast("double")


def number(c: Column) -> Column:
    """Digits and points of a text as double."""
    return F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")


def whole_dollars(c: Column) -> Column:
    return F.floor(number(c)).cast("long")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("long")


def parcel_key(c: Column) -> Column:
    """Parcel id for joins: upper case letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def padded_parcel_id(c: Column, width: int = 18) -> Column:
    key = parcel_key(c)
    return F.when(F.length(key) < width, F.lpad(key, width, "0")).otherwise(key)


def spaced_digits(c: Column) -> Column:
    """A space between a digit and a letter after it, but for ordinal endings."""
    return F.regexp_replace(c, r"(\d)(?!(?:ST|ND|RD|TH)\b)([A-Z])", "$1 $2")


def street_address(c: Column, strip_unit: bool = True) -> Column:
    """Street address in the roll's spelling; empty for null.

    With ``strip_unit`` false the unit stays and only what stands before it is spaced.
    """
    text = squeezed(F.upper(F.coalesce(c, F.lit(""))))
    if strip_unit:
        text = spaced_digits(squeezed(F.regexp_replace(text, UNIT, "")))
    else:
        head = F.regexp_extract(text, rf"^(.*?)(?:{UNIT}.*)?$", 1)
        text = F.concat(spaced_digits(head), F.substring(text, F.length(head) + 1, F.length(text)))
    text = squeezed(text)
    text = squeezed(reduce(lambda t, kv: F.regexp_replace(t, rf"\b{kv[0]}\b", kv[1]), SUFFIXES.items(), text))
    another = "|".join(COMPASS)
    text = reduce(lambda t, kv: F.regexp_replace(t, rf"^(\d+\s+){kv[0]}\s+(?!(?:{another})\b)", f"$1{kv[1]} "), COMPASS.items(), text)
    return squeezed(text)


def address_order(c: Column, descending: bool = False) -> Column:
    """Struct that sorts addresses by street, suffix, compass word, house number and text; nulls last either way."""
    text = F.upper(F.trim(c))
    house = F.regexp_extract(text, r"^(\d+)\s+(.*)", 1)
    tokens = F.filter(F.split(F.trim(F.regexp_extract(text, r"^(\d+)\s+(.*)", 2)), r"\s+"), lambda t: t != "")
    words = [*COMPASS.values(), *COMPASS]
    led = (F.size(tokens) > 1) & F.element_at(tokens, 1).isin(words)
    rest = F.when(led, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(1)))).otherwise(tokens)
    long = F.size(rest) > 1
    name = F.when(long, F.array_join(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(1))), " ")).otherwise(F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("")))

    def key(name, suffix, before, number_, raw):
        return F.struct(name.alias("street"), suffix.alias("suffix"), before.alias("compass"), number_.alias("house"), raw.alias("text"))

    empty = F.lit("")
    missing = key(F.lit("" if descending else "~"), empty, empty, F.lit(999_999_999).cast("long"), empty)
    plain = key(text, empty, empty, F.lit(0).cast("long"), text)
    full = key(name, F.when(long, F.element_at(rest, -1)).otherwise(""), F.when(led, F.element_at(tokens, 1)).otherwise(""), house.try_cast("long"), text)
    return F.when(F.coalesce(c, F.lit("")) == "", missing).when(house == "", plain).otherwise(full)


def street_name(c: Column) -> Column:
    """Upper-case address without its house number."""
    return F.regexp_replace(F.upper(F.trim(c)), r"^\d+\s*", "")


def sale_date(c: Column) -> Column:
    """Month/day/year, else month/year as the first of the month, else null."""
    text = F.trim(c)
    return F.coalesce(F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "M/yyyy"))


def auction_date(c: Column) -> Column:
    text = F.trim(c)
    return F.coalesce(*[F.try_to_date(text, f) for f in ("MMM d yyyy", "MMM d, yyyy", "M/d/yyyy")])


def listing_facts(price: Column, specs: Column, address: Column) -> dict[str, Column]:
    """Fields of a listing's price, specs and address lines."""
    found = lambda c, p, kind: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast(kind)
    return {
        "list_price": F.regexp_replace(F.regexp_extract(price, r"^\$([0-9,]+)", 1), ",", "").try_cast("long"),
        "bedrooms": found(specs, r"(?i)(\d+)\s*bds?", "int"),
        "bathrooms": found(specs, r"(?i)([\d.]+)\s*ba", "double"),
        "living_area": F.regexp_replace(F.regexp_extract(specs, r"(?i)([\d,]+)\s*sqft", 1), ",", "").try_cast("long"),
        "kind": F.nullif(F.trim(F.regexp_extract(specs, r"(?i)sqft\s*([A-Za-z\s-]+)$", 1)), F.lit("")),
        "zip": F.nullif(F.regexp_extract(address, r"(\d{5})\s*$", 1), F.lit("")),
        "street": F.trim(F.element_at(F.split(address, ","), 1)),
    }


# Keys of a court record's legal description and the fields they fill.
LEGAL_KEYS = {"CN": "case_number", "LOT": "lot", "BLK": "block", "SUB": "subdivision", "SEC": "sec", "TWP": "twp", "RGE": "rge"}


def legal_parts(c: Column) -> Column:
    """Case number, lot, block, subdivision, section, township and range of a legal description; null where absent.

    The text is split at its keys; a key's field is what stands before the next key. The
    last three are single words, and a case number is one of the circuit court (CA).
    """
    keys = "|".join(LEGAL_KEYS)
    pattern = F.lit(rf"\b({keys}):((?:(?!\b(?:{keys}):).)*)")
    text = squeezed(F.coalesce(c, F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))

    def field(key: str) -> Column:
        value = F.trim(F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(1))["v"])
        if key in ("SEC", "TWP", "RGE"):
            value = F.split(value, " ")[0]
        if key == "CN":
            value = F.when(value.rlike(r"\bCA\b"), value)
        return F.nullif(value, F.lit(""))

    return F.struct(*[field(k).alias(n) for k, n in LEGAL_KEYS.items()])


# Words that mark an institution in a party's name.
INSTITUTIONS = (
    "BANK", "TRUST", "LLC", "INC", "CORP", "HOUSING", "URBAN", "DEVELOPMENT", "FINANCE", "FEDERAL", "COUNTY", "CITY",
    "STATE", "GOVERNMENT", "MANAGEMENT", "SOLUTIONS", "CAPITAL", "INVESTMENT", "MORTGAGE", "CREDIT", "UNION",
    "INTERNAL", "REVENUE", "SERVICE", "DEPARTMENT",
)


def owner_name(c: Column) -> Column:
    """The first of the newline-separated names without an institution's word, else the first; empty if none."""
    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda n: F.trim(n)), lambda n: n != "")
    persons = F.filter(names, lambda n: ~F.arrays_overlap(F.split(F.upper(n), r"\s+"), F.array(*map(F.lit, INSTITUTIONS))))
    return F.coalesce(F.try_element_at(persons, F.lit(1)), F.try_element_at(names, F.lit(1)), F.lit(""))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A template with {{ name }} replaced by values; unknown names become empty."""
    out = template
    for name, value in values.items():
        out = F.regexp_replace(out, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))
    return F.regexp_replace(out, r"\{\{[^}]*\}\}", "")
