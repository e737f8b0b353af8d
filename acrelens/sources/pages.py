"""Building facts and sales from landed appraiser and clerk pages (page_id, html), by Column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.functions.text import auction_date, sale_date, squeezed, whole_dollars


def tag_text(c: Column) -> Column:
    """Text of an HTML piece: tags become spaces, the commonest entities their characters."""
    out = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for entity, char in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeezed(out)


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def labelled_facts(html: Column) -> Column:
    """Map of bold labels and the italic values after them, first of each label."""
    pattern = r"(?is)<b>([^<]*)</b>\s*[-:]?\s*<i>(.*?)</i>"
    labels = F.transform(all_matches(html, pattern, 1), lambda x: F.upper(F.regexp_replace(squeezed(x), "[:-]$", "")))
    values = F.transform(all_matches(html, pattern, 2), tag_text)
    return _first_of_each(F.arrays_zip(labels.alias("k"), values.alias("v")))


def grid_facts(html: Column) -> Column:
    """Map of a grid's bold labels and the values in the cells after them, last of each label; codes in brackets at the end go."""
    pattern = r'(?is)<td[^>]*class="[^"]*font-bold[^"]*"[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>'
    labels = F.transform(all_matches(html, pattern, 1), tag_text)
    values = F.transform(all_matches(html, pattern, 2), tag_text)
    pairs = F.filter(F.arrays_zip(labels.alias("k"), values.alias("v")), lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.transform_values(_first_of_each(F.reverse(pairs)), lambda _, v: F.trim(F.regexp_replace(v, r"\s*\([^)]*\)?$", "")))


def _first_of_each(pairs: Column) -> Column:
    seen = F.aggregate(
        pairs,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, p: F.when(p["k"].isNull() | F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(p["k"]), F.array(p["v"])))),
    )
    return seen


def embedded_json(html: Column, name: str = "window.__remixContext") -> Column:
    """The JSON text that a page's script assigns to ``name``."""
    return F.regexp_extract(html, r"(?s)" + name.replace(".", r"\.") + r"\s*=\s*(\{.*?\});?\s*</script>", 1)


def table_rows(pages: DataFrame, header: str) -> DataFrame:
    """(page_id, at, cells: map of header to text) of the rows under a header row that holds ``header``."""
    rows = pages.select("page_id", F.posexplode(all_matches(F.col("html"), r"(?is)<tr[^>]*>(.*?)</tr>")).alias("at", "row"))
    cells = rows.select("page_id", "at", F.transform(all_matches(F.col("row"), r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), tag_text).alias("cells"))
    heads = cells.filter(F.exists("cells", lambda c: F.upper(c) == header.upper())).groupBy("page_id").agg(F.min(F.struct("at", "cells")).alias("head"))
    met = cells.join(heads, "page_id").filter("at > head.at and size(cells) = size(head.cells)")
    return met.select("page_id", "at", F.map_from_arrays(F.transform("head.cells", F.upper), "cells").alias("cells"))


def sales_of(pages: DataFrame) -> DataFrame:
    """Sales of appraiser pages' tables; rows without a date are left out."""
    rows = table_rows(pages, "SALE DATE")
    cell = lambda n: F.try_element_at("cells", F.lit(n))
    out = rows.select("page_id", "at", sale_date(cell("SALE DATE")).alias("sale_date"), whole_dollars(cell("VALUE")).alias("sale_price"), F.nullif(F.substring(cell("TYPE"), 1, 10), F.lit("")).alias("instrument_type"), F.coalesce(cell("GRANTOR"), F.lit("")).alias("grantor"), F.coalesce(cell("GRANTEE"), F.lit("")).alias("grantee"))
    return out.filter("sale_date is not null")


def attribute_cells(pages: DataFrame, container: str, attribute: str) -> DataFrame:
    """(page_id, at, cells: map of the cells' attribute to text) of the data rows of the table in a container."""
    table = F.regexp_extract("html", rf'(?is)<div[^>]*id="{container}"[^>]*>(.*?)</table>', 1)
    rows = pages.select("page_id", F.posexplode(all_matches(table, r'(?is)<tr[^>]*role="row"[^>]*>(.*?)</tr>')).alias("at", "row"))
    pattern = rf'(?is)<td[^>]*{attribute}="([^"]*)"[^>]*>(.*?)</td>'
    names, texts = (F.transform(all_matches(F.col("row"), pattern, i), tag_text) for i in (1, 2))
    return rows.select("page_id", "at", _first_of_each(F.reverse(F.arrays_zip(names.alias("k"), texts.alias("v")))).alias("cells"))


def cell_sales_of(pages: DataFrame) -> DataFrame:
    """Sales of pages whose cells name their column; book and page are left out, and rows without a date."""
    rows = attribute_cells(pages, "salesContainer", "data-cell")
    cell = lambda n: F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit(""))
    text = lambda n, most: F.nullif(F.substring(cell(n), 1, most), F.lit(""))
    return rows.filter(cell("Sale Date") != "").select(
        "page_id", "at", sale_date(cell("Sale Date")).alias("sale_date"), whole_dollars(cell("Sale Price")).alias("sale_price"), text("Instrument", 10).alias("instrument_type"),
        text("Qualification", 10).alias("qualification_code"), text("Sale Type", 50).alias("sale_type"), text("Multi-Parcel", 10).alias("multi_parcel"), cell("Grantor").alias("grantor"), cell("Grantee").alias("grantee"),
    )


#: Raw building columns of every kind of page, all text.
BUILDING = ("exterior_wall", "roof_type", "foundation", "living_area", "bedrooms", "bathrooms", "act_yr_blt", "eff_yr_blt", "zoning", "quality_code", "condition_code")
# Labels of appraiser pages and their columns.
PAIR_LABELS = {"roof_type": ["ROOF COVER"], "foundation": ["FOUNDATION"], "bedrooms": ["BEDROOMS", "NO. BEDROOMS"], "bathrooms": ["BATHROOMS", "NO. BATHROOMS", "FULL BATHS"], "quality_code": ["QUALITY", "GRADE"], "condition_code": ["CONDITION"]}
GRID_LABELS = {"exterior_wall": "extw", "roof_type": "RCVR", "foundation": "fndn", "bathrooms": "Bath", "bedrooms": "BED", "quality_code": "qual"}


def building_of(pages: DataFrame) -> DataFrame:
    """Raw building facts of appraiser pages with labelled pairs; several exterior walls are joined by " / "."""
    facts = labelled_facts(F.col("html"))
    walls = F.transform(all_matches(F.col("html"), r"(?is)<b>\s*EXTERIOR WALL\s*</b>\s*[-:]?\s*<i>(.*?)</i>"), tag_text)
    headed = lambda p: F.nullif(F.regexp_extract("html", rf"(?i){p}", 1), F.lit(""))
    rows = pages.select(
        "page_id", facts.alias("facts"), F.nullif(F.array_join(F.filter(walls, lambda w: w != ""), " / "), F.lit("")).alias("exterior_wall"), headed(r"zon(?:ing|ed):?\s*(?:<[^>]*>\s*)*([A-Z0-9-]+)").alias("zoning"),
        headed(r"Year Built:?\s*(?:<[^>]*>\s*)*(\d{4})").alias("act_yr_blt"), headed(r"Effective Year:?\s*(?:<[^>]*>\s*)*(\d{4})").alias("eff_yr_blt"), headed(r"(\d+)\s+Total SF").alias("living_area"),
    )
    get = lambda n: F.nullif(F.try_element_at("facts", F.lit(n)), F.lit(""))
    found = {c: F.coalesce(*map(get, labels)) for c, labels in PAIR_LABELS.items()}
    return rows.select("page_id", *[found[c].alias(c) if c in found else c for c in BUILDING])


def card_of(pages: DataFrame) -> DataFrame:
    """Raw building facts of parcel cards: a grid of bold labels, and years, area and zoning from the page's own JSON."""
    rows = pages.select("page_id", grid_facts(F.col("html")).alias("grid"), embedded_json(F.col("html")).alias("json"))
    told = lambda path: F.get_json_object("json", "$.state.loaderData['routes/_index']." + path)
    whole = lambda path: F.when(told(path).try_cast("double") != 0, told(path).try_cast("double").cast("long").cast("string"))
    heated = whole("buildings.units[0].squareFeet.heated")
    found = {
        "living_area": F.when(heated.cast("long") > 0, heated),
        "act_yr_blt": whole("buildings.units[0].yearBuilt.actual"),
        "eff_yr_blt": whole("buildings.units[0].yearBuilt.effective"),
        "zoning": F.nullif(F.trim(told("zonings[0].code")), F.lit("")),
        "condition_code": F.lit(None).cast("string"),
    }
    found |= {c: F.nullif(F.try_element_at("grid", F.lit(label)), F.lit("")) for c, label in GRID_LABELS.items()}
    return rows.select("page_id", *[found[c].alias(c) for c in BUILDING])


def auction_items_of(pages: DataFrame) -> DataFrame:
    """Items of landed foreclosure calendars: address, ZIP code, case number, opening bid and date; an item needs an address.

    An item begins with a division of class AUCTION_ITEM and ends where the next one begins.
    The ZIP code is that behind the state; without one, a number of the county's that is no
    house number, case number or amount.
    """
    items = F.filter(F.split("html", r'(?i)<div[^>]*class="[^"]*AUCTION_ITEM[^"]*"[^>]*>'), lambda _, i: i > 0)
    rows = pages.select("page_id", F.posexplode(items).alias("at", "item"))
    classed = lambda name: tag_text(F.regexp_extract("item", rf'(?is)<(\w+)[^>]*class="[^"]*{name}[^"]*"[^>]*>(.*?)</\1>', 2))
    text = tag_text(F.col("item"))
    address = classed("addr")
    rest = tag_text(F.regexp_replace("item", r'(?is)<(\w+)[^>]*class="[^"]*case[^"]*"[^>]*>.*?</\1>', " "))
    rest = F.regexp_replace(rest, r"(?i)\$\s*[\d,.]+|(?:opening bid|minimum bid|opening amount)[:\s]*[\d,.]+", " ")
    rest = F.replace(rest, address, F.regexp_replace(address, r"^\d+\b", ""))
    stated = F.regexp_extract(text, r"\b(?:FL|Florida)\b[.,]?\s+(\d{5})\b", 1)
    zip_ = F.regexp_extract(F.when(stated != "", stated).otherwise(rest), r"\b(325[0-3]\d)\b", 1)
    date = lambda i: F.regexp_extract(text, r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", i)
    out = rows.select(
        "page_id", "at", address.alias("address"), F.nullif(zip_, F.lit("")).alias("zip"), F.nullif(classed("case"), F.lit("")).alias("case_number"),
        F.nullif(F.regexp_extract("item", r'(?is)<a[^>]*href="([^"]*)"', 1), F.lit("")).alias("link"),
        F.replace(F.regexp_extract(text, r"(?i)(?:opening bid|minimum bid|opening amount)[:\s]*\$?([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("long").alias("opening_bid"),
        F.try_to_date(F.concat_ws("/", date(1), date(2), date(3)), "M/d/yyyy").alias("auction_date"),
    )
    return out.filter("address <> ''")


# Headers of the clerk's table and their columns.
CLERK_HEADERS = {
    "CLERK FILE #": "clerk_file", "CLERK FILE": "clerk_file", "ACCOUNT": "account", "CERTIFICATE NUMBER": "certificate_number", "REFERENCE": "reference",
    "SALES DATE": "sales_date", "STATUS": "status", "OPENING BID AMOUNT": "opening_bid_amount", "LEGAL DESCRIPTION": "legal_description",
    "SURPLUS BALANCE": "surplus_balance", "PROPERTY ADDRESS": "property_address",
}


def clerk_rows(pages: DataFrame) -> DataFrame:
    """Tax sale rows of clerk pages; a row needs a file number."""
    rows = table_rows(pages, "CLERK FILE #").unionByName(table_rows(pages, "CLERK FILE"))
    names: dict[str, list[Column]] = {}
    for header, name in CLERK_HEADERS.items():
        names.setdefault(name, []).append(F.nullif(F.try_element_at("cells", F.lit(header)), F.lit("")))
    out = rows.select("page_id", *[F.coalesce(*c).alias(n) for n, c in names.items()])
    bids = {n: whole_dollars(F.col(n)) for n in ("opening_bid_amount", "surplus_balance")}
    return out.withColumns(bids | {"sales_date": auction_date(F.col("sales_date"))}).filter("clerk_file is not null")


class PageRule(NamedTuple):
    """How a county's portal shows what it answered."""

    #: Every real answer holds it; a page without it is a soft block.
    marker: str
    #: A page that lacks it, though it has the marker, is tried again.
    content: str = ""
    #: Texts of an answer that knows no such parcel.
    unknown: tuple[str, ...] = ()
    #: Where a request is sent when the portal blocks it, and part of where it is sent for an unknown parcel.
    blocked_at: tuple[str, ...] = ()
    unknown_at: str = ""


# By county, the texts and addresses of the portals' answers.
PAGE_RULES = {
    "12033": PageRule("Parcel ID:", "General Information", (), ("https://www.escpa.org", "https://escpa.org"), "/cama/search.aspx"),
    "12113": PageRule("window.__remixContext", "", ('"empty":true', '"empty": true')),
}
#: The sale history page of the second county.
SALES_PAGE_RULE = PageRule("salesContainer")


def page_kind(html: Column, rule: PageRule, redirects: Column | None = None) -> Column:
    """What a landed page tells the crawl: SOFT_BLOCK stops it, NOT_FOUND is stamped and passed, TRANSIENT is tried again, OK is parsed.

    A null page is a request without an answer. ``redirects`` are the addresses that the request was sent on to.
    """
    at = F.lit(None).cast("array<string>") if redirects is None else F.transform(redirects, F.lower)
    sent = lambda test: F.coalesce(F.exists(at, test), F.lit(False))
    kind = F.when(html.isNull(), "TRANSIENT")
    if rule.unknown_at:
        kind = kind.when(sent(lambda u: u.contains(rule.unknown_at)), "NOT_FOUND")
    if rule.blocked_at:
        kind = kind.when(sent(lambda u: F.regexp_replace(u, "/+$", "").isin(*rule.blocked_at)), "SOFT_BLOCK")
    kind = kind.when(~html.contains(rule.marker), "SOFT_BLOCK")
    for text in rule.unknown:
        kind = kind.when(html.contains(text), "NOT_FOUND")
    if rule.content:
        kind = kind.when(~html.contains(rule.content), "TRANSIENT")
    return kind.otherwise("OK")


def county_page_kind(county: Column, html: Column, redirects: Column | None = None) -> Column:
    """``page_kind`` by the county's rule; null for a county without one."""
    return F.coalesce(*[F.when(county == c, page_kind(html, rule, redirects)) for c, rule in PAGE_RULES.items()])
