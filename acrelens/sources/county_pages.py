"""Table functions that read the counties' landed pages, to be joined laterally with a table of pages.

A page becomes a tree by the standard library's parser and a stack: attributes may stand in
any order and quoting, a cell, row, item or paragraph that is not closed ends where the next
one begins, and tables in cells are trees of their own, whose rows are no rows of the outer
table. Each function takes the html of one page and gives rows of text; types are made by
Columns after it. Null pages give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from acrelens.functions.text import auction_date, sale_date, whole_dollars
from acrelens.sources.pages import BUILDING, CLERK_HEADERS, GRID_LABELS, PAIR_LABELS

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag ends these that are still open, up to the nearest of the others.
_ENDS = {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"div", "td", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}


_PLAIN_START = re.compile(r"<([a-z][a-z0-9]*)>").match
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>").match
#: Elements that newer parsers read as text, too.
_TEXT_ELEMENTS = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class Node:
    """An element: its tag, attributes, and what it holds, texts among it."""

    __slots__ = ("tag", "attributes", "held")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.held = tag, attributes, []

    def every(self, *tags: str, through: Callable[[Node], bool] = lambda _: True) -> Iterator[Node]:
        """Elements below with one of the tags, in order; not below those that ``through`` stops at."""
        stack = [iter(self.held)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    if x.tag in tags:
                        yield x
                    if through(x):
                        stack.append(iter(x.held))
                        break
            else:
                stack.pop()

    def own(self, *tags: str) -> Iterator[Node]:
        """Elements with one of the tags that belong to this table or row and not to one inside."""
        return self.every(*tags, through=lambda x: x.tag != "table")

    def texts(self) -> Iterator[str]:
        stack = [iter(self.held)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    stack.append(iter(x.held))
                    break
                yield x
            else:
                stack.pop()

    def text(self, between: str = "") -> str:
        return between.join(t for t in map(str.strip, self.texts()) if t)

    def with_id(self, name: str, tag: str | None = None) -> Node | None:
        return next((x for x in self.all() if x.attributes.get("id") == name and tag in (None, x.tag)), None)

    def all(self) -> Iterator[Node]:
        stack = [iter(self.held)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    yield x
                    stack.append(iter(x.held))
                    break
            else:
                stack.pop()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.stack = [self.root]

    # Pages are mostly tags without attributes, which need no more than a look; line numbers are not asked for.
    def updatepos(self, i, j):
        return j

    def parse_starttag(self, i):
        plain = _PLAIN_START(self.rawdata, i)
        if plain is None or (tag := plain[1]) in self.CDATA_CONTENT_ELEMENTS or tag in _TEXT_ELEMENTS:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, ())
        return plain.end()

    def parse_endtag(self, i):
        plain = None if self.cdata_elem else _PLAIN_END(self.rawdata, i)
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        stack = self.stack
        if tag in _ENDS:
            ends, walls = _ENDS[tag]
            if (at := self._within(walls, ends, first=False)) is not None:
                del stack[at:]
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {})
        stack[-1].held.append(node)
        if tag not in _VOID:
            stack.append(node)

    def _within(self, walls, wanted, first: bool) -> int | None:
        """Where on the stack the first or last of the wanted elements stands, from the innermost one up to a wall."""
        found = None
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at].tag
            if tag in walls:
                break
            if tag in wanted:
                found = at
                if first:
                    break
        return found

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].held.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        walls = () if tag == "table" else ("table",) if tag in ("tr", "td", "th", "tbody", "thead") else ("td", "th", "table")
        if self.stack[-1].tag == tag:
            self.stack.pop()
        elif (at := self._within(walls, (tag,), first=True)) is not None:
            del self.stack[at:]

    def handle_data(self, data):
        self.stack[-1].held.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


# Ids of the first county's page, and the colour of the clerk's table.
_ZONES, _BUILDINGS, _SALES = (f"ctl00_MasterPlaceHolder_{x}" for x in ("MapBodyStats", "tblBldgs", "SalesCell"))
_CLERK_COLOUR = "#0054A6"
_HEADED = {"act_yr_blt": r"(?i)Year Built:\s*(\d{4})", "eff_yr_blt": r"(?i)Effective Year:\s*(\d{4})", "living_area": r"(?i)(\d+)\s+Total SF"}


def _zone(page: Node) -> str | None:
    """The first line of the map's facts that looks like a zone and is neither a map's number nor an acreage."""
    facts = page.with_id(_ZONES)
    lines = (line.strip() for t in (facts.texts() if facts else ()) for line in t.splitlines())
    return next((x for x in lines if re.fullmatch(r"[A-Z0-9-]{2,10}", x) and not x.startswith("CA")), None)


def _followed(node: Node) -> Iterator[tuple[Node, Node]]:
    """Bold elements and the first italic one after each beside it."""
    for parent in [node, *node.all()]:
        below = [x for x in parent.held if isinstance(x, Node)]
        for i, x in enumerate(below):
            if x.tag == "b":
                value = next((y for y in below[i + 1 :] if y.tag == "i"), None)
                if value is not None:
                    yield x, value


def first_county_building(html: str) -> Iterator[dict]:
    page = tree(html)
    found: dict[str, str] = {}
    if zone := _zone(page):
        found["zoning"] = zone
    outer = page.with_id(_BUILDINGS)
    column = {label: c for c, labels in PAIR_LABELS.items() for label in labels}
    walls: list[str] = []
    for table in outer.every("table") if outer else ():
        head = next(table.every("th"), None)
        if head is None:
            continue
        for name, pattern in _HEADED.items():
            if met := re.search(pattern, head.text(" ")):
                found.setdefault(name, met[1])
        for label, value in _followed(table):
            text, name = value.text(), label.text().upper()
            if text and name == "EXTERIOR WALL":
                walls.append(text)
            elif text and name in column:
                found.setdefault(column[name], text)
    if walls:
        found["exterior_wall"] = " / ".join(walls)
    for span in outer.every("span") if outer and "living_area" not in found else ():
        if "lightgrey" in span.attributes.get("style", "").lower() and (met := re.search(_HEADED["living_area"], span.text())):
            found["living_area"] = met[1]
            break
    if found:
        yield found


def first_county_sales(html: str) -> Iterator[dict]:
    cell = tree(html).with_id(_SALES)
    table = next(cell.every("table"), None) if cell else None
    rows = list(table.own("tr")) if table else []
    at: dict[str, int] = {}
    for i, head in enumerate(rows[1].own("td") if len(rows) > 2 else ()):
        name = head.text().lower()
        kind = "sale_date" if "sale date" in name else "sale_price" if name == "value" else "instrument_type" if name == "type" else "multi_parcel" if "multi" in name else None
        if kind:
            at[kind] = i
    if "sale_date" not in at:
        return
    for row in rows[2:]:
        cells = [c.text() for c in row.own("td")]
        told = {k: cells[i] if i < len(cells) else "" for k, i in at.items()}
        if told["sale_date"] and "official records" not in told["sale_date"].lower():
            yield told | {"multi_parcel": "N" if told.get("multi_parcel", "").upper() in ("", "N") else "Y"}


def second_county_card(html: str) -> Iterator[dict]:
    """The grid of bold labels alone; years, area and zone are in the page's JSON, see ``pages.card_of``."""
    grid: dict[str, str] = {}
    for row in tree(html).every("tr"):
        cells = list(row.own("td"))
        for label, value in zip(cells, cells[1:]):
            if "font-bold" in label.attributes.get("class", "") and label.text() and value.text():
                grid[label.text()] = value.text()
    found = {c: re.sub(r"\s*\([^)]*\)?$", "", grid[label]).strip() for c, label in GRID_LABELS.items() if label in grid}
    if found:
        yield found


# Names of the second county's cells and their columns.
_NAMED = {"Sale Date": "sale_date", "Sale Price": "sale_price", "Instrument": "instrument_type", "Qualification": "qualification_code", "Sale Type": "sale_type", "Multi-Parcel": "multi_parcel", "Grantor": "grantor", "Grantee": "grantee"}


def second_county_sales(html: str) -> Iterator[dict]:
    held = tree(html).with_id("salesContainer", "div")
    for row in held.every("tr") if held else ():
        if row.attributes.get("role") == "row":
            told = {_NAMED[n]: c.text() for c in row.own("td") if (n := c.attributes.get("data-cell")) in _NAMED}
            if told.get("sale_date"):
                yield told


def clerk_sales(html: str) -> Iterator[dict]:
    table = next((t for t in tree(html).every("table") if t.attributes.get("bgcolor") == _CLERK_COLOUR), None)
    rows = list(table.own("tr")) if table else []
    names: dict[int, str] = {}
    for i, head in enumerate(rows[0].own("th", "td") if rows else ()):
        text = head.text(" ").lower()
        if name := next((c for label, c in CLERK_HEADERS.items() if label.lower() in text), None):
            names[i] = name
    for row in rows[1:]:
        cells = [re.sub(r"\s+", " ", c.text(" ")) for c in row.own("td")]
        told = {c: cells[i] if i < len(cells) else "" for i, c in names.items()}
        if told.get("clerk_file"):
            yield told


_SALE = ("sale_date", "sale_price", "instrument_type", "qualification_code", "sale_type", "multi_parcel", "grantor", "grantee")
#: Name in SQL: what reads a page, and the columns of its rows.
READERS = {
    "escambia_building": (first_county_building, BUILDING),
    "escambia_sales": (first_county_sales, _SALE),
    "santa_rosa_card": (second_county_card, BUILDING),
    "santa_rosa_sales": (second_county_sales, _SALE),
    "escambia_clerk_sales": (clerk_sales, tuple(dict.fromkeys(CLERK_HEADERS.values()))),
}


def table_function(name: str):
    """The table function of a reader: ``at`` and its columns, null where a page tells nothing."""
    read, columns = READERS[name]

    class Rows:
        def eval(self, html: str):
            for at, row in enumerate(read(html) if html is not None else ()):
                yield (at, *[row.get(c) or None for c in columns])

    return udtf(Rows, returnType=f"at int, {', '.join(f'{c} string' for c in columns)}", useArrow=False)  # with Arrow, each page would be a batch of its own


def register(spark: SparkSession) -> None:
    """Make all readers table functions of SQL: ``SELECT page_id, s.* FROM pages, LATERAL escambia_sales(html) s``."""
    for name in READERS:
        spark.udtf.register(name, table_function(name))


#: Pages that are read, and given back, at once.
PAGES = 512


def rows_of(pages: DataFrame, name: str, html: str = "html") -> DataFrame:
    """The columns of ``pages`` but html, and the reader's rows of each page; what the table function gives, in batches of pages."""
    read, columns = READERS[name]
    kept = [c for c in pages.columns if c != html]
    schema = StructType([pages.schema[c] for c in kept]).add("at", IntegerType())
    for c in columns:
        schema = schema.add(c, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, PAGES):
                batch = whole.slice(first, PAGES)
                of, at, found = [], [], []
                for i, text in enumerate(batch.column(len(kept)).to_pylist()):
                    for j, row in enumerate(read(text) if text is not None else ()):
                        of.append(i)
                        at.append(j)
                        found.append(row)
                held = [batch.column(k).take(pa.array(of, pa.int32())) for k in range(len(kept))]
                told = [pa.array([row.get(c) or None for row in found], pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays([*held, pa.array(at, pa.int32()), *told], schema.names)

    return pages.select(*kept, F.col(html).cast("string")).mapInArrow(run, schema)


def typed_sales(rows: DataFrame) -> DataFrame:
    """Sales with a date and whole dollars; those without a date that can be read are left out."""
    text = lambda c, most: F.substring(c, 1, most).alias(c)
    kept: list[Column] = [F.col(c) for c in rows.columns if c not in _SALE]
    out = rows.select(*kept, sale_date(F.col("sale_date")).alias("sale_date"), whole_dollars(F.col("sale_price")).alias("sale_price"), text("instrument_type", 10), text("qualification_code", 10), text("sale_type", 50), text("multi_parcel", 10), F.coalesce("grantor", F.lit("")).alias("grantor"), F.coalesce("grantee", F.lit("")).alias("grantee"))
    return out.filter("sale_date is not null")


def typed_clerk_sales(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: whole_dollars(F.col(c)) for c in ("opening_bid_amount", "surplus_balance")} | {"sales_date": auction_date(F.col("sales_date"))})
