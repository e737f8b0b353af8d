"""Workbooks as rows of text, streamed inside tasks; no reader of workbooks needs to be installed.

A workbook is a zip archive of XML parts. Its first sheet is parsed as it is unpacked, a row
element at a time, and every row is given out and forgotten; only the table of shared
strings, each of which stands once, is held. A workbook is read by one task, as a packed
sheet can't be entered in its middle. Paths may be on any file system that Arrow opens.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.sources.shapefile import _opened

ROWS = 2_000
# Names of the archive's parts and of the namespace of relations.
_BOOK, _LINKS, _STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element) -> str:
    """The text of a string's runs; readings above the text are not part of it."""
    out = []
    for x in element:
        if _name(x) == "t":
            out.append(x.text or "")
        elif _name(x) == "r":
            out += [t.text or "" for t in x if _name(t) == "t"]
    return "".join(out)


def _column(place: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", place)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(file) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet, cells as text, empty where there is none."""
    with zipfile.ZipFile(file) as book:
        first = next(x for x in ElementTree.fromstring(book.read(_BOOK)).iter() if _name(x) == "sheet").get(_RELATION)
        target = next(x.get("Target") for x in ElementTree.fromstring(book.read(_LINKS)) if x.get("Id") == first)
        shared: list[str] = []
        if _STRINGS in book.namelist():
            with book.open(_STRINGS) as part:
                for _, x in ElementTree.iterparse(part):
                    if _name(x) == "si":
                        shared.append(_text(x))
                        x.clear()
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            sheet = None
            for event, x in ElementTree.iterparse(part, events=("start", "end")):
                if event == "start":
                    sheet = x if _name(x) == "sheetData" else sheet
                elif _name(x) == "row":
                    cells: list[str] = []
                    for c in x:
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        kind, value = c.get("t", "n"), next((y for y in c if _name(y) in ("v", "is")), None)
                        text = "" if value is None else _text(value) if kind == "inlineStr" else value.text or ""
                        text = shared[int(text)] if kind == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
                        cells += [""] * (at + 1 - len(cells))
                        cells[at] = text
                    yield cells
                    sheet.clear()  # what was given out is forgotten


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of workbooks' first sheets under the headers of the first workbook; headers trimmed, cells text, null where empty."""
    paths = spark.read.format("binaryFile").load(path).select("path")
    one = paths.orderBy("path").first()
    if one is None:
        raise FileNotFoundError(path)
    files, at = _opened(one["path"])
    with files.open_input_file(at) as file:
        names = [n.strip() for n in next(sheet_rows(file), [])]
    wanted = [n for n in dict.fromkeys(names) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = _opened(path)
                with files.open_input_file(at) as file:
                    rows = sheet_rows(file)
                    heads = [n.strip() for n in next(rows, [])]
                    places = [heads.index(n) if n in heads else len(heads) for n in wanted]
                    held: list[list[str | None]] = []
                    for cells in rows:
                        held.append([(cells[i] or None) if i < len(cells) else None for i in places])
                        if len(held) == ROWS:
                            yield _batch(held, wanted)
                            held = []
                    if held:
                        yield _batch(held, wanted)

    return paths.repartition("path").mapInArrow(run, ", ".join(f"`{n}` string" for n in wanted))


def _batch(rows: list[list[str | None]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)


def write_workbooks(rows: DataFrame, folder: str) -> None:
    """Every partition that has rows as a workbook with one sheet and its cells as inline text; a row per task comes to the driver."""
    names = rows.columns
    said = '<?xml version="1.0" encoding="UTF-8"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    links = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def line(cells) -> str:
        return "<row>" + "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in cells) + "</row>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():05d}.xlsx"  # an attempt that is made again writes the same
        with files.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("[Content_Types].xml", f'{said}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
            book.writestr("_rels/.rels", f'{said}<Relationships xmlns="{links}"><Relationship Id="r1" Type="{office}/officeDocument" Target="{_BOOK}"/></Relationships>')
            book.writestr(_BOOK, f'{said}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>')
            book.writestr(_LINKS, f'{said}<Relationships xmlns="{links}"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'{said}<worksheet xmlns="{main}"><sheetData>{line(names)}'.encode())
                for batch in chain([first], batches):
                    for cells in zip(*(c.to_pylist() for c in batch.columns)):
                        sheet.write(line(cells).encode())
                sheet.write(b"</sheetData></worksheet>")
        yield pa.RecordBatch.from_pydict({"name": [name]})

    rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).mapInArrow(run, "name string").collect()
