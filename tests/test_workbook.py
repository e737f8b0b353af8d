import io
import tracemalloc
import zipfile

import pytest

from acrelens.sources import files, workbook

MAIN, OFFICE, LINKS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"


def book(sheet, strings=None, target="worksheets/other.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="b" r:id="r9"/><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{LINKS}"><Relationship Id="r1" Target="worksheets/no.xml"/><Relationship Id="r9" Target="{target}"/></Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
    out.seek(0)
    return out


@pytest.mark.parametrize("target", ["worksheets/other.xml", "/xl/worksheets/other.xml"])
def test_cells_of_every_kind(target):
    strings = "<si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>not this</t></rPh></si>"
    sheet = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c t="inlineStr"><is><t> x </t></is></c><c t="b"><v>1</v></c><c><v>1.50</v></c><c r="AB3" t="str"><v>far</v></c><c t="n"/></row>'
    rows = list(workbook.sheet_rows(book(sheet, strings, target)))
    assert rows[:2] == [["plain", "", "two runs"], []]
    assert rows[2][:3] == [" x ", "TRUE", "1.50"] and rows[2][27] == "far" and len(rows[2]) == 29


def test_memory_does_not_grow_with_the_rows():
    most = []
    for n in (2_000, 40_000):
        file = book("".join(f'<row><c t="inlineStr"><is><t>value {i} {"x" * 50}</t></is></c></row>' for i in range(n)))
        tracemalloc.start()
        assert sum(1 for _ in workbook.sheet_rows(file)) == n
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 2 * most[0] + 500_000


def test_the_same_rows_as_the_export(spark, tmp_path):
    rows = [("LIS PENDENS", "1", "open", "a, b\n\"c\""), ("Lis pendens x", "2", None, "<&>"), ("DEED", "3", "open", ""), ("lis pendens", "4", "é", " z")]
    df = spark.createDataFrame(rows, "`Doc Type` string, `Case` string, Status string, Note string").coalesce(1)
    workbook.write_workbooks(df, str(tmp_path / "books"))
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "csv"))
    told = lambda path: sorted(tuple(r) for r in files.read_court_records(spark, path).collect())
    assert [r[1] for r in told(str(tmp_path / "books/*.xlsx"))] == ["1", "4"]
    assert told(str(tmp_path / "books/*.xlsx")) == told(str(tmp_path / "csv"))
    (tmp_path / "books" / "a.xlsx").write_bytes(book('<row><c t="inlineStr"><is><t>Case</t></is></c><c t="inlineStr"><is><t> Status </t></is></c></row><row><c><v>7</v></c></row>').getvalue())
    both = workbook.read_workbooks(spark, str(tmp_path / "books/*.xlsx"))
    assert both.columns == ["Case", "Status"] and both.count() == 5
