import datetime as dt

import pytest
from pyspark.sql import functions as F

from acrelens.sources import county_pages as C

SALES = """<DIV align=center ID='ctl00_MasterPlaceHolder_SalesCell'><table><tr><th>Sales Data
<tr><td>Type<td>Sale Date<td>Value<td>Multi Parcel
<tr><td>WD</td><td>05/2020<td> $1,000 <td>Y <table><tr><td>inner<td>06/2020<td>$5</table>
<tr><td>QC<td>1/2/2003
<tr><td>OT<td><td>$9
<tr><td>CT<td>official records inquiry</table></div>"""


def test_cells_that_are_not_closed_and_tables_in_cells():
    got = list(C.first_county_sales(SALES))
    assert got == [
        {"instrument_type": "WD", "sale_date": "05/2020", "sale_price": "$1,000", "multi_parcel": "Y"} | {"multi_parcel": "Y"},
        {"instrument_type": "QC", "sale_date": "1/2/2003", "sale_price": "", "multi_parcel": "N"},
    ]


@pytest.mark.parametrize("read", [r for r, _ in C.READERS.values()])
@pytest.mark.parametrize("html", ["", "no tags", "<", "<table", "</td></tr></table>", "<table><tr><td id=ctl00_MasterPlaceHolder_SalesCell>", "<!-- <table> --><script>'<td>'</script>", "<td>" * 3000, "<div>" * 3000 + "x"])
def test_odd_pages_give_no_rows(read, html):
    assert list(read(html)) == []


def test_trees():
    root = C.tree("<p>a<p>b<br>c <ul><li>1<li>2</ul><table><tr><td>x<table><tr><td>y</table>z<td>w</table>&amp;&#39;")
    table = next(root.every("table"))
    assert [c.text("|") for c in table.own("td")] == ["x|y|z", "w"]
    assert [x.text() for x in root.every("li")] == ["1", "2"]
    assert [x.text("|") for x in root.every("p")][0] == "a" and root.text("|").endswith("&'")
    assert len(list(root.every("td"))) == 3


def test_buildings():
    page = """<div class=a id="ctl00_MasterPlaceHolder_MapBodyStats">Section Map Id:<br>CA123<br>0.25<br>R-1A<br>R-2</div>
    <table id=ctl00_MasterPlaceHolder_tblBldgs><tr><td><table><tr><th>year built: 1984, EFFECTIVE YEAR: 1990 1234 total sf</th><tr><td>
    <b>Exterior Wall</b> - <i>BRICK</i><b>EXTERIOR WALL</b>-<i>VINYL</i><b>NO. BEDROOMS</b><b>GRADE</b><i>A</i></td></table></table>"""
    assert list(C.first_county_building(page)) == [{"zoning": "R-1A", "act_yr_blt": "1984", "eff_yr_blt": "1990", "living_area": "1234", "bedrooms": "A", "quality_code": "A", "exterior_wall": "BRICK / VINYL"}]
    card = "<tr><td class='x font-bold y'>extw<td>BRICK(20)<td>40%<td class=font-bold>qual<td>CLASS 4(04<tr><td class=font-bold>BED<td><tr><td class=font-bold>fndn"
    assert list(C.second_county_card(card)) == [{"exterior_wall": "BRICK", "quality_code": "CLASS 4"}]


def test_named_cells_and_the_clerk():
    page = "<div id=other><table><tr role=row><td data-cell='Sale Date'>1/1/2001</table></div><div id=salesContainer><table><tr role=row><th>Sale Date<tr role=row><td data-cell=\"Sale Date\" class=c>2/3/2004<td class=d data-cell='Sale Price'><span>$5</span><td data-cell='Book / Page'>1<tr><td data-cell='Sale Date'>no row<tr role='row'><td data-cell='Grantee'>x"
    assert list(C.second_county_sales(page)) == [{"sale_date": "2/3/2004", "sale_price": "$5"}]
    clerk = "<table><tr><td>t<table bgcolor='#0054A6'><tr><th>View<th>CLERK <b>FILE</b> #<th>Status<tr><td>v<td> 7 <td>a\n b<tr><td>v<td> <td>x<tr><td>v<td>8</table></table>"
    assert list(C.clerk_sales(clerk)) == [{"clerk_file": "7", "status": "a b"}, {"clerk_file": "8", "status": ""}]


def test_functions_of_sql_and_clashing_columns(spark):
    C.register(spark)
    pages = spark.createDataFrame([(1, SALES, 9), (2, None, 9), (3, "", 9)], "page_id int, html string, n int")
    pages.createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT page_id, n, s.at, s.sale_date FROM some_pages, LATERAL escambia_sales(html) s ORDER BY s.at").collect()
    assert [tuple(r) for r in got] == [(1, 9, 0, "05/2020"), (1, 9, 1, "1/2/2003")]
    typed = C.typed_sales(C.rows_of(pages, "escambia_sales")).orderBy("at").collect()
    assert [(r["n"], r["sale_date"], r["sale_price"], r["multi_parcel"]) for r in typed] == [(9, dt.date(2020, 5, 1), 1000, "Y"), (9, dt.date(2003, 1, 2), None, "N")]


@pytest.mark.parametrize("name", list(C.READERS))
def test_rows_of_are_the_table_functions_rows(spark, name):
    C.register(spark)
    clerk = "<table bgcolor='#0054A6'><tr><th>Clerk file #<tr><td>7<tr><td>8</table>"
    htmls = [SALES, None, "", clerk, "<tr><td class=font-bold>qual<td>A", '<div id="salesContainer"><tr role=row><td data-cell="Sale Date">1/2/2003</div>', "<div id=ctl00_MasterPlaceHolder_MapBodyStats>R-1</div>"]
    pages = spark.createDataFrame([(i, h, [i]) for i, h in enumerate(htmls * 200)], "page_id int, html string, held array<int>")
    pages.createOrReplaceTempView("kinds_of_pages")
    wanted = spark.sql(f"SELECT page_id, held, s.* FROM kinds_of_pages, LATERAL {name}(html) s")
    found = C.rows_of(pages, name)
    assert found.schema.simpleString() == wanted.schema.simpleString()
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) != []


def test_pages_of_a_small_file_are_dealt_to_tasks(spark, tmp_path):
    """A file of few bytes is one split, whatever its rows cost."""
    from acrelens.plans.fixtures import table

    spark.range(4000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    landed = table(spark, str(tmp_path), "landed").select("page_id", F.col("clerk_page").alias("html"))
    tasks = landed.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 * spark.sparkContext.defaultParallelism and max(t["count"] for t in tasks) < 4000 / 8
