import datetime
import math
import zipfile

import pytest

from brinework.sources import excel

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheets, strings="", styles="", late=False):
    """A workbook with what the format requires and no more; ``sheets``: name -> rows as XML."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {MAIN} xmlns:r="{OFFICE}"><workbookPr date1904="{int(late)}"/><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="x" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {RELS}>{links}</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<x:worksheet xmlns:x="{MAIN[7:-1]}"><x:sheetData>{rows}</x:sheetData></x:worksheet>'.replace("<c", "<x:c").replace("</c", "</x:c").replace("<v", "<x:v").replace("</v", "</x:v").replace("<row", "<x:row").replace("</row", "</x:row").replace("<is", "<x:is").replace("</is", "</x:is").replace("<t>", "<x:t>").replace("</t>", "</x:t>") if i else f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
    return str(path)


STRINGS = "<si><t>name</t></si><si><t>size</t></si><si><r><t>a </t></r><r><rPr/><t>b</t></r><rPh><t>no</t></rPh></si><si><t>when &amp; é</t></si>"
STYLES = '<numFmts count="2"><numFmt numFmtId="170" formatCode="[Red]0.0&quot; days&quot;"/><numFmt numFmtId="171" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
ROWS = """<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="s"><v>3</v></c><c r="E2" t="inlineStr"><is><t>name</t></is></c><c r="F2" t="str"><v>ok</v></c></row>
<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>1.5</v></c><c r="D3" s="1"><v>43831.25</v></c><c r="E3" s="2"><v>7</v></c><c r="F3" t="b"><v>1</v></c></row>
<row r="5"><c r="A5" t="str"><f>X</f><v>=</v></c><c r="B5" t="e"><v>#DIV/0!</v></c><c r="D5" s="3"><v>59</v></c><c r="F5" t="b"><v>0</v></c></row>
<row r="6"><c r="B6" s="1"/></row>
<row r="7"><c r="B7"><v>2E2</v></c><c r="C7" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c><c r="D7" t="d"><v>2020-02-03T04:05:06</v></c></row>"""


def test_a_workbook_by_hand(spark, tmp_path):
    path = book(tmp_path / "a.xlsx", {"First": ROWS, "Two": '<row><c><v>1</v></c><c t="s"><v>0</v></c></row><row><c><v>2</v></c></row>'}, STRINGS, STYLES)
    df = excel.read_excel(spark, path)
    when = "when & é"
    assert df.dtypes == [("name", "string"), ("size", "double"), ("Unnamed: 2", "string"), (when, "timestamp_ntz"), ("name.1", "bigint"), ("ok", "boolean")]
    d = datetime.datetime
    assert [tuple(r) for r in df.collect()] == [("a b", 1.5, None, d(2020, 1, 1, 6), 7, True), ("=", None, None, d(1900, 2, 28), None, False), (None, 200.0, "xy", d(2020, 2, 3, 4, 5, 6), None, None)]
    assert [tuple(r) for r in excel.read_excel(spark, path, "Two", header=False).collect()] == [(1, "name"), (2, None)]
    assert excel.read_excel(spark, path, 1).columns == ["1", "name"]
    assert excel.sheet_rows(spark.read.format("binaryFile").load(path), None).groupBy("sheet").count().count() == 2


def test_days_from_1904_and_no_sheet(spark, tmp_path):
    path = book(tmp_path / "b.xlsx", {"S": '<row><c t="inlineStr"><is><t>d</t></is></c></row><row><c s="1"><v>0</v></c></row>'}, styles=STYLES, late=True)
    assert excel.read_excel(spark, path).first().d == datetime.datetime(1904, 1, 1)
    assert excel.read_excel(spark, path, "none").columns == []


def test_headers_that_differ(spark, tmp_path):
    for name in "ab":
        book(tmp_path / f"{name}.xlsx", {"S": f'<row><c t="inlineStr"><is><t>{name}</t></is></c></row><row><c><v>1</v></c></row>'})
    with pytest.raises(ValueError, match="same header"):
        excel.read_excel(spark, str(tmp_path))
    assert excel.read_excel(spark, str(tmp_path), header=False).count() == 4


def test_written_and_read_back(spark, tmp_path):
    d = datetime.datetime
    rows = [(i, float(i) / 3, f"t<{i}>&\"' é\x01", d(2001, 2, 3, 4, 5, 6), datetime.date(2020, 1, i % 28 + 1), i % 2 == 0, None) for i in range(25)] + [(None, None, None, None, None, None, None), (2**60, math.nan, " ", d(1990, 1, 1), None, None, None)]
    df = spark.createDataFrame(rows, "i long, x double, s string, t timestamp_ntz, d date, b boolean, n string").coalesce(2)
    excel.write_excel(df, str(tmp_path / "out"), "A & B", rows=4)
    assert len(list((tmp_path / "out").glob("*.xlsx"))) >= 7
    got = excel.read_excel(spark, str(tmp_path / "out"), "A & B")
    assert got.columns == df.columns and dict(got.dtypes)["i"] == "string"  # 2 ** 60 has more digits than a number shows safely
    want = {(str(i), x, s.replace("\x01", ""), t, d(day.year, day.month, day.day), b, None) for i, x, s, t, day, b, _ in rows[:25]} | {(str(2**60), None, " ", d(1990, 1, 1), None, None, None)}
    assert {tuple(r) for r in got.collect()} == want
