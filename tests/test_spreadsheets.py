"""Workbooks: round trips, shared strings, several sheets and files, and awkward cells."""

import zipfile

import pytest

from meridia.sources import readers, spreadsheets

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook(path, sheets: dict[str, str], strings=()):
    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{DOCUMENT}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml" Type="x"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        if strings:
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(f"<si>{s}</si>" for s in strings)}</sst>')
        for i, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')


def test_column_names_count_on():
    for place, name in ((0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")):
        assert spreadsheets.column_name(place) == name and spreadsheets.column_number(f"{name}12") == place


def test_cells_of_every_kind(spark, tmp_path):
    strings = ["<t>name</t>", "<r><t>ri</t></r><r><t>ch</t></r>"]
    first = """<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>n</t></is></c><c r="D2" t="str"><v>mix</v></c><c r="E2" t="str"><v>yes</v></c></row>
      <row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>3</v></c><c r="D3"><v>1.5</v></c><c r="E3" t="b"><v>1</v></c><c r="F3"><v>9</v></c></row>
      <row r="4"/>
      <row r="5"><c r="B5"><v>-4</v></c><c r="D5" t="e"><v>#DIV/0!</v></c><c r="E5" t="b"><v>0</v></c></row>
      <row><c t="inlineStr"><is><t>a &lt; b</t></is></c><c><v>5</v></c><c><v>2.5</v></c><c t="str"><v>x</v></c></row>"""
    workbook(tmp_path / "a.xlsx", {"one": first, "two": '<row r="1"><c r="A1" t="str"><v>k</v></c></row>'}, strings)
    got = spreadsheets.read_excel(spark, f"file://{tmp_path}/a.xlsx")
    assert got.dtypes == [("name", "string"), ("n", "bigint"), ("_c2", "double"), ("mix", "string"), ("yes", "boolean")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("rich", 3, None, "1.5", True), (None, -4, None, None, False), ("a < b", 5, 2.5, "x", None)], key=str)
    two = spreadsheets.read_excel(spark, f"file://{tmp_path}/a.xlsx", sheet="two")
    assert two.columns == ["k"] and two.collect() == []
    with pytest.raises(Exception, match="no sheet"):
        spreadsheets.read_excel(spark, f"file://{tmp_path}/a.xlsx", sheet="three").collect()
    workbook(tmp_path / "empty.xlsx", {"one": ""})
    with pytest.raises(ValueError):
        spreadsheets.read_excel(spark, f"file://{tmp_path}/empty.xlsx")


def test_round_trip_by_extension_and_many_files(spark, tmp_path):
    rows = [(i, f"<{i}> & é\n", i / 4, i % 2 == 0 if i else None) for i in range(12)]
    df = spark.createDataFrame(rows, "i long, s string, d double, b boolean")
    spreadsheets.write_excel(df, f"file://{tmp_path}/x.xlsx", order=["i"])
    got = readers.read_table(spark, f"file://{tmp_path}/x.xlsx")
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == rows
    assert readers.read_table(spark, f"file://{tmp_path}/x.xlsx", n_rows=3, columns=["s"]).count() == 3
    spreadsheets.write_excel(df.where("i < 2"), f"file://{tmp_path}/y.xlsx")
    assert spreadsheets.read_excel(spark, f"file://{tmp_path}/[xy].xlsx").count() == 14
