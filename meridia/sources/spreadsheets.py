"""Excel workbooks (``.xlsx``): read as files of Spark's own reader, decoded in tasks.

A workbook is a zip archive of XML parts.  Spark lists and reads the files, so
any store that it reaches will do; a task decodes one file at a time and hands
its rows on as they are parsed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet, the header included, that the format allows; rows an Arrow batch takes.
MOST_ROWS, ROWS = 1_048_576, 5_000
#: XML namespaces and paths of the format: fixed values.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DOCUMENT = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_number(cell: str) -> int:
    """Place of a cell's column, from 0: the letters of its reference count in base 26."""
    n = 0
    for c in re.match(r"[A-Z]+", cell)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(place: int) -> str:
    name, place = "", place + 1
    while place:
        place, rest = divmod(place - 1, 26)
        name = chr(65 + rest) + name
    return name


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{MAIN}t"))


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[tuple[str, str] | None]]]:
    """Number and cells of each row of a sheet (the first unless named); a cell is its kind (``n``, ``b`` or ``s``) and text, or None.

    Errors and empty cells are None.  Dates are the numbers Excel holds.  A
    workbook without the sheet is a ``ValueError``.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = [(s.get("name"), s.get(f"{DOCUMENT}id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        found = next((part for name, part in sheets if sheet in (None, name)), None)
        if found is None:
            raise ValueError(f"no sheet {sheet!r}; there are {[name for name, _ in sheets]}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        part = links[found].lstrip("/")
        part = part if part.startswith("xl/") else f"xl/{part}"
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        with book.open(part) as stream:
            number = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[tuple[str, str] | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    place = column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        cells[place] = ("s", _text(cell))
                    elif value is not None and value.text is not None and kind != "e":
                        cells[place] = ("s", shared[int(value.text)]) if kind == "s" else (kind if kind in ("n", "b") else "s", value.text)
                yield number, cells
                row.clear()


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a sheet of one workbook, or of all that ``path`` matches, under the names of the first one's first row.

    A column is ``long`` or ``double`` where all its cells are numbers,
    ``boolean`` where all are truth values, else text.  Rows without a cell are
    left out, cells beyond the header too; a blank header cell names its column
    ``_c`` and its place.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            file, numbers, kinds, texts = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(file), pa.array(numbers, pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))], names=["file", "row", "kinds", "texts"])

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = []
                for number, cells in sheet_rows(content.as_py(), sheet):
                    if any(cells):
                        held.append((file, number, [c and c[0] for c in cells], [c and c[1] for c in cells]))
                    if len(held) >= ROWS:
                        yield out()
                        held = []
                if held:
                    yield out()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(work, "file string, row long, kinds array<string>, texts array<string>")
    head = rows.agg(F.min(F.struct("file", "row", "texts")).alias("head")).first()["head"]
    if head is None:
        raise ValueError(f"no row in {path}")
    names = [n if n else f"_c{i}" for i, n in enumerate(head["texts"])]
    tops = rows.groupBy("file").agg(F.min("row").alias("top"))
    body = rows.join(F.broadcast(tops), "file").where("row > top")
    seen = body.select(*[F.get("kinds", F.lit(i)).alias(f"k{i}") for i in range(len(names))], *[F.get("texts", F.lit(i)).alias(f"t{i}") for i in range(len(names))])
    whole = lambda t: F.col(t).rlike(r"^-?\d{1,18}$")
    facts = [f(F.coalesce(c, F.lit(True))).alias(f"{n}{i}") for i in range(len(names)) for n, f, c in (("n", F.bool_and, F.col(f"k{i}") == "n"), ("w", F.bool_and, whole(f"t{i}")), ("b", F.bool_and, F.col(f"k{i}") == "b"))]
    known = seen.agg(*facts, *[F.count(f"k{i}").alias(f"c{i}") for i in range(len(names))]).first()

    def typed(i: int) -> Column:
        text = F.get("texts", F.lit(i))
        kind = "string"
        if known[f"c{i}"]:
            kind = ("long" if known[f"w{i}"] else "double") if known[f"n{i}"] else "boolean" if known[f"b{i}"] else "string"
        return text.cast(kind).alias(names[i])

    return body.select(*map(typed, range(len(names))))


def _cell(place: int, row: int, value) -> str:
    where = f'r="{column_name(place)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {where} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c {where}><v>{value!r}</v></c>"
    return f'<c {where} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_excel(rows: DataFrame, path: str, sheet: str = "Sheet1", order: list[str] | None = None) -> None:
    """A report as one workbook of one sheet, which the format bounds at ``MOST_ROWS`` rows; more are a ``ValueError``.

    One task writes the XML and zips it; the driver hands the finished file to
    the store.
    """
    if rows.limit(MOST_ROWS).count() >= MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows below its header")
    names = rows.columns
    main, document, package = (n.strip("{}") for n in (MAIN, DOCUMENT, PACKAGE))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
            book.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{document}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{document}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{document}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            with book.open("xl/worksheets/sheet1.xml", "w") as part:
                part.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                number = 1
                part.write(f'<row r="1">{"".join(_cell(i, 1, n) for i, n in enumerate(names))}</row>'.encode())
                for batch in batches:
                    for row in zip(*[c.to_pylist() for c in batch.columns]):
                        number += 1
                        part.write(f'<row r="{number}">{"".join(_cell(i, number, v) for i, v in enumerate(row))}</row>'.encode())
                part.write(b"</sheetData></worksheet>")
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["content"])

    ordered = rows.orderBy(*order) if order else rows
    content = bytes(ordered.coalesce(1).mapInArrow(work, "content binary").first()["content"])
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
