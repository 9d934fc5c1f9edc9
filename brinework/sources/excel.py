"""Excel workbooks (.xlsx) in and out. Files are read by Spark's ``binaryFile`` source, so from any store it knows; each task
unzips its workbooks and reads their sheets row by row. A workbook is one row, so a large input is one of many workbooks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from decimal import Decimal
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet, as the format has it.
SHEET_ROWS = 1_048_576

# The number formats without a code of their own that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}

_CELLS = "path string, sheet string, row long, first boolean, cells array<struct<kind: string, text: string>>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(book: zipfile.ZipFile, name: str, *wanted: str) -> Iterator:
    """Each ``wanted`` element of a part once it is whole; what was read is let go."""
    if name not in book.namelist():
        return
    with book.open(name) as part:
        for _, e in iterparse(part):
            if _local(e.tag) in wanted:
                yield e
                e.clear()


def _text(e) -> str:
    """The text of a string item: its runs one after the other, without phonetic ones."""
    parts = []
    for child in e:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(parts)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    codes, styles = {}, set()
    for e in _elements(book, "xl/styles.xml", "numFmt", "cellXfs"):
        if _local(e.tag) == "numFmt":
            codes[int(e.get("numFmtId"))] = e.get("formatCode") or ""
        else:
            for i, xf in enumerate(e):
                k = int(xf.get("numFmtId") or 0)
                shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", codes.get(k, ""))
                if k in DATE_FORMATS or k in codes and re.search("[dmyhs]", shown, re.IGNORECASE) and shown.lower() != "general":
                    styles.add(i)
    return styles


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, part) of each sheet in order, and whether days count from 1904."""
    targets = {e.get("Id"): e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    sheets, late = [], False
    for e in _elements(book, "xl/workbook.xml", "sheet", "workbookPr"):
        if _local(e.tag) == "workbookPr":
            late = e.get("date1904") in ("1", "true")
        else:
            rel = next(v for k, v in e.attrib.items() if _local(k) == "id")
            target = targets[rel]
            sheets.append((e.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)))
    return sheets, late


def _moment(serial: float, late: bool) -> str:
    """A day number as a timestamp. Day 60 is a 29th of February 1900 that never was, so earlier ones are a day later."""
    days = serial + 1462 if late else serial + 1 if serial < 60 else serial
    return (datetime(1899, 12, 30) + timedelta(milliseconds=round(days * 86_400_000))).isoformat(sep=" ")


def _place(ref: str) -> int:
    """The place of a cell from 0 by the letters of its reference."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _rows(content: bytes, sheet: str | int | None) -> Iterator[tuple[str, int, list]]:
    """(sheet, row, cells) of the rows with cells of one sheet, or of all. A cell is (kind, text) or null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        sheets, late = _sheets(book)
        for at, (name, part) in enumerate(sheets):
            if sheet is not None and sheet not in (name, at):
                continue
            last = 0
            for e in _elements(book, part, "row"):
                last = int(e.get("r") or last + 1)
                cells: list = []
                for c in e:
                    place = _place(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = _cell(c, strings, dates, late)
                yield name, last, cells


def _cell(c, strings: list[str], dates: set[int], late: bool) -> tuple[str, str] | None:
    kind = c.get("t") or "n"
    if kind == "inlineStr":
        return next((("text", _text(x)) for x in c if _local(x.tag) == "is"), None)
    value = next((x.text for x in c if _local(x.tag) == "v"), None)
    if value is None or kind == "e":  # an error is a missing value
        return None
    if kind == "s":
        return "text", strings[int(value)]
    if kind == "str":
        return "text", value
    if kind == "b":
        return "boolean", "true" if value.strip() == "1" else "false"
    if kind == "d":
        return "date", value.replace("T", " ").rstrip("Z")
    if int(c.get("s") or 0) in dates:
        return "date", _moment(float(value), late)
    return "number", value.strip()


def sheet_rows(books: DataFrame, sheet: str | int | None = 0) -> DataFrame:
    """(path, sheet, row, first, cells) of the rows of one sheet, by its name or its place from 0, or of all, of each workbook in
    ``books`` (path, content); ``first`` marks a sheet's first row. A cell is null, or its kind (number, text, boolean or date) and its value as text."""

    names = ["path", "sheet", "row", "first", "cells"]

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows, seen = [], set()
                for name, row, cells in _rows(content, sheet):
                    rows.append((path, name, row, name not in seen, [c and {"kind": c[0], "text": c[1]} for c in cells]))
                    seen.add(name)
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return books.select("path", "content").mapInPandas(parsed, _CELLS)


def table_of(books: DataFrame, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """A sheet of all workbooks as one table. Names are those in the first row, numbered where they repeat and
    ``Unnamed: <place>`` where there is none; without ``header`` the places from 0. All workbooks must have the same ones.
    A column of whole numbers only is long, of numbers double, of dates timestamp, of booleans boolean, any other text.
    Rows without any value are left out."""
    rows = sheet_rows(books, sheet)
    # one pass: for each place what the first rows name it, and what kinds of values are below
    cell, head = F.col("cell"), F.col("first") & F.lit(header)
    count = lambda hit: F.count_if(~head & hit)
    found = rows.select("first", F.posexplode("cells").alias("at", "cell")).groupBy("at").agg(
        F.collect_set(F.when(head, F.coalesce(cell["text"], F.lit("")))).alias("names"), count(cell["text"].isNotNull()).alias("n"),
        *(count(cell["kind"] == k).alias(k) for k in ("number", "boolean", "date")), count((cell["kind"] == "number") & cell["text"].rlike(r"^[+-]?\d{1,18}$")).alias("whole"),
    )
    places = {r["at"]: r for r in found.collect()}
    if any(len(r["names"]) > 1 for r in places.values()):
        raise ValueError("the workbooks don't have the same header")
    out, used = [], set()
    for i in range(max(places, default=-1) + 1):
        k = places[i]
        base = (k["names"][0] if k["names"] and k["names"][0] else f"Unnamed: {i}") if header else str(i)
        name = next(n for n in (base, *(f"{base}.{j}" for j in range(1, len(places) + 1))) if n not in used)
        used.add(name)
        kind = "string" if not k["n"] else "bigint" if k["whole"] == k["n"] else next((t for w, t in (("number", "double"), ("boolean", "boolean"), ("date", "timestamp_ntz")) if k[w] == k["n"]), "string")
        out.append(F.get("cells", F.lit(i))["text"].try_cast(kind).alias(name))
    body = rows.where(~F.col("first")) if header else rows
    return body.where(F.exists("cells", lambda c: c["text"].isNotNull())).select(*out)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """A sheet of a workbook, or of all workbooks of a folder, as one table."""
    return table_of(spark.read.format("binaryFile").load(path), sheet, header)


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_SHEET_ML = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _relations(**targets: tuple[str, str]) -> str:
    links = "".join(f'<Relationship Id="{k}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for k, (kind, target) in targets.items())
    return f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>'


def _parts(sheet: str) -> dict[str, str]:
    """The parts of a workbook of one sheet but the sheet itself; style 1 shows dates."""
    named = {"/xl/workbook.xml": "sheet.main", "/xl/styles.xml": "styles", "/xl/worksheets/sheet1.xml": "worksheet"}
    kinds = "".join(f'<Override PartName="{part}" ContentType="{_SHEET_ML}.{kind}+xml"/>' for part, kind in named.items())
    empty = "".join(f'<{a} count="1"><{b}/></{a}>' for a, b in (("fonts", "font"), ("fills", "fill"), ("borders", "border"), ("cellStyleXfs", "xf")))
    return {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>',
        "_rels/.rels": _relations(r1=("officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(r1=("worksheet", "worksheets/sheet1.xml"), r2=("styles", "styles.xml")),
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}">{empty}<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }


# XML has no other control characters
_NO_XML = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _written(value) -> str:
    if value is None or isinstance(value, float) and value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, float) or isinstance(value, (int, Decimal)) and abs(value) <= 2**53:  # longer numbers would lose digits, and go as text
        return f"<c><v>{value}</v></c>"
    if isinstance(value, date):
        moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        gap = moment.replace(tzinfo=None) - datetime(1899, 12, 30)
        days = gap / timedelta(days=1)
        if days >= 61:  # those before March 1900 go as text
            return f'<c s="1"><v>{gap.days if not gap.seconds and not gap.microseconds else repr(days)}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", str(value)))}</t></is></c>'


def workbooks(df: DataFrame, sheet: str = "Sheet1", rows: int = SHEET_ROWS - 1) -> DataFrame:
    """(path, content): the rows of ``df`` as workbooks, one or more for each partition with at most ``rows`` rows under a
    header. Dates are days, numbers keep their digits, nulls and NaN are empty cells, anything else is text."""
    names = df.columns

    def book(lines: Iterator[str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in _parts(sheet).items():
                z.writestr(name, text)
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
                part.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                part.write(f"<row>{''.join(map(_written, names))}</row>".encode())
                for line in lines:
                    part.write(line.encode())
                part.write(b"</sheetData></worksheet>")
        return out.getvalue()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (f"<row>{''.join(map(_written, r.values()))}</row>" for b in batches for r in b.to_pylist())
        n = 0
        for first in lines:
            def some(first=first):
                yield first
                for _ in range(rows - 1):
                    line = next(lines, None)
                    if line is None:
                        return
                    yield line

            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "content": pa.array([book(some())], pa.binary())})
            n += 1

    made = df.mapInArrow(written, "n int, content binary")
    return made.select(F.format_string("part-%05d-%03d.xlsx", F.spark_partition_id(), "n").alias("path"), "content")


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1", rows: int = SHEET_ROWS - 1) -> None:
    """``df`` as workbooks in the folder ``path``, each put there by its task. A task that runs again writes the same names;
    a whole workbook replaces another at once on stores that do so."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                store, folder = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    workbooks(df, sheet, rows).mapInArrow(put, "n long").agg(F.sum("n")).collect()
