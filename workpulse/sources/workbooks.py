"""Grids from workbooks (XLSX, XLSM), read with the standard library: each sheet is a table.

A workbook is a zip of XML, for which Spark has no reader; files come from ``spark.read.format("binaryFile")`` and are
read by the tasks that hold them. Dates become ISO text, links come with their cells, formulas with their results.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Numbers of the built-in formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 22, *range(27, 37), *range(45, 48), *range(50, 59)}
SCHEMA = "document_id string, table_index int, sheet string, row_index int, cells array<struct<text:string,href:string>>"
_ARROW = pa.schema([("document_id", pa.string()), ("table_index", pa.int32()), ("sheet", pa.string()), ("row_index", pa.int32()), ("cells", pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())])))])


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element | None) -> str:
    return "" if node is None else " ".join("".join(t.text or "" for t in node.iter(f"{_MAIN}t")).split())


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search("[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _links(book: zipfile.ZipFile, path: str, sheet: ElementTree.Element) -> dict[str, str]:
    folder, name = path.rsplit("/", 1)
    related = f"{folder}/_rels/{name}.rels"
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read(related))} if related in book.namelist() else {}
    return {h.get("ref", ""): targets.get(h.get(f"{_REL}id"), "") for h in sheet.iter(f"{_MAIN}hyperlink")}


def sheets_of(content: bytes) -> list[tuple[str, list[list[tuple[str, str]]]]]:
    """(name, rows of (text, href)) of each sheet with two rows or more; rows without text are left out. None if the
    content is no workbook."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        related = {r.get("Id"): r.get("Target", "").removeprefix("/xl/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    dates = _date_styles(book)
    first_day = datetime.date(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in root.iter(f"{_MAIN}workbookPr")) else datetime.date(1899, 12, 30)
    found = []
    for sheet in root.iter(f"{_MAIN}sheet"):
        path = f"xl/{related.get(sheet.get(f'{_REL}id'), '')}"
        if path not in book.namelist():
            continue
        page = ElementTree.fromstring(book.read(path))
        links, rows = _links(book, path, page), []
        for row in page.iter(f"{_MAIN}row"):
            cells: list[tuple[str, str]] = []
            for c in row.iter(f"{_MAIN}c"):
                value, kind, reference = c.findtext(f"{_MAIN}v") or "", c.get("t", "n"), c.get("r", "")
                if kind == "s":
                    value = shared[int(value)] if value else ""
                elif kind == "inlineStr":
                    value = _text(c.find(f"{_MAIN}is"))
                elif kind == "n" and value and int(c.get("s", 0)) in dates:
                    value = (first_day + datetime.timedelta(days=int(float(value)))).isoformat()
                elif kind == "n" and re.fullmatch(r"-?\d+\.0+", value):
                    value = value.split(".")[0]
                at = _column(reference) if reference else len(cells)
                cells += [("", "")] * (at - len(cells))
                url = re.search(r"https?://\S+", value)
                cells.append((value, links.get(reference) or (url[0] if url else "")))
            if any(t for t, _ in cells):
                rows.append(cells)
        if len(rows) >= 2:
            found.append((sheet.get("name", ""), rows))
    return found


def read_workbooks(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Grid rows of workbook files; what can't be read gives none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = [(key, t, name, r, [{"text": x, "href": h} for x, h in cells]) for t, (name, table) in enumerate(sheets_of(content or b"")) for r, cells in enumerate(table)]
                columns = list(zip(*rows)) or [[]] * len(_ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return files.select(id_col, content_col).mapInArrow(read, SCHEMA)
