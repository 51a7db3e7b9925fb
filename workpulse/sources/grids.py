"""Reports as grids: tables of HTML bodies, and pipe, tab and comma separated text, read to rows of cells.

The scan is a map over documents with nothing shuffled; a document's tables stay in its task. Reading markup is the
one part that expressions can't do, so it is the only part in Python.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workbooks import sheets_of

#: Columns that one cell may span, at most; larger spans are typing errors.
MOST_SPAN = 50
_RULE = re.compile(r"^[\s|:+=-]*$")
_CELL = pa.struct([("text", pa.string()), ("href", pa.string())])
_SCHEMA = pa.schema([("document_id", pa.string()), ("table_index", pa.int32()), ("source", pa.string()), ("rows", pa.list_(pa.list_(_CELL)))])
TABLE_SQL = "document_id string, table_index int, source string, rows array<array<struct<text:string,href:string>>>"
#: Documents that are read at once, and bytes of theirs, but for one that is larger.
MOST_DOCUMENTS, MOST_BYTES = 512, 4 * 1024 * 1024

Row = list[tuple[str, str]]


class _Tables(HTMLParser):
    """Collects the tables, an inner one as a table of its own; unclosed cells and rows end where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[int, list[list[tuple[str, str, int, int]]]]] = []
        self.open: list[dict] = []
        self.opened = 0
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.open.append({"at": self.opened, "rows": [], "cell": None})
            self.opened += 1
        elif self.open:
            top = self.open[-1]
            if tag in ("tr", "td", "th"):
                self._end_cell(top)
                if tag == "tr" or not top["rows"]:
                    top["rows"].append([])
                if tag != "tr":
                    span = lambda name: int(given[name]) if (given.get(name) or "").isdigit() and 0 < int(given[name]) <= MOST_SPAN else 1
                    top["cell"] = {"text": [], "href": "", "spans": (span("colspan"), span("rowspan"))}
            elif top["cell"]:
                if tag == "a" and given.get("href") and not top["cell"]["href"]:
                    top["cell"]["href"] = given["href"]
                elif tag in ("br", "p", "div", "li"):
                    top["cell"]["text"].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open and tag in ("td", "th", "tr"):
            self._end_cell(self.open[-1])
        elif self.open and tag == "table":
            self._end_table()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] and not self.hidden:
            self.open[-1]["cell"]["text"].append(data)

    def _end_cell(self, top):
        if cell := top["cell"]:
            top["rows"][-1].append((" ".join("".join(cell["text"]).split()), cell["href"], *cell["spans"]))
            top["cell"] = None

    def _end_table(self):
        top = self.open.pop()
        self._end_cell(top)
        self.done.append((top["at"], top["rows"]))

    def tables(self) -> list[list[Row]]:
        while self.open:
            self._end_table()
        return [grid for _, rows in sorted(self.done, key=lambda t: t[0]) if (grid := spread(rows))]


def spread(rows: list[list[tuple[str, str, int, int]]]) -> list[Row]:
    """Cells at their columns: a spanning cell's text stands in each column and row that it spans."""
    held: dict[int, tuple[str, str, int]] = {}
    out = []
    for cells in rows:
        row: Row = []
        waiting = iter(cells)
        cell = next(waiting, None)
        while cell is not None or len(row) in held:
            if len(row) in held:
                text, href, left = held.pop(len(row))
                if left > 1:
                    held[len(row)] = (text, href, left - 1)
                row.append((text, href))
                continue
            text, href, across, down = cell
            for _ in range(across):
                if down > 1:
                    held[len(row)] = (text, href, down - 1)
                row.append((text, href))
            cell = next(waiting, None)
        if row:
            out.append(row)
    return out


def piped(text: str, least: int = 2) -> list[list[Row]]:
    """Runs of lines with ``least`` pipes or more; rules of dashes are dropped. Whether outer pipes enclose the cells
    is decided by a run's first line."""
    found: list[list[Row]] = []
    run: list[str] = []
    for line in [*text.splitlines(), ""]:
        if line.count("|") >= least:
            run.append(line.strip())
            continue
        lines = [x for x in run if not _RULE.match(x)]
        if lines:
            first, last = lines[0].startswith("|"), lines[0].endswith("|")
            cut = [x[first and x.startswith("|") :][: -1 if last and x.endswith("|") else None] for x in lines]
            found.append([[(c.strip(), "") for c in x.split("|")] for x in cut])
        run = []
    return found


def delimited(text: str, delimiter: str | None = None) -> list[Row]:
    """Rows of quoted, delimited text without its byte-order mark and blank rows; the delimiter is the one that the
    first five lines hold most, comma if none."""
    text = text.removeprefix("﻿")
    head = "\n".join(text.splitlines()[:5])
    delimiter = delimiter or max(",\t;|", key=head.count)
    csv.field_size_limit(1 << 30)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    return [[(c.strip(), "") for c in r] for r in rows if any(c.strip() for c in r)]


def decoded(content: bytes) -> str:
    """The text of a file: UTF-16 by its mark, else UTF-8, else Latin 1; nothing if it holds zero bytes, as no text does."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    if b"\0" in content:
        return ""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def tables_of(html: str | None, text: str | None, name: str | None = None, content: bytes | None = None) -> list[tuple[str, list[Row]]]:
    """(source, grid) of a document: the sheets or the one table of its file, else its HTML tables, else what its text
    holds. A name that ends in .csv or .tsv says that the text is one table."""
    if content is not None:
        if content[:2] == b"PK":
            return [("workbook", rows) for _, rows in sheets_of(content)]
        return [("delimited", rows)] if (rows := delimited(decoded(content))) else []
    if html and "<t" in html.lower():
        parser = _Tables()
        parser.feed(html)
        parser.close()
        if found := parser.tables():
            return [("html", t) for t in found]
    if not text:
        return []
    if (name or "").lower().endswith((".csv", ".tsv")):
        return [("delimited", rows)] if (rows := delimited(text)) else []
    if found := piped(text):
        return [("pipe", t) for t in found]
    lines = "\n".join(x for x in text.splitlines() if "\t" in x or x.strip())
    return [("tab", rows)] if lines.count("\t") >= 2 and (rows := delimited(lines, "\t")) else []


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of ``MOST_DOCUMENTS`` rows and ``MOST_BYTES`` at most, one row at least."""
    sizes = [0] * batch.num_rows
    for column in batch.columns:
        sizes = [n + (x or 0) for n, x in zip(sizes, pc.binary_length(column).to_pylist())]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= MOST_DOCUMENTS or held + n > MOST_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def read_tables(documents: DataFrame, failures: bool = False) -> DataFrame:
    """One row for each table of ``documents`` (document_id, and any of html, text, attachment_name and content, the bytes
    of a workbook or of a delimited file), with its ``rows`` of cells in order.

    Nulls and documents without a table give no rows. With ``failures`` a document that can't be read gives one row of
    table -1 whose source says why; without, it fails the job.
    """
    column = lambda c: (F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string")).alias(c)
    content = [F.col("content").cast("binary")] if "content" in documents.columns else []
    rows = documents.select(F.col("document_id").cast("string").alias("document_id"), *map(column, ("html", "text", "attachment_name")), *content)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                keys, places, sources, table_ends, row_ends, texts, hrefs = [], [], [], [0], [0], [], []
                for key, *given in zip(*(c.to_pylist() for c in piece.columns)):
                    try:
                        tables = list(enumerate(tables_of(*given)))
                    except Exception as e:  # whatever a document holds, others are read
                        if not failures:
                            raise
                        tables = [(-1, (f"{type(e).__name__}: {e}"[:500], [[]]))]
                    for t, (source, grid) in tables:
                        for cells in grid:
                            for text, href in cells:
                                texts.append(text)
                                hrefs.append(href)
                            row_ends.append(len(texts))
                        keys.append(key)
                        places.append(t)
                        sources.append(source)
                        table_ends.append(len(row_ends) - 1)
                cells = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(hrefs, pa.string())], fields=list(_CELL))
                found = pa.ListArray.from_arrays(pa.array(table_ends, pa.int32()), pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), cells))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(sources, pa.string()), found.cast(_SCHEMA.field("rows").type)], schema=_SCHEMA)

    return rows.mapInArrow(read, TABLE_SQL)


def grid_rows(tables: DataFrame) -> DataFrame:
    """The rows of ``read_tables`` as one row each: document_id, table_index, row_index, source, cells."""
    return tables.select("document_id", "table_index", "source", F.posexplode("rows").alias("row_index", "cells")).select("document_id", "table_index", "row_index", "source", "cells")


def read_grids(documents: DataFrame, failures: bool = False) -> DataFrame:
    """``read_tables`` by row."""
    return grid_rows(read_tables(documents, failures))
