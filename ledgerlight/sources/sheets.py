"""Workbooks without a spreadsheet library: an .xlsx file is a zip of XML parts (survey S2, S5, K7)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# Name spaces of the format, and the rows that a sheet can hold.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS = 1 << 20
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="%s" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def chosen_sheet(names: list[str]) -> str:
    """The sheet called Schedule A-1 in any spelling, else the first."""
    if not names:
        raise ValueError("the workbook is empty")
    return next((n for n in names if re.sub("[^a-z0-9]", "", n.lower()) == "schedulea1"), names[0])


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _place(reference: str) -> int:
    """Column number of a cell such as AB12."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a workbook's sheet (the chosen one by default) as texts; missing cells are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        named = {s.get("name"): targets[s.get(LINKED)] for s in book.iter(f"{MAIN}sheet")}
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open(f"xl/{named[sheet or chosen_sheet(list(named))]}") as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != f"{MAIN}row":
                    continue
                row: list[str | None] = []
                for cell in node.iter(f"{MAIN}c"):
                    at = _place(cell.get("r") or "") if cell.get("r") else len(row)
                    value = cell.find(f"{MAIN}v")
                    kind = cell.get("t")
                    text = _text(cell) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                    row += [None] * (at + 1 - len(row))
                    row[at] = text
                node.clear()
                yield row


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A workbook's sheet, first row as header; a sheet holds MOST_ROWS rows at most and is read in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = list(enumerate(rows_of(content, sheet)))
                yield pd.DataFrame({"no": [i for i, _ in rows], "cells": [r for _, r in rows]})

    cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "no int, cells array<string>")
    head = cells.filter("no = 0").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    titles = [c if c else f"Unnamed: {i}" for i, c in enumerate(head["cells"])]
    return cells.filter("no > 0").select("no", *(F.try_element_at("cells", F.lit(i + 1)).alias(t) for i, t in enumerate(titles))).drop("no")


def write(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """K7: a workbook with one sheet of texts, header first; more rows than a sheet holds are an error."""
    spark = df.sparkSession
    if df.limit(MOST_ROWS).count() >= MOST_ROWS:
        raise ValueError("more rows than a sheet holds")
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if v is not None else "<c/>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, text.replace("%s", escape(sheet, {'"': "&quot;"})))
        with z.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
            for row in [tuple(df.columns)]:
                part.write(f"<row>{''.join(map(cell, row))}</row>".encode())
            for row in texts.toLocalIterator(True):
                part.write(f"<row>{''.join(map(cell, row))}</row>".encode())
            part.write(b"</sheetData></worksheet>")
    files.write(spark, path, buffer.getvalue())
