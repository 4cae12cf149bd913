"""Spreadsheets (.xlsx) as tables, read where the files lie; a sheet's rows are streamed from its XML."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])


def _column(reference: str) -> int:
    """The number of a cell's column, from 0: A1, B1, .., AA1."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ET.Element | None) -> str:
    """Text of an entry, without its phonetic readings."""
    return "" if node is None else "".join(t.text or "" for part in ([node] if node.tag.endswith("}is") or node.tag.endswith("}si") else []) for t in part.iter(f"{MAIN}t"))


def read_workbook(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells as text) of all sheets; an empty cell is null."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = [_text(x) for x in ET.parse(book.open("xl/sharedStrings.xml")).getroot().iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
    places = {r.get("Id"): r.get("Target") for r in ET.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    for sheet in ET.parse(book.open("xl/workbook.xml")).getroot().iter(f"{MAIN}sheet"):
        target = places[sheet.get(LINK)]
        for _, row in ET.iterparse(book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}")):
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str | None] = []
            for c in row.iter(f"{MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value, kind = c.findtext(f"{MAIN}v"), c.get("t")
                cells[at] = shared[int(value)] if kind == "s" and value else _text(c.find(f"{MAIN}is")) if kind == "inlineStr" else value
            yield sheet.get("name"), int(row.get("r") or 0), cells
            row.clear()


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of every sheet of the workbooks at path; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = []
                for found in read_workbook(data.as_py()):
                    part.append({"path": name, "sheet": found[0], "row": found[1], "cells": found[2]})
                    if len(part) == 10_000:
                        yield pa.RecordBatch.from_pylist(part, ROWS)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, ROWS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").endswith(".xlsx"))
    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row int, cells array<string>")


def table(rows: DataFrame, sheet: str, header: int = 1) -> DataFrame:
    """One sheet of ``sheets`` as a table of text: names (trimmed) from the header row of each workbook, rows below it; a name is null where its cell is.

    Every workbook has a header of its own, joined to its rows by path; columns are those of all headers, null where a workbook lacks them. The
    distinct names come to the driver. Rows of empty cells are left out; of two columns of one name in a workbook the first counts.
    """
    mine = rows.where(F.col("sheet") == sheet)
    cell = F.struct(F.trim(F.col("name")).alias("name"), F.col("i").alias("i"))
    heads = mine.where(F.col("row") == header).select("path", F.posexplode("cells").alias("i", "name")).where("trim(name) <> ''").select("path", cell.alias("c"))
    names = [r[0] for r in heads.groupBy(F.col("c.name").alias("name")).agg(F.min(F.struct("path", "c.i")).alias("at")).orderBy("at").select("name").collect()]
    if not names:
        raise ValueError(f"no row {header} in sheet {sheet}")
    places = heads.groupBy("path", F.col("c.name").alias("name")).agg(F.min("c.i").alias("i")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "i"))).alias("at"))
    data = mine.where((F.col("row") > header) & F.exists("cells", lambda c: c.isNotNull())).join(places, "path")
    return data.select(*(F.get("cells", F.try_element_at("at", F.lit(n))).alias(n) for n in names))
