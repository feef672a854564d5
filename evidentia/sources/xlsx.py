"""Workbooks as grids: cells of .xlsx files, read by Spark's binary source and unpacked in batches.

Spark opens the files (any store it can reach); a workbook is a zip of XML
parts, parsed one file at a time. Only values are read: shared and inline
strings, numbers and booleans."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, table_id int, sheet string, row long, cells array<string>"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def unpack(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """table_id, sheet, row, cells of a workbook, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]
        for i, sheet in enumerate(sheets, 1):
            part = f"xl/worksheets/sheet{i}.xml"
            if part not in names:
                continue
            for row in ElementTree.fromstring(z.read(part)).iter(f"{{{_NS['m']}}}row"):
                cells: list[str] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r", "A"))
                    cells += [""] * (at + 1 - len(cells))
                    v = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                yield i, sheet, int(row.get("r", 0)), cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, table_id, sheet, row, cells of all workbooks under ``path``; a file that is no workbook gives no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path_, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = [(path_, *r) for r in unpack(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                yield pd.DataFrame(rows, columns=["path", "table_id", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
