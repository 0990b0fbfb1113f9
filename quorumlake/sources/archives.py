"""Readers for zipped formats: whole files through ``binaryFile``, unpacked in tasks."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import ids


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole files; the readers below take such rows."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zipped_csv(found: DataFrame) -> DataFrame:
    """member, row, record (JSON with sorted keys), id and name of every row of every CSV in zip files (SRC-01)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if n.endswith(".csv")):
                        rows = csv.DictReader(io.TextIOWrapper(z.open(member), "utf-8-sig"))
                        yield pd.DataFrame([(member, i, json.dumps(r, sort_keys=True, ensure_ascii=False)) for i, r in enumerate(rows)], columns=["member", "row", "record"])

    rows = found.select("path", "content").mapInPandas(run, "member string, row int, record string")
    key = F.concat_ws(":", "member", F.col("row").cast("string"), "record")
    return rows.withColumns({"id": ids.stable_id("row", key), "name": F.substring(F.sha2(key, 256), 1, 24)})


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_rows(found: DataFrame, first_row: int = 1) -> DataFrame:
    """path, row, cells of the first sheet; inline and shared strings (SRC-07)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
                    sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
                out = []
                for row in sheet.iter(f"{_SHEET}row"):
                    cells: dict[int, str] = {}
                    for c in row.iter(f"{_SHEET}c"):
                        text = "".join(t.text or "" for t in c.iter() if t.tag in (f"{_SHEET}t", f"{_SHEET}v"))
                        cells[_column(c.get("r", "A"))] = shared[int(text)] if c.get("t") == "s" else text
                    if int(row.get("r", "0")) >= first_row:
                        out.append((name, int(row.get("r", "0")), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]))
                yield pd.DataFrame(out, columns=["path", "row", "cells"])

    return found.select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def docx_blocks(found: DataFrame) -> DataFrame:
    """path, place, text of paragraphs and table rows, cells joined by a padded bar (SRC-08)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
                words = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
                blocks = []
                for e in body if body is not None else []:
                    if e.tag == f"{_WORD}p":
                        blocks.append(words(e))
                    elif e.tag == f"{_WORD}tbl":
                        blocks += [" | ".join(words(c) for c in r.iter(f"{_WORD}tc")) for r in e.iter(f"{_WORD}tr")]
                kept = [b for b in blocks if b.strip()]
                yield pd.DataFrame({"path": name, "place": range(len(kept)), "text": kept})

    return found.select("path", "content").mapInPandas(run, "path string, place int, text string")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, length of files, for a manifest (SNK-07)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
