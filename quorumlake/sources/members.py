"""Zip archives as a data source: a partition a member, rows as they are unpacked (SRC-01, SRC-07, SRC-08).

    spark.dataSource.register(Members)
    spark.read.format("zip_members").option("path", folder).option("kind", "csv").schema("archive string, member string, row int, name string").load()

``path`` is a folder that the driver and all executors see, or one archive in
it. A member is read as a stream, so it may be larger than a worker's memory,
and members of one archive are read by different tasks. The schema names what
is wanted: ``archive``, ``member`` and ``row`` are where a row stands, all other
columns are fields of the member (kind ``csv``, missing ones null), ``cells``
(kind ``xlsx``) or ``text`` (kind ``docx``); others are not read out.
"""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Which members a kind reads.
SUFFIX = {"csv": ".csv", "xlsx": "xl/worksheets/sheet1.xml", "docx": "word/document.xml"}


@dataclass
class Member(InputPartition):
    archive: str
    name: str


def _local(path: str) -> str:
    """A mounted folder's path; only ``file:`` and plain paths can be opened by tasks themselves."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"archives are opened by the tasks, so {path!r} must be a folder that all of them mount")
    return unquote(parts.path)


def _csv(z: zipfile.ZipFile, name: str) -> Iterator[dict]:
    with z.open(name) as raw:
        yield from csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))


def _place(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _ended(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of ``tag`` as they end; what has been read is let go."""
    with z.open(name) as raw:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(raw, events=("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == tag:
                yield e
                if parents:
                    parents[-1].remove(e)


def _xlsx(z: zipfile.ZipFile, name: str) -> Iterator[dict]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in _ended(z, "xl/sharedStrings.xml", f"{_SHEET}si")]
    for row in _ended(z, name, f"{_SHEET}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{_SHEET}c"):
            text = "".join(t.text or "" for t in c.iter() if t.tag in (f"{_SHEET}t", f"{_SHEET}v"))
            cells[_place(c.get("r", "A"))] = shared[int(text)] if c.get("t") == "s" else text
        yield {"row": int(row.get("r", "0")), "cells": [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]}


def _docx(z: zipfile.ZipFile, name: str) -> Iterator[dict]:
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    with z.open(name) as raw:
        path: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(raw, events=("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if len(path) == 2 and path[1].tag == f"{_WORD}body":  # a paragraph or a table of the body
                texts = [words(e)] if e.tag == f"{_WORD}p" else [" | ".join(words(c) for c in r.iter(f"{_WORD}tc")) for r in e.iter(f"{_WORD}tr")] if e.tag == f"{_WORD}tbl" else []
                yield from ({"text": t} for t in texts if t.strip())
                path[1].remove(e)


_readers = {"csv": _csv, "xlsx": _xlsx, "docx": _docx}


class MemberReader(DataSourceReader):
    def __init__(self, path: str, kind: str, wanted: list[str]) -> None:
        self.path, self.kind, self.wanted = _local(path), kind, wanted

    def partitions(self) -> list[Member]:
        """Only the archives' directories are read here, not their members."""
        found = [self.path]
        if os.path.isdir(self.path):
            found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if not n.startswith((".", "_")))
        out = []
        for archive in found:
            with zipfile.ZipFile(archive) as z:
                out += [Member(archive, i.filename) for i in z.infolist() if i.filename.endswith(SUFFIX[self.kind]) and not i.is_dir()]
        return out

    def read(self, partition: Member) -> Iterator[tuple]:
        where = {"archive": os.path.basename(partition.archive), "member": partition.name}
        with zipfile.ZipFile(partition.archive) as z:
            for i, fields in enumerate(_readers[self.kind](z, partition.name)):
                row = {"row": i} | fields | where
                yield tuple(row.get(c) for c in self.wanted)


class Members(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        own = {"xlsx": ", cells array<string>", "docx": ", text string"}
        return "archive string, member string, row int" + own.get(self.options.get("kind", "csv"), "")

    def reader(self, schema: StructType) -> MemberReader:
        kind = self.options.get("kind", "csv")
        if kind not in SUFFIX:
            raise ValueError(f"kind is one of {', '.join(SUFFIX)}")
        return MemberReader(self.options["path"], kind, schema.fieldNames())
