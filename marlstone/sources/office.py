"""Text of office files (docx, pptx, xlsx) from their XML."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# The built-in number formats of sheets that show dates or times.
DATE_FORMATS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]
OFFICE = [".docx", ".pptx", ".xlsx", ".xlsm"]
SCHEMA = "path string, sha256 string, parser string, status string, text string, complete boolean, warning string"
MAX_PART = 128 << 20


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > MAX_PART:
        raise ValueError("part too large")
    return ElementTree.fromstring(z.read(name))


def _paragraphs(root: ElementTree.Element) -> list[str]:
    found = ("".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in root.iter() if _tag(p) == "p")
    return [x for x in found if x.strip()]


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def extract(extension: str, raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if extension == ".docx":
            return "\n".join(_paragraphs(_part(z, "word/document.xml")))
        if extension == ".pptx":
            slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
            return "\n".join(line for n in slides for line in (f"[幻灯片 {_number(n)}]", *_paragraphs(_part(z, n))))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in _part(z, "xl/sharedStrings.xml") if _tag(s) == "si"]
        rows = []
        for n in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number):
            for row in (e for e in _part(z, n).iter() if _tag(e) == "row"):
                cells = []
                for c in (e for e in row if _tag(e) == "c"):
                    value = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                rows.append("\t".join(cells))
        return "\n".join(rows)


def _active_sheet(z: zipfile.ZipFile) -> str:
    """The part that holds the sheet shown first."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        book = _part(z, "xl/workbook.xml")
        active = next((int(e.get("activeTab", 0)) for e in book.iter() if _tag(e) == "workbookView"), 0)
        sheets = [next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in book.iter() if _tag(e) == "sheet"]
        targets = {e.get("Id"): e.get("Target", "") for e in _part(z, "xl/_rels/workbook.xml.rels")}
        if sheets:
            return posixpath.normpath(posixpath.join("/xl", targets[sheets[min(active, len(sheets) - 1)]])).lstrip("/")
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = _part(z, "xl/styles.xml")
    codes = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _tag(e) == "numFmt"}
    dated = {i for i, code in codes.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", code.lower()))} | set(DATE_FORMATS)
    formats = [int(x.get("numFmtId", 0)) for e in root if _tag(e) == "cellXfs" for x in e]
    return {i for i, n in enumerate(formats) if n in dated}


def _place(reference: str | None, after: int) -> int:
    """Column number, from 0, of a reference such as AB12; without one, the next."""
    if not reference:
        return after
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(c: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    value = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
    kind = c.get("t")
    if not value or kind == "e":
        return value or None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind in (None, "n") and int(c.get("s", 0)) in dates:
        whole = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(float(value) * 86400))
        return whole.isoformat(" ")
    return value


def sheet_rows(raw: bytes) -> Iterator[list]:
    """Rows of the active sheet, with the values that the file holds; null for empty cells. Rows are read one at a time."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in _part(z, "xl/sharedStrings.xml") if _tag(s) == "si"]
        dates = _date_styles(z)
        with z.open(_active_sheet(z)) as part:
            for _, e in ElementTree.iterparse(part):
                if _tag(e) == "row":
                    row: list[str | None] = []
                    for c in (x for x in e if _tag(x) == "c"):
                        place = _place(c.get("r"), len(row))
                        row += [None] * (place + 1 - len(row))
                        row[place] = _cell(c, shared, dates)
                    e.clear()
                    yield row


def office_text(files: DataFrame) -> DataFrame:
    """files: path, sha256, extension, content. A broken file has the status failed and a warning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    rows.append((r.path, r.sha256, r.extension[1:], "completed", extract(r.extension, bytes(r.content)), True, None))
                except Exception as x:
                    rows.append((r.path, r.sha256, r.extension[1:], "failed", "", False, type(x).__name__))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "sha256", "extension", "content").mapInPandas(run, SCHEMA)
