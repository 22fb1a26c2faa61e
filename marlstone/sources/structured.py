"""Tables in files whose bytes can't be trusted: delimited text, JSON, JSON lines and sheets, within bounds.

One task reads one file, which ``files.contents`` has bounded. Bad records are
counted, rows before a broken tail are kept, and what a bound cuts off is named.
"""

from __future__ import annotations

import codecs
import csv
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .office import sheet_rows
from .records import column_names

STRUCTURED = [".csv", ".tsv", ".json", ".jsonl", ".xlsx", ".xlsm"]
MAX_ROWS, MAX_BYTES, MAX_RECORD = 100_000, 256 << 20, 16 << 20
PROBE, BATCH = 1 << 20, 1000
SCHEMA = "path string, row_no long, record map<string,string>, encoding string, parse_errors long, replaced long, reasons array<string>, failure string"
_json = json.JSONDecoder()


def encoding_of(raw: bytes, whole: bool | None = None) -> str:
    """By the byte order mark, else UTF-8, else GB 18030, from the first MiB; UTF-8 where neither fits.

    A character that the end of the probe cuts is no error. whole: whether raw is all of a file.
    """
    head = raw[:PROBE]
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    for name in ("utf-8", "gb18030"):
        try:
            codecs.getincrementaldecoder(name)().decode(head, final=len(head) == len(raw) if whole is None else whole)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


@dataclass
class Notes:
    """What a file's reader has met."""

    encoding: str | None = None
    parse_errors: int = 0
    replaced: int = 0
    reasons: list[str] = field(default_factory=list)
    failure: str | None = None

    def cut(self, reason: str) -> None:
        if reason not in self.reasons:
            self.reasons.append(reason)

    def broken(self, failure: str) -> None:
        self.parse_errors += 1
        self.failure = failure


def _text(raw: bytes, notes: Notes, max_bytes: int) -> str:
    if len(raw) > max_bytes:
        notes.cut("byte_limit")
    notes.encoding = encoding_of(raw)
    text = codecs.getincrementaldecoder(notes.encoding)(errors="replace").decode(raw[:max_bytes], final=len(raw) <= max_bytes)
    notes.replaced = text.count("�")
    return text


def _lines(text: str, notes: Notes, most: int) -> Iterator[str]:
    """Lines with their ends; of a longer one only the first ``most`` characters."""
    at = 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        if end - at > most:
            notes.cut("record_limit")
        yield text[at : min(end, at + most)]
        at = end


def _shown(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _object(value: Any, notes: Notes) -> Iterator[dict]:
    if isinstance(value, dict):
        yield {k: _shown(v) for k, v in value.items()}
    else:
        notes.parse_errors += 1


def _named(rows: Iterator[list], notes: Notes) -> Iterator[dict]:
    """Rows under a header; cells beyond it are dropped, missing ones are null."""
    header = next(rows, None)
    if header is not None:
        names = column_names(header)
        for row in rows:
            if row:
                yield dict(zip(names, [*row, *[None] * (len(names) - len(row))], strict=False))


def _delimited(text: str, separator: str, notes: Notes, max_record: int) -> Iterator[dict]:
    csv.field_size_limit(max(max_record, 1) + 1)
    try:
        yield from _named(csv.reader(_lines(text, notes, max_record), delimiter=separator), notes)
    except csv.Error as x:
        notes.broken(str(x))


def _json_lines(text: str, notes: Notes, max_record: int) -> Iterator[dict]:
    for line in _lines(text, notes, max_record):
        if line.strip():
            try:
                value = json.loads(line)
            except ValueError:
                notes.parse_errors += 1
                continue
            yield from _object(value, notes)


def _after(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\r\n﻿":
        at += 1
    return at


def _json_document(text: str, notes: Notes, max_record: int) -> Iterator[dict]:
    """Objects of the outer array, or one object; members of other kinds are errors, and an error ends the reading."""
    at = _after(text, 0)
    if at == len(text):
        return
    many = text[at] == "["
    at = _after(text, at + many)
    if many and text[at : at + 1] == "]":
        at += 1
    else:
        while True:
            try:
                value, end = _json.raw_decode(text, at)
            except (ValueError, RecursionError) as x:
                return notes.broken(f"unreadable value at character {at}: {type(x).__name__}")
            if end - at > max_record:
                notes.cut("record_limit")
                return notes.broken(f"value at character {at} is longer than {max_record} characters")
            yield from _object(value, notes)
            at = _after(text, end)
            if not many:
                break
            mark, at = text[at : at + 1], at + 1
            if mark == "]":
                break
            if mark != ",":
                return notes.broken(f"no comma or end at character {at - 1}")
            at = _after(text, at)
    if _after(text, at) < len(text):
        notes.broken(f"more text after the end, from character {at}")


def _rows(extension: str, raw: bytes, notes: Notes, max_bytes: int, max_record: int) -> Iterator[dict]:
    if extension in (".xlsx", ".xlsm"):
        if len(raw) > max_bytes:
            notes.cut("byte_limit")
            notes.failure = "too large"
            return iter(())
        return _named(sheet_rows(raw), notes)
    text = _text(raw, notes, max_bytes)
    if extension == ".json":
        return _json_document(text, notes, max_record)
    if extension == ".jsonl":
        return _json_lines(text, notes, max_record)
    return _delimited(text, "\t" if extension == ".tsv" else ",", notes, max_record)


def structured_records(files: DataFrame, *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_record: int = MAX_RECORD) -> DataFrame:
    """files: path, extension, content. Rows (row_no from 1, record) and, after them, one row of notes for each file (row_no null).

    A file without content, or one that can't be opened, has its row of notes
    with a failure. Files of other types are left out.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def read(path: str, extension: str, raw: bytes | None) -> Iterator[tuple]:
        notes, n = Notes(), 0
        try:
            if raw is None:
                notes.failure = "no content"
            else:
                for record in _rows(extension, bytes(raw), notes, max_bytes, max_record):
                    if n == max_rows:
                        notes.cut("row_limit")
                        break
                    n += 1
                    yield path, n, record, None, None, None, None, None
        except Exception as x:  # one bad file must not fail the job
            notes.broken(type(x).__name__)
        yield path, None, None, notes.encoding, notes.parse_errors, notes.replaced, notes.reasons, notes.failure

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for path, extension, raw in zip(batch["path"], batch["extension"], batch["content"], strict=True):
                for row in read(path, extension, raw):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=names).astype({c: "Int64" for c in ("row_no", "parse_errors", "replaced")})
                        held = []
        yield pd.DataFrame(held, columns=names).astype({c: "Int64" for c in ("row_no", "parse_errors", "replaced")})

    chosen = files.filter(F.col("extension").isin(STRUCTURED)).select("path", "extension", "content")
    return chosen.mapInPandas(run, SCHEMA)


def record_ledger(found: DataFrame) -> DataFrame:
    """One row for each file: rows, encoding, parse_errors, replaced, bytes (where the reader tells), reasons, failure, status (completed, partial, failed)."""
    one = lambda c: F.max(c).alias(c)
    told = [c for c in ("encoding", "parse_errors", "replaced", "read_bytes", "source_bytes", "reasons", "failure") if c in found.columns]
    out = found.groupBy("path").agg(F.count("row_no").alias("rows"), *map(one, told))
    faulty = F.col("failure").isNotNull() | (F.size("reasons") > 0) | (F.col("parse_errors") > 0)
    return out.withColumn("status", F.when((F.col("rows") == 0) & F.col("failure").isNotNull(), "failed").when(faulty, "partial").otherwise("completed"))
