"""Tables in files as a data source: ``spark.read.format("bounded_tables").load(folder)``.

A task opens its files itself and reads them as streams, 64 KiB at a time, so a
file is never held as a whole, however large it is: what a task holds is one record,
which ``max_record`` bytes bound, and one batch of rows. A longer record is named,
passed over, and the reading goes on behind it. Small files share a task.

Options: ``max_rows``, ``max_bytes`` (of one file), ``max_record`` (bytes of one
record), ``split_bytes`` (files of one task), ``extensions``, ``lines`` (extensions
whose files are JSON lines, as Spark writes them under .json). Each file gives its
rows (row_no from 1, record) and one row of notes (row_no null): encoding, errors,
replaced characters, bytes read and there, which bounds have cut, and what failed.
``structured.record_ledger`` makes the notes a status.

Sheets are zip files with their directory at the end; they are read as a whole up
to ``max_bytes`` and refused beyond it. UTF-16 is passed on as UTF-8, in which its
records are measured. Files come from any store that pyarrow opens.
"""

from __future__ import annotations

import codecs
import csv
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .structured import MAX_BYTES, MAX_RECORD, MAX_ROWS, PROBE, STRUCTURED, Notes, _named, _shown, encoding_of, sheet_rows

SCHEMA = "path string, row_no long, record map<string,string>, encoding string, parse_errors long, replaced long, read_bytes long, source_bytes long, reasons array<string>, failure string"
ARROW = pa.schema([("path", pa.string()), ("row_no", pa.int64()), ("record", pa.map_(pa.string(), pa.string())), ("encoding", pa.string()), ("parse_errors", pa.int64()), ("replaced", pa.int64()), ("read_bytes", pa.int64()), ("source_bytes", pa.int64()), ("reasons", pa.list_(pa.string())), ("failure", pa.string())])
PIECE = 64 << 10
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
SPLIT = 64 << 20
#: What matters to where a JSON value ends, outside and inside of quotes.
MARKS, QUOTED = re.compile(r'["\\\[\]{},]'), re.compile(r'["\\]')
BLANKS = " \t\r\n﻿"


class Pieces:
    """A file's bytes in pieces, within a budget; UTF-16 as UTF-8."""

    def __init__(self, raw: BinaryIO, notes: Notes, max_bytes: int):
        self.raw, self.notes, self.left, self.read, self.cut = raw, notes, max_bytes, 0, False
        head = b""
        while len(head) < min(PROBE, max_bytes) and (piece := self._next()):
            head += piece
        self.head = head
        notes.encoding = encoding_of(head, len(head) < PROBE and not self.cut)
        self.codec = {"utf-8-sig": "utf-8", "utf-16": "utf-8"}.get(notes.encoding, notes.encoding)

    def _next(self) -> bytes:
        piece = self.raw.read(min(PIECE, self.left))
        self.left -= len(piece)
        self.read += len(piece)
        if not self.left and not self.cut and self.raw.read(1):
            self.cut = True
            self.notes.cut("byte_limit")
        return piece

    def __iter__(self) -> Iterator[bytes]:
        first = self.head.removeprefix(codecs.BOM_UTF8)
        self.head = b""
        if self.notes.encoding != "utf-16":
            yield first
            while piece := self._next():
                yield piece
            return
        decoder = codecs.getincrementaldecoder("utf-16")(errors="replace")
        yield decoder.decode(first).encode("utf-8", "replace")
        while piece := self._next():
            yield decoder.decode(piece).encode("utf-8", "replace")
        if not self.cut:
            yield decoder.decode(b"", True).encode("utf-8", "replace")

    def text(self, raw: bytes, *, whole: bool = True) -> str:
        """whole: false where the budget cuts the bytes, so that half a character at the end is no error."""
        out = codecs.getincrementaldecoder(self.codec)(errors="replace").decode(raw, final=whole)
        self.notes.replaced += out.count("�")
        return out


def lines(pieces: Pieces, max_record: int) -> Iterator[str]:
    """Lines with their ends. Of a longer one the first ``max_record`` bytes are handed on, and the rest is passed over."""
    held, passing = bytearray(), False
    for piece in pieces:
        at = 0
        while at < len(piece):
            end = piece.find(b"\n", at) + 1
            part = piece[at : end or len(piece)]
            at += len(part)
            if not passing:
                held += part
                if len(held) > max_record:
                    pieces.notes.cut("record_limit")
                    yield pieces.text(bytes(held[:max_record]), whole=False)
                    held, passing = bytearray(), True
            if end:
                if not passing:
                    yield pieces.text(bytes(held))
                held, passing = bytearray(), False
    if held:
        yield pieces.text(bytes(held), whole=not pieces.cut)


def delimited(pieces: Pieces, separator: str, max_record: int) -> Iterator[dict]:
    csv.field_size_limit(max(max_record, 1) + 1)
    try:
        yield from _named(csv.reader(lines(pieces, max_record), delimiter=separator), pieces.notes)
    except csv.Error as x:
        pieces.notes.broken(str(x))


def json_lines(pieces: Pieces, max_record: int) -> Iterator[dict]:
    for line in lines(pieces, max_record):
        if line.strip():
            try:
                value = json.loads(line)
            except (ValueError, RecursionError):
                pieces.notes.parse_errors += 1
                continue
            yield from _record(value, pieces.notes)


def _record(value: Any, notes: Notes) -> Iterator[dict]:
    if isinstance(value, dict):
        yield {k: _shown(v) for k, v in value.items()}
    else:
        notes.parse_errors += 1


class Values:
    """The texts of a JSON document's members, one at a time; where one ends is found without decoding it."""

    def __init__(self, pieces: Pieces, max_record: int):
        self.source, self.pieces, self.most = iter(pieces), pieces, max_record
        self.decoder = codecs.getincrementaldecoder(pieces.codec)(errors="replace")
        self.text, self.at, self.ended = "", 0, False

    def _more(self) -> bool:
        """The next piece in place of the one that is used up; false at the end."""
        while not self.ended:
            piece = next(self.source, None)
            self.ended = piece is None
            self.text, self.at = self.decoder.decode(b"", not self.pieces.cut) if piece is None else self.decoder.decode(piece), 0
            self.pieces.notes.replaced += self.text.count("�")
            if self.text:
                return True
        return False

    def peek(self) -> str:
        """The next character that isn't blank; empty at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in BLANKS:
                    return self.text[self.at]
                self.at += 1
            if not self._more():
                return ""

    def take(self) -> str:
        mark = self.peek()
        self.at += len(mark)
        return mark

    def value(self, member: bool) -> tuple[str | None, bool]:
        """The text up to the value's end (null if it is too long), and whether it ends before the file does.

        A member of an array ends before a comma or bracket of the array, any other value with its last bracket or the file.
        """
        parts: list[str] = []
        size, depth, quoted, skip, end = 0, 0, False, 0, None
        while True:
            place = max(self.at, skip)
            while end is None and (m := (QUOTED if quoted else MARKS).search(self.text, place)):
                c, place = m[0], m.end()
                if c == "\\":
                    place += quoted
                elif c == '"':
                    quoted = not quoted
                elif c in "[{":
                    depth += 1
                elif c in "]}":
                    depth -= 1
                    if depth < 0 or (depth == 0 and not member):
                        end = m.start() + (depth == 0)
                elif depth == 0 and member:
                    end = m.start()
            taken = self.text[self.at : end]
            size += len(taken.encode("utf-8", "replace"))
            if size > self.most:
                parts.clear()
            else:
                parts.append(taken)
            skip = max(0, place - len(self.text))  # an escape at the piece's end reaches into the next
            self.at = len(self.text) if end is None else end
            if end is not None or not self._more():
                if size > self.most:
                    self.pieces.notes.cut("record_limit")
                return (None if size > self.most else "".join(parts)), end is not None


def json_document(pieces: Pieces, max_record: int) -> Iterator[dict]:
    """Objects of the outer array, or one object. Members of other kinds, and too long ones, are errors; an unreadable one ends the reading."""
    values, notes = Values(pieces, max_record), pieces.notes
    first = values.peek()
    if not first:
        return
    many = first == "["
    if many:
        values.take()
    n = 0
    while not (many and n == 0 and values.peek() == "]"):
        n += 1
        text, more = values.value(many)
        if text is None:
            notes.parse_errors += 1
            if not many:
                return
        else:
            body = text.strip(BLANKS)
            try:
                value, end = json.JSONDecoder().raw_decode(body)
            except (ValueError, RecursionError) as x:
                return notes.broken(f"unreadable value {n}: {type(x).__name__}")
            yield from _record(value, notes)
            if end < len(body):
                return notes.broken(f"no comma or end after value {n}" if many else "more text after the end")
        if not many:
            break
        mark = values.take() if more else ""
        if mark == "]":
            break
        if mark != ",":
            return notes.broken(f"no comma or end after value {n}")
    if many and n == 0:
        values.take()
    if values.peek():
        notes.broken("more text after the end")


def records_of(extension: str, raw: BinaryIO, size: int, notes: Notes, max_bytes: int, max_record: int) -> tuple[Iterator[dict], Pieces | None]:
    if extension in (".xlsx", ".xlsm"):
        if size > max_bytes:
            notes.cut("byte_limit")
            notes.failure = "too large"
            return iter(()), None
        return _named(sheet_rows(raw.read()), notes), None
    pieces = Pieces(raw, notes, max_bytes)
    if extension == ".json":
        return json_document(pieces, max_record), pieces
    if extension == ".jsonl":
        return json_lines(pieces, max_record), pieces
    return delimited(pieces, "\t" if extension == ".tsv" else ",", max_record), pieces


@dataclass
class Files(InputPartition):
    """Files of one task: name below the folder, place in the store, size."""

    files: list[tuple[str, str, int]]


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[1] if "." in name else ""


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{quote(os.path.abspath(root))}")


class BoundedReader(DataSourceReader):
    def __init__(self, options: dict):
        whole = lambda name, default: int(options.get(name, default))
        self.root = options["path"]
        self.max_rows, self.max_bytes, self.max_record, self.split = whole("max_rows", MAX_ROWS), whole("max_bytes", MAX_BYTES), whole("max_record", MAX_RECORD), whole("split_bytes", SPLIT)
        self.lines = (options.get("lines") or "").split(",")
        self.extensions = options["extensions"].split(",") if options.get("extensions") else STRUCTURED

    def partitions(self) -> list[InputPartition]:
        store, base = _store(self.root)
        found = sorted((f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and extension_of(f.path) in self.extensions), key=lambda f: f.path)
        out, held = [Files([])], 0
        for f in found:
            cost = min(f.size, self.max_bytes)
            if out[-1].files and held + cost > self.split:
                out.append(Files([]))
                held = 0
            out[-1].files.append((f.path.removeprefix(base).lstrip("/"), f.path, f.size))
            held += cost
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)

        for name, path, size in partition.files:
            notes, n, pieces = Notes(), 0, None
            try:
                with store.open_input_stream(path, compression=None) as raw:
                    records, pieces = records_of(".jsonl" if extension_of(path) in self.lines else extension_of(path), raw, size, notes, self.max_bytes, self.max_record)
                    for record in records:
                        if n == self.max_rows:
                            notes.cut("row_limit")
                            break
                        n += 1
                        rows.append((name, n, list(record.items()), *[None] * 7))
                        held += sum(len(k) + len(v or "") for k, v in record.items())
                        if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
            except Exception as x:  # one bad file must not fail the job
                notes.broken(type(x).__name__)
            rows.append((name, None, None, notes.encoding, notes.parse_errors, notes.replaced, pieces.read if pieces else size if n else 0, size, notes.reasons, notes.failure))
        if rows:
            yield batch()


class BoundedTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bounded_tables"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoundedReader:
        return BoundedReader(self.options)


def read_bounded(spark: SparkSession, folder: str, **bounds: int | str) -> DataFrame:
    """Rows and notes of all tables in files below the folder."""
    spark.dataSource.register(BoundedTables)
    return spark.read.format("bounded_tables").options(**{k: str(v) for k, v in bounds.items()}).load(folder)
