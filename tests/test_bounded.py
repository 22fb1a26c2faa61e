"""The streaming data source of tables in files, and profiles of whole files."""

from __future__ import annotations

import io
import json
import random
import tracemalloc

import pytest

from marlstone.operators import file_profile
from marlstone.sources import bounded, structured

from .test_sources import zipped
from .test_structured import SHEET


class Long(io.RawIOBase):
    """A stream of parts, each repeated, that are never held together."""

    def __init__(self, *parts: tuple[bytes, int]):
        self.parts = iter(b for part, n in parts for b in ([part] * n))
        self.held = b""

    def read(self, n: int = -1) -> bytes:
        while len(self.held) < n and (part := next(self.parts, None)) is not None:
            self.held += part
        out, self.held = self.held[:n], self.held[n:]
        return out


def rows_of(extension, raw, max_bytes=1 << 40, max_record=1 << 20):
    notes = structured.Notes()
    records, pieces = bounded.records_of(extension, raw if isinstance(raw, io.RawIOBase) else io.BytesIO(raw), 0, notes, max_bytes, max_record)
    return list(records), notes, pieces


def put(folder, files):
    for name, raw in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)


def read(spark, folder, **bounds):
    found = bounded.read_bounded(spark, f"file://{folder}", **bounds).cache()
    rows = {}
    for r in found.filter("row_no is not null").orderBy("path", "row_no").collect():
        rows.setdefault(r.path, []).append(r.record)
    return rows, {r.path: r for r in structured.record_ledger(found).collect()}


def test_same_rows_as_the_reader_of_contents(spark, tmp_path):
    """Every kind of file, broken ones too, by streams as by whole contents."""
    files = {
        "a.json": b'[{"a": 1, "b": {"c": [2]}}, 3, {"a": null}] ', "tail.json": b'[{"a": 1}, {"a": 2}, {"a": ', "more.json": b'{"a": 1} {"a": 2}', "comma.json": b'[{"a": 1} {"a": 2}]', "open.json": b'[{"a": 1}',
        "none.json": b"", "empty.json": b" [ ] ", "one.json": b'\xef\xbb\xbf {"a": "x,]}"}', "esc.json": b'[{"a": "q\\"],["}, {"b\\\\": "y"}]', "l.jsonl": b'{"a": 1}\n\nnot json\n[1]\n{"a": 2}', "gb.csv": "名称,数量\n港口,3\n".encode("gb18030"),
        "bom.tsv": b"\xef\xbb\xbfa\ta\t\n1\t2\n", "u.csv": "a,b\nx,y\n".encode("utf-16"), "bad.xlsx": b"no zip", "s.xlsx": zipped(SHEET), "q.csv": b'a,b\n"x\ny",2,3\n', "mixed.csv": b"a\n" + b"\xff\xff\xe4\n", "skip.txt": b"x", "deep/er/d.csv": b"k\nv\n",
    }
    put(tmp_path, files)
    rows, notes = read(spark, tmp_path)
    df = spark.createDataFrame([(n, "." + n.rsplit(".", 1)[1], x) for n, x in files.items()], "path string, extension string, content binary")
    found = structured.structured_records(df).cache()
    want = {}
    for r in found.filter("row_no is not null").orderBy("path", "row_no").collect():
        want.setdefault(r.path, []).append(r.record)
    assert rows == want
    for r in structured.record_ledger(found).collect():
        mine = notes[r.path]
        assert (mine.rows, mine.parse_errors, mine.replaced, mine.reasons, mine.status, mine.failure is None) == (r.rows, r.parse_errors, r.replaced, r.reasons, r.status, r.failure is None), r.path
        assert mine.encoding == r.encoding and mine.source_bytes == len(files[r.path])


def test_bounds_are_named_and_reading_goes_on(spark, tmp_path):
    put(tmp_path, {
        "r.jsonl": b'{"id":1}\n{"id":2}\n{"id":3}\n', "long.jsonl": b'{"text":"' + b"x" * 2000 + b'"}\n{"id":2}\n', "long.json": b'[{"id":1},{"t":"' + b"[x" * 2000 + b'"},{"id":3}]',
        "long.csv": b"a,b\n" + b"y" * 5000 + b",1\nz,2\n", "cut.json": b"[" + b",".join(b'{"id":%d}' % i for i in range(400)) + b"]", "root.json": b'{"t":"' + b"x" * 2000 + b'"}',
    })
    rows, notes = read(spark, tmp_path, max_rows=50, max_record=1000, max_bytes=6000)
    assert rows["long.jsonl"] == [{"id": "2"}] and rows["long.json"] == [{"id": "1"}, {"id": "3"}] and rows["long.csv"][-1] == {"a": "z", "b": "2"}
    assert {n: (r.status, r.reasons) for n, r in notes.items()} == {
        "r.jsonl": ("completed", []), "long.jsonl": ("partial", ["record_limit"]), "long.json": ("partial", ["record_limit"]), "long.csv": ("partial", ["record_limit"]), "cut.json": ("partial", ["row_limit"]), "root.json": ("partial", ["record_limit"]),
    }
    rows, notes = read(spark, tmp_path, max_rows=1)
    assert rows["r.jsonl"] == [{"id": "1"}] and (notes["r.jsonl"].status, notes["r.jsonl"].reasons) == ("partial", ["row_limit"])
    rows, notes = read(spark, tmp_path, max_bytes=64)
    assert len(rows["cut.json"]) in (6, 7) and notes["cut.json"].reasons == ["byte_limit"] and notes["cut.json"].read_bytes == 64
    assert not rows.get("root.json") and notes["root.json"].status == "failed"


def test_values_across_pieces(monkeypatch):
    """Pieces of a few bytes cut values, characters, escapes and strings anywhere."""
    rng = random.Random(7)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(bounded, "PIECE", size)
        monkeypatch.setattr(bounded, "PROBE", 8)
        values = [{"".join(rng.choices('ab"\\[]{},港😀 \n', k=rng.randrange(6))): rng.choice([1, None, "x\\\"]", ["}", {"k": "["}], "港" * 5])} for _ in range(40)]
        want = [{k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in x.items()} for x in values]
        for ascii_only in (True, False):
            rows, notes, _ = rows_of(".json", json.dumps(values, ensure_ascii=ascii_only, indent=rng.choice([None, 1])).encode())
            assert rows == want and not notes.parse_errors and not notes.replaced and not notes.failure
        rows, notes, _ = rows_of(".jsonl", "\n".join(json.dumps(x, ensure_ascii=False) for x in values).encode())
        assert rows == want and not notes.parse_errors and not notes.replaced


@pytest.mark.parametrize(("extension", "first", "long", "last"), [
    (".json", b'[{"a": 1}, {"b": "', b"x[{,", b'"}, {"a": 2}]'), (".jsonl", b'{"a": 1}\n{"b": "', b"xyz\\", b'"}\n{"a": 2}\n'), (".csv", b"a\n1\n", b"wxyz", b"\n2\n"), (".tsv", b"a\n1\n2\n", b"", b"\n" * 9),
])
def test_memory_stays_small(extension, first, long, last):
    """Two hundred megabytes in one record: it is passed over, the next one is read, and no more than some records are held."""
    raw = Long((first, 1), (long * 250_000, 200), (last, 1))
    tracemalloc.start()
    try:
        rows, notes, pieces = rows_of(extension, raw)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert [r["a"][:1] for r in rows if "a" in r and r["a"][:1] in "12"] == ["1", "2"]
    assert notes.reasons == (["record_limit"] if long else []) and peak < 20 << 20
    assert pieces.read == len(first) + len(long) * 50_000_000 + len(last)


def test_small_files_share_a_task(spark, tmp_path):
    put(tmp_path, {f"f{i}.csv": b"a\n" + b"1\n" * 100 for i in range(20)})
    reader = bounded.BoundedReader({"path": str(tmp_path), "split_bytes": "500"})
    parts = reader.partitions()
    assert [len(p.files) for p in parts] == [2] * 10 and len({f for p in parts for f, *_ in p.files}) == 20
    assert bounded.read_bounded(spark, str(tmp_path), split_bytes=500).filter("row_no is not null").count() == 2000


def test_profiles_of_files(spark, tmp_path):
    """A file has one profile, with its status and coverage, whatever bound has cut it."""
    put(tmp_path, {
        "money.csv": "姓名,金额,日期\n张三,12,2024-01-02\n李四,8,2024-03-01\n张三,12,2024-01-02\n,N/A,x\n".encode("gb18030"), "half.jsonl": b'{"id": 1, "v": 5}\n{"id": 2}\nbroken\n{"v": 7, "w": "t"}\n',
        "cut.csv": b"k\n" + b"1\n2\n3\n100\n" * 5, "none.csv": b"", "bad.xlsx": b"no zip",
    })
    columns, files = file_profile.profile_files(bounded.read_bounded(spark, f"file://{tmp_path}", max_rows=8))
    col = {(r.path, r.column): r for r in columns.collect()}
    file = {r.path: r for r in files.collect()}
    money = col["money.csv", "金额"]
    assert (money.position, money.inferred_type, money.missing_count, money.unique_count, money.min, money.max, money.sum, money.median) == (1, "number", 1, 2, 8.0, 12.0, 32.0, 12.0)
    assert col["money.csv", "日期"].min_datetime == "2024-01-02T00:00:00" and col["money.csv", "姓名"].sensitive_categories == "name"
    assert file["money.csv"].duplicate_row_count == 1 and file["money.csv"].encoding == "gb18030" and file["money.csv"].complete and file["money.csv"].missing_columns == "姓名|金额"
    # 12 cells, two of them missing; no column of mostly distinct values; one of four rows repeats
    assert file["money.csv"].quality_score == round(10 / 12 * 70 * 0.75, 2) and file["money.csv"].value_level == "needs_work"
    assert [(c, col["half.jsonl", c].position, col["half.jsonl", c].missing_count, col["half.jsonl", c]["count"]) for c in ("id", "v", "w")] == [("id", 0, 1, 2), ("v", 1, 1, 2), ("w", 2, 2, 0)]
    assert (file["half.jsonl"].status, file["half.jsonl"].parse_errors, file["half.jsonl"].row_count, file["half.jsonl"].complete) == ("partial", 1, 3, False)
    assert (file["cut.csv"].row_count, file["cut.csv"].truncated, file["cut.csv"].reasons) == (8, True, "row_limit") and col["cut.csv", "k"].outlier_count == 0 and col["cut.csv", "k"].median == 3.0
    assert (file["none.csv"].status, file["none.csv"].column_count, file["none.csv"].quality_score) == ("completed", 0, 0.0)
    assert (file["bad.xlsx"].status, file["bad.xlsx"].value_level) == ("failed", "needs_work")
