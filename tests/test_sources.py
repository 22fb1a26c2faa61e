"""Files, records, archives, office documents, sinks and the streaming index."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.operators import evidence
from marlstone.sources import archives, files, records, sinks
from marlstone.streaming import increments

LINE = "The harbour authority reported that cargo volumes grew in every quarter of the year under review."


def zipped(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def docx(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return zipped({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'})


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in put"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text(LINE)
    (root / "sub" / "gb.txt").write_bytes("港口关闭导致物流延误".encode("gb18030"))
    (root / "sub" / "b+c.docx").write_bytes(docx("First", LINE))
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "sheet.xlsx").write_bytes(zipped({"xl/sharedStrings.xml": '<sst xmlns="u"><si><t>name</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="u"><sheetData><row><c t="s"><v>0</v></c><c><v>3.5</v></c></row></sheetData></worksheet>'}))
    (root / "slides.pptx").write_bytes(zipped({f"ppt/slides/slide{i}.xml": f'<p xmlns:a="u"><a:p><a:t>slide {i}</a:t></a:p></p>' for i in (10, 2)}))
    (root / "pack.zip").write_bytes(zipped({"in.txt": LINE, "../escape.txt": "x", "deep/two.txt": "two"}))
    (root / "image.png").write_bytes(b"\x89PNG")
    return str(root)


def test_scan_opens_nothing(spark, folder):
    rows = {r.path: r for r in files.scan(spark, folder).collect()}
    assert {"a.txt", "sub/gb.txt", "sub/b+c.docx", "pack.zip", "image.png"} <= rows.keys() and rows["sub/gb.txt"].depth == 1
    assert rows["a.txt"].size == len(LINE) and rows["a.txt"].modified_at.endswith("+00:00")


def test_parse_never_fails_the_job(spark, folder):
    docs = {r.path: r for r in files.parse(files.contents(spark, folder)).collect()}
    assert docs["a.txt"].text == LINE and docs["sub/gb.txt"].text == "港口关闭导致物流延误"
    assert docs["sub/b+c.docx"].text == f"First\n{LINE}" and docs["bad.docx"].status == "failed"
    assert docs["sheet.xlsx"].text == "name\t3.5" and docs["slides.pptx"].text.index("slide 2") < docs["slides.pptx"].text.index("slide 10")
    assert docs["pack.zip::in.txt"].text == LINE and docs["image.png"].status == "skipped" and "pack.zip::../escape.txt" not in docs


def test_ledger(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name in ("one.txt", "two.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    rows = [("p.zip", zipped({"a": "1", "b": "2", "../c": "3"})), ("t.tar.gz", tar.getvalue()), ("x.gz", gzip.compress(b"hello")), ("y.bz2", bz2.compress(b"z" * 100)), ("no.zip", b"junk")]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = archives.members(df, max_members=1000, max_member=50)
    out = {r.path: r for r in archives.ledger(found).collect()}
    assert (out["p.zip"].parsed_members, out["p.zip"].skipped_members, out["p.zip"].complete) == (2, 1, False)
    assert (out["t.tar.gz"].parsed_members, out["t.tar.gz"].skipped_members) == (2, 1)
    assert out["x.gz"].complete and out["y.bz2"].skipped_members == 1 and out["no.zip"].failed_members == 1
    capped = archives.members(df.filter("path = 'p.zip'"), max_members=1).filter("reason = 'too many members'")
    assert capped.count() == 1


def tarred(members: dict, mode: str = "w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_nested_archives(spark):
    """Archives in archives share their file's bounds; what is refused has a row of the ledger."""
    deep = zipped({"top.txt": b"t", "in.tar": tarred({"mid.txt": b"m", "core.zip": zipped({"low.txt": b"l", "far.zip": zipped({"x.txt": b"x"})}), "c.csv.gz": gzip.compress(b"a,b")}), "bad.zip": b"none", "../up.txt": b"u"})
    df = spark.createDataFrame([("d.zip", deep), ("gone.zip", None)], "path string, content binary")
    rows = {r.member: r for r in archives.members(df).filter("path = 'd.zip'").collect()}
    assert {m: r.reason for m, r in rows.items() if r.status == "skipped"} == {"../up.txt": "unsafe name", "in.tar::core.zip::far.zip": "too deep"} and rows["in.tar::c.csv.gz::c.csv"].content == b"a,b"
    assert rows["in.tar::core.zip::low.txt"].content == b"l" and rows["in.tar::mid.txt"].content == b"m" and rows["in.tar"].status == rows["in.tar::core.zip"].status == "opened" and rows["in.tar"].content is None
    assert sorted(r.status for r in archives.members(df).filter("member in ('bad.zip')").collect()) == ["failed", "opened"]
    ledger = {r.path: r for r in archives.ledger(archives.members(df)).collect()}
    assert ledger["d.zip"].inner_archives >= 3 and not ledger["d.zip"].complete and ledger["gone.zip"].failed_members == 1
    # one budget for all levels
    few = archives.members(df.limit(1), max_members=3)
    assert few.filter("status in ('extracted', 'opened')").count() == 3 and few.filter("reason = 'too many members'").count() > 0
    flat = archives.members(df.limit(1), max_depth=1)
    assert flat.filter("member = 'in.tar' and reason = 'too deep'").count() == 1 and flat.filter("member like '%::%'").count() == 0
    bomb = zipped({"a.zip": zipped({"x": b"0" * 900}), "b.zip": zipped({"y": b"1" * 900})})
    total = archives.members(spark.createDataFrame([("b.zip", bomb)], "path string, content binary"), max_total=2200)
    assert total.filter("reason = 'total too large'").count() >= 1 and total.filter("status = 'extracted'").count() == 1


def test_archives_in_sql(spark):
    archives.register(spark)
    spark.createDataFrame([("d.zip", zipped({"in.zip": zipped({"a.txt": b"one", "b.txt": b"two"})})), ("e.tar", tarred({"c.txt": b"three"})), ("gone.zip", None)], "path string, content binary").createOrReplaceTempView("packed")
    found = spark.sql("SELECT path, m.member, m.status, CAST(m.content AS STRING) AS text FROM packed, LATERAL archive_members(path, content) m ORDER BY path, member").collect()
    assert [tuple(r) for r in found] == [("d.zip", "in.zip", "opened", None), ("d.zip", "in.zip::a.txt", "extracted", "one"), ("d.zip", "in.zip::b.txt", "extracted", "two"), ("e.tar", "c.txt", "extracted", "three")]


def test_delimited(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,,name,name\n1,x,"a\nb",z,extra\n2,y\n')
    table = records.read_delimited(spark, str(path))
    assert table.columns == ["id", "column_2", "name", "name_2"]
    assert [tuple(r) for r in table.orderBy("id").collect()] == [("1", "x", "a\nb", "z"), ("2", "y", None, None)]
    assert records.bounded(table, 1)[1] and not records.bounded(table, 2)[1]


def test_json(spark, tmp_path):
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1, "b": {"c": 2}}\n\nnot json\n{"d": null}\n')
    found = records.read_json_lines(spark, str(lines))
    assert tuple(records.parse_errors(found).first()) == (3, 1)
    assert records.as_table(found).columns == ["a", "b", "d"]
    array = tmp_path / "a.json"
    array.write_text('[{"a": "x"}, {"a": "y"}]')
    assert [r.record["a"] for r in records.read_json(spark, str(array)).collect()] == ["x", "y"]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/scans"
    for scan, n in (("s1", 3), ("s2", 2), ("s1", 1)):
        sinks.replace_scan(spark.range(n).withColumn("scan_id", F.lit(scan)), path)
    assert {(r.scan_id, r["count"]) for r in spark.read.parquet(path).groupBy("scan_id").count().collect()} == {("s1", 1), ("s2", 2)}
    vectors = spark.createDataFrame([("k1", "m", [1.0]), ("k2", "m", [2.0])], "cache_key string, model string, embedding array<double>")
    for _ in range(2):
        sinks.add_embeddings(vectors, f"file://{tmp_path}/vectors")
    assert spark.read.parquet(f"file://{tmp_path}/vectors").count() == 2


def test_names_and_xml(spark):
    bad = "a\x00b\x0bc￾d\ttab"
    r = spark.range(1).select(sinks.xml_safe(F.lit(bad)), sinks.safe_name(F.lit("../a b/报告?.docx")), sinks.safe_name(F.lit("//"))).first()
    assert tuple(r) == ("abcd\ttab", "a_b_报告_.docx", "export")


def test_stream_adds_each_file_once(spark, tmp_path):
    source, index, check = (str(tmp_path / x) for x in ("in", "index", "check"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.txt").write_text(f"{LINE} Number {i}.")
    for more in (None, "late.txt"):
        if more:
            (tmp_path / "in" / more).write_text(LINE)
        increments.watch(spark, source, index, check, once=True).awaitTermination()
    rows = increments.indexed(spark, index).collect()
    assert sorted(r.path for r in rows) == ["f0.txt", "f1.txt", "f2.txt", "late.txt"]
    assert evidence.UNIT_CHARS == 1200
