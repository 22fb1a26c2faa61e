"""Bounded readers of tables in files, the path guard, and parts of long texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import tree
from marlstone.plans import package
from marlstone.sources import files, structured

from .test_sources import zipped

SHEET = {
    "xl/workbook.xml": '<workbook xmlns="u" xmlns:r="v"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="u"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="u"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    "xl/sharedStrings.xml": '<sst xmlns="u"><si><t>name</t></si><si><t>when</t></si></sst>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="u"><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": '<worksheet xmlns="u"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="b"><v>1</v></c><c r="C2" s="1"><v>45000.5</v></c></row><row><c r="C3" s="2"><v>1</v></c></row></sheetData></worksheet>',
}


def read(spark, rows, **bounds):
    df = spark.createDataFrame([(p, "." + p.rsplit(".", 1)[1], x) for p, x in rows], "path string, extension string, content binary")
    found = structured.structured_records(df, **bounds).cache()
    return {p: [r.record for r in found.filter("row_no is not null").orderBy("row_no").collect() if r.path == p] for p, _ in rows}, {r.path: r for r in structured.record_ledger(found).collect()}


def test_broken_files_keep_their_leading_rows(spark):
    rows, notes = read(spark, [
        ("a.json", b'[{"a": 1, "b": {"c": [2]}}, 3, {"a": null}] '), ("tail.json", b'[{"a": 1}, {"a": 2}, {"a": '), ("more.json", b'{"a": 1} {"a": 2}'), ("comma.json", b'[{"a": 1} {"a": 2}]'),
        ("none.json", b""), ("empty.json", b"[]"), ("l.jsonl", b'{"a": 1}\n\nnot json\n[1]\n{"a": 2}'), ("gb.csv", "名称,数量\n港口,3\n".encode("gb18030")), ("bom.tsv", b"\xef\xbb\xbfa\ta\t\n1\t2\n"),
        ("u.csv", "a,b\nx,y\n".encode("utf-16")), ("bad.xlsx", b"no zip"), ("gone.csv", None), ("s.xlsx", zipped(SHEET)), ("skip.txt", b"x"), ("q.csv", b'a,b\n"x\ny",2,3\n'), ("mixed.csv", b"a\n" + b"\xff\xff\xe4\n"),
    ])
    assert rows["a.json"] == [{"a": "1", "b": '{"c": [2]}'}, {"a": None}] and (notes["a.json"].parse_errors, notes["a.json"].status) == (1, "partial")
    assert rows["tail.json"] == [{"a": "1"}, {"a": "2"}] and notes["tail.json"].failure
    assert rows["more.json"] == rows["comma.json"] == [{"a": "1"}] and notes["more.json"].parse_errors == notes["comma.json"].parse_errors == 1
    assert rows["none.json"] == rows["empty.json"] == [] and notes["none.json"].status == notes["empty.json"].status == "completed"
    assert rows["l.jsonl"] == [{"a": "1"}, {"a": "2"}] and notes["l.jsonl"].parse_errors == 2
    assert rows["gb.csv"] == [{"名称": "港口", "数量": "3"}] and notes["gb.csv"].encoding == "gb18030"
    assert rows["bom.tsv"] == [{"a": "1", "a_2": "2", "column_3": None}] and notes["bom.tsv"].encoding == "utf-8-sig"
    assert rows["u.csv"] == [{"a": "x", "b": "y"}] and notes["u.csv"].encoding == "utf-16"
    assert notes["bad.xlsx"].status == notes["gone.csv"].status == "failed" and "skip.txt" not in notes
    assert rows["s.xlsx"] == [{"name": "True", "column_2": None, "when": "2023-03-15 12:00:00"}, {"name": None, "column_2": None, "when": "1899-12-31 00:00:00"}]
    assert rows["q.csv"] == [{"a": "x\ny", "b": "2"}] and notes["mixed.csv"].replaced > 0


def test_bounds_are_named(spark):
    big = b'[{"a": "' + b"x" * 5000 + b'"}, {"a": 1}]'
    rows, notes = read(spark, [("big.json", big), ("n.csv", b"a\n" + b"1\n" * 50), ("long.jsonl", b'{"a": "' + b"y" * 5000 + b'"}\n{"a": 2}\n')], max_rows=10, max_record=1000)
    assert rows["big.json"] == [] and notes["big.json"].reasons == ["record_limit"] and notes["big.json"].status == "failed"
    assert len(rows["n.csv"]) == 10 and notes["n.csv"].reasons == ["row_limit"]
    assert rows["long.jsonl"] == [{"a": "2"}] and notes["long.jsonl"].parse_errors == 1 and notes["long.jsonl"].reasons == ["record_limit"]
    rows, notes = read(spark, [("n.csv", "a\n港\n港\n".encode())], max_bytes=7)
    assert rows["n.csv"][0] == {"a": "港"} and notes["n.csv"].reasons == ["byte_limit"] and notes["n.csv"].replaced == 0


def test_many_rows_cross_batches(spark):
    rows, _ = read(spark, [("m.csv", b"a\n" + b"".join(b"%d\n" % i for i in range(2500)))])
    assert [r["a"] for r in rows["m.csv"]] == [str(i) for i in range(2500)]


def test_a_cut_character_is_no_error():
    raw = ("x" * (structured.PROBE - 1) + "港口").encode()
    assert structured.encoding_of(raw) == "utf-8" and structured.encoding_of(b"") == "utf-8" and structured.encoding_of(b"\xff\xff") == "utf-8"


def test_path_guard(spark):
    asked = ["a/b.txt", "a/../b", "../x", "/data/in/c", "/data/inner", "a/../../in/d", "/etc/passwd", ".", "..\\x", None]
    found = spark.createDataFrame([(x,) for x in asked], "p string").select(files.resolve_under(F.col("p"), "/data/in/")).collect()
    assert [r[0] for r in found] == ["/data/in/a/b.txt", "/data/in/b", None, "/data/in/c", None, "/data/in/d", None, "/data/in", None, None]


def plain_parts(x, most, preferred):
    size, out, start = max(preferred, -(-len(x) // most)), [], 0
    while start < len(x):
        end = min(len(x), start + size)
        if end < len(x) and (at := x.rfind("\n", start + int(size * 0.75), end)) > start:
            end = at
        out.append((start, end))
        start = end
    return out


def test_parts_of_long_texts(spark):
    rng = random.Random(5)
    texts = ["", None, "\n" * 90, "a" * 41, *("".join(rng.choices("ab港😀\n", weights=[5, 5, 2, 1, 1], k=rng.randrange(1, 400))) for _ in range(80))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.long_parts(F.col("t"), 4, 20).alias("p"))
    for r in df.collect():
        assert [(p.start, p.end) for p in r.p] == plain_parts(texts[r.i] or "", 4, 20)


def test_node_lookup_and_profile(spark):
    nodes = spark.createDataFrame([("a", "r", "second", 2), ("a", "r", "first", 1), ("b", "r", "b", 0)], "node_id string, parent_id string, name string, position int")
    assert [r.name for r in tree.find_node(nodes, "a").collect()] == ["first"] and tree.find_node(nodes, "z").count() == 0
    shown = spark.range(1).select(text.semantic_profile(F.lit("t"), F.array(F.lit(" "), F.lit("One  two")), F.lit("body"))).first()[0]
    assert shown == "标题：One two\n章节：One two\n正文：body"


def test_refresh_replaces_the_parsed_document(spark):
    docs = spark.createDataFrame([("a", "a", 1, "h1", None, "x"), ("b", "b", 1, "h2", None, "y")], "path string, name string, size long, sha256 string, modified_at string, text string")
    states = spark.createDataFrame([("a", True, False, False, True)], "path string, parsed boolean, failed boolean, complete boolean, sampled boolean")
    new = spark.createDataFrame([("a", "a", 2, "h3", None, "longer")], docs.schema)
    both, now = package.refreshed(docs, states, new)
    assert {(r.path, r.text) for r in both.collect()} == {("a", "longer"), ("b", "y")}
    assert [(r.path, r.parsed, r.failed, r.complete, r.sampled) for r in now.collect()] == [("a", True, False, True, False)]
