"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import corpus_pipeline as p
from marlstone.llm import perplexity, queries, urltrees


def test_perplexity_rejects_symbols_tables_and_shouting(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    good = [r for r in docs.join(spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1"), "doc_id").collect() if len(r.text.split()) >= 60][:20]
    spoilt = {
        "symbols": lambda t: " ".join(w + "*%$&"[i % 4] * 3 for i, w in enumerate(t.split())),
        "table": lambda t: " | ".join(t.split()),
        "shouted": lambda t: t.upper() + "!!",
    }
    rows = [(-100 * (k + 1) - i, f(r.text), r.lang) for k, f in enumerate(spoilt.values()) for i, r in enumerate(good)]
    found = {r.doc_id: r for r in perplexity.judge_documents(docs.union(spark.createDataFrame(rows, docs.schema))).collect()}
    for k, kind in enumerate(spoilt):
        ours = [found[-100 * (k + 1) - i] for i in range(len(good))]
        assert sum(not r.kept for r in ours if not r.base_failed) >= 0.9 * sum(not r.base_failed for r in ours) > 0, kind
    originals = [found[r.doc_id] for r in good if not found[r.doc_id].base_failed]
    assert sum(r.kept for r in originals) >= 0.9 * len(originals)


def test_perplexity_of_a_language_of_symbols_only(spark):
    rows = [(i, "a## b** c%% " * 5 + f"{i}", "zz") for i in range(5)] + [(9, None, "zz")]
    assert perplexity.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 6


def test_suffix_figures_come_from_all_labelled_urls(spark):
    rules = [urltrees.Rule("block", "net", "/"), urltrees.Rule("allow", "org", "/")]
    urls = [f"http://h{i % 7}.{('net', 'org')[i % 2]}/p{i}" for i in range(4000)]
    for k in range(20):
        for kind in ("block", "allow"):
            rules.append(urltrees.Rule(kind, f"{kind}{k:02d}", "/p"))
            urls += [f"http://host.{kind}{k:02d}/p{i}" for i in range(10)]
    known = len(urls)
    urls += [f"http://host.{kind}{k:02d}/q{i}" for k in range(20) for kind in ("block", "allow") for i in range(5)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = [r for r in urltrees.judge_urls(pages, rules, fit_rows=60).collect() if r.page_id >= known]
    assert len(out) == 200 and all(r.rule is None for r in out)
    assert sum(r.verdict == urls[r.page_id].split(".")[1][:5] for r in out) >= 190


def _prose(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*p.COLUMNS)
    good = {r.doc_id for r in perplexity.judge_documents(docs).filter("kept").collect()}
    return docs, sorted((r for r in docs.collect() if r.doc_id in good and len(r.text.split()) > 60), key=lambda r: r.doc_id)


def test_quality_rules_judge_each_row(spark, data):
    docs, good = _prose(spark, data)
    a, b = good[0], good[1]
    extra = [(None, a.text, a.lang, a.source, a.n_chars), (None, "too short", "en", "s", 9), (b.doc_id, "too short", b.lang, b.source, 9)]
    out = p.quality_rules(spark, docs.union(spark.createDataFrame(extra, docs.schema)), data).collect()
    assert [r.text for r in out if r.doc_id is None] == [a.text]
    assert [r.text for r in out if r.doc_id == b.doc_id] == [b.text]
    assert {r.doc_id for r in good} <= {r.doc_id for r in out}


def test_near_dedup_keeps_one_row_of_a_group_and_rows_without_id(spark, data):
    docs, good = _prose(spark, data)
    x, y, z = (" ".join(f"{w}{i}" for i in range(40)) for w in "xyz")
    rows = [(7, x), (7, x), (3, x), (3, x), (5, y), (5, z), (None, y), (None, y), (9, ""), (9, "")]
    out = p.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema), data).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in out), key=key) == sorted([(3, x), (5, y), (5, z), (None, y), (None, y), (9, ""), (9, "")], key=key)


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[at:]
    end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), path[:end]


def test_hosts_paths_and_rules_in_plain_python(spark, data):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = {r.page_id: r for r in queries.op4_url_trees(spark, data).collect()}
    assert found.keys() == urls.keys()
    ruled = 0
    for k, url in urls.items():
        host, path = _parts(url)
        fits = [(len(h + q), h + q, v) for v, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        r = found[k]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
        assert r.verdict in ("allow", "block")
        ruled += rule is not None
    assert 0 < ruled < len(urls)


def test_rules_of_one_length_block(spark):
    rules = [urltrees.Rule("allow", "b.org", "/x"), urltrees.Rule("block", "a.b.org", ""), urltrees.Rule("allow", "b.org", "/y/")]
    rows = [(1, "http://a.b.org/x"), (2, "http://a.b.org/y/"), (3, "http://B.ORG/x?q#f"), (4, "http://cb.org/x")]
    out = {r.page_id: (r.rule, r.verdict) for r in urltrees.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert out[1] == ("a.b.org", "block") and out[2] == ("b.org/y/", "allow") and out[3] == ("b.org/x", "allow") and out[4][0] is None
