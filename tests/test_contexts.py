"""Budgets of contexts and catalogues against a plain walk through each node."""

from __future__ import annotations

import random

import pytest

from marlstone.operators import contexts


def plain_context(paths, texts, most_files, most_chars):
    paths = sorted(paths)
    if len(paths) > most_files:
        paths = [paths[i] for i in sorted({round(k * (len(paths) - 1) / float(most_files - 1)) for k in range(most_files)})] if most_files > 1 else paths[:most_files]
    left, share, out = most_chars, min(6000, max(800, most_chars // max(1, len(paths)))), []
    for p in paths:
        if left <= 0:
            break
        text = (texts[p] or "")[: min(share, left)]
        used = len(f"### {p}\n{text}") if text else 0
        out.append((p, text, used))
        left -= used
    return out


@pytest.mark.parametrize(("most_files", "most_chars"), [(30, 50_000), (5, 2500), (2, 900), (1, 1), (7, 5601)])
def test_contexts(spark, most_files, most_chars):
    rng = random.Random(most_files)
    texts = {f"d{k:03}": rng.choice([None, "", "x" * rng.randrange(1, 3000), "港" * rng.randrange(500, 7000)]) for k in range(90)}
    nodes = {"all": list(texts), "one": ["d007"], "some": rng.sample(list(texts), 8), "pair": ["d001", "d002"]}
    docs = spark.createDataFrame([(p, len(t or ""), rng.choice([".a", ".b"]), t) for p, t in texts.items()], "path string, size long, extension string, text string")
    members = spark.createDataFrame([(n, p) for n, ps in nodes.items() for p in ps] + [("one", "d007")], "node_id string, path string")
    totals, items = contexts.node_contexts(members, docs, most_files=most_files, most_chars=most_chars)
    items, totals = items.collect(), {r.node_id: r for r in totals.collect()}
    for n, ps in nodes.items():
        want = plain_context(ps, texts, most_files, most_chars)
        assert [(r.path, r.excerpt, r.chars) for r in sorted((r for r in items if r.node_id == n), key=lambda r: r.place)] == want
        assert (totals[n].total_files, totals[n].sampled_files, totals[n].chars) == (len(ps), len(want), sum(w[2] for w in want))
        assert totals[n].total_size == sum(len(texts[p] or "") for p in ps) and totals[n].sample_truncated == (len(want) < len(ps))


def plain_catalogue(order, inside, chains, heads, units, own, most_clusters, most_evidence):
    seen, taken, listed = set(), [], []
    for c in order:
        members = sorted(p for p in inside[c] if p in own)
        if not members:
            continue
        got = []

        def take(p, e, kind, c=c, got=got):
            if e not in seen and len(taken) < most_evidence:
                seen.add(e)
                taken.append((c, e, p, kind))
                got.append(e)

        for p, e in chains[c]:
            if p in own:
                take(p, e, "chain")
        shown = [p for p in heads[c] if p in own][:3]
        if len(got) < 3:
            for p in shown:
                for e in units[p][:3]:
                    take(p, e, "representative")
        listed.append((c, len(members), "|".join(shown or members[:3]), "|".join(got)))
        if len(listed) >= most_clusters or len(taken) >= most_evidence:
            break
    return taken, listed


@pytest.mark.parametrize(("most_clusters", "most_evidence"), [(8, 18), (3, 5), (8, 1), (20, 60)])
def test_catalogues(spark, most_clusters, most_evidence):
    """Shared evidence, clusters without evidence, nodes of one document and of all."""
    rng = random.Random(most_evidence)
    paths = [f"p{k:02}" for k in range(40)]
    units = {p: [f"E{rng.randrange(60)}" for _ in range(rng.randrange(5))] for p in paths}
    units = {p: list(dict.fromkeys(x)) for p, x in units.items()}
    inside = {f"C{k:02}": rng.sample(paths, rng.randrange(1, 30)) for k in range(14)}
    chains = {c: [(p, e) for p in rng.sample(m, min(len(m), 6)) for e in rng.sample(units[p], min(len(units[p]), 2))] if rng.random() < 0.8 else [] for c, m in inside.items()}
    heads = {c: rng.sample(m, min(len(m), 5)) for c, m in inside.items()}
    nodes = {"all": paths, "half": paths[::2], "one": [paths[3]], "few": rng.sample(paths, 6)}
    order = sorted(inside, key=lambda c: hash(c) % 7 * 100 + int(c[1:]))
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    catalogue, listed = contexts.evidence_catalogue(
        make([(c, i) for i, c in enumerate(order)], "cluster_id string, position long"), make([(c, p) for c, m in inside.items() for p in m], "cluster_id string, path string"),
        make([(c, i, p, e) for c, x in chains.items() for i, (p, e) in enumerate(x)], "cluster_id string, place long, path string, evidence_id string"), make([(c, i, p) for c, x in heads.items() for i, p in enumerate(x)], "cluster_id string, place long, path string"),
        make([(p, i, e) for p, x in units.items() for i, e in enumerate(x)], "path string, place long, evidence_id string"), make([(n, p) for n, x in nodes.items() for p in x], "node_id string, path string"),
        most_clusters=most_clusters, most_evidence=most_evidence,
    )
    catalogue, listed = catalogue.collect(), listed.collect()
    for n, own in nodes.items():
        taken, clusters = plain_catalogue(order, inside, chains, heads, units, set(own), most_clusters, most_evidence)
        mine = sorted((r for r in catalogue if r.node_id == n), key=lambda r: r.place)
        assert [(r.cluster_id, r.evidence_id, r.path, r.origin) for r in mine] == taken and [r.place for r in mine] == list(range(1, len(taken) + 1))
        assert sorted((r.cluster_id, r.file_count, r.representative_documents, r.evidence_ids) for r in listed if r.node_id == n) == sorted(clusters)
