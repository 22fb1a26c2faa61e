"""Neighbours and average link against plain versions, whatever the tiles, blocks and rounds."""

from __future__ import annotations

import numpy as np
import pytest

from marlstone.operators import clusters, neighbours, semantic


def cosines(x):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return np.round(unit @ unit.T, 12)


def plain_link(x):
    """Closest pair by pair, from all pairs of rows."""
    near = cosines(x)
    off = near - 3 * np.eye(len(x))
    threshold = max(0.46, min(0.72, 0.86 * sorted(max(0.0, r.max()) for r in off)[len(x) // 2])) if len(x) > 1 else 0.46
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        score, i, j = max(((round(float(near[np.ix_(a, b)].mean()), 12), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if score < threshold:
            break
        groups[-i] += groups.pop(-j)
    return {k: min(g) for g in groups for k in g}, threshold


def make(spark, x, extra=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + list(extra), "vec_id long, embedding array<double>")


def blobs(n, d, k, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, d))[rng.integers(0, k, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize(("pivots", "tile", "block"), [(256, 2048, 4096), (1, 7, 50), (9, 3, 20)])
def test_nearest_of_every_row(spark, monkeypatch, pivots, tile, block):
    x = np.vstack([blobs(150, 6, 9, 1), np.zeros((2, 6)), np.ones((3, 6)), -np.ones((1, 6))])
    monkeypatch.setattr(neighbours, "TILE", tile)
    rows, centres = neighbours.dealt(semantic.units(make(spark, x)), pivots)
    for k, floor in ((1, -np.inf), (4, -np.inf), (2, 0.9)):
        found = {}
        for r in neighbours.best_partners(rows, centres, rows, k=k, floor=floor, block=block).collect():
            found.setdefault(r.a, []).append((-round(r.score, 9), r.b))
        near = cosines(x)
        for i in range(len(x)):
            want = sorted((-round(near[i, j], 9), j) for j in range(len(x)) if j != i and near[i, j] >= floor)[:k]
            assert sorted(found.get(i, []))[:k] == want


@pytest.mark.parametrize(("small", "seed"), [(1000, 1), (1000, 2), (30, 2), (0, 1)])
def test_average_link(spark, small, seed):
    """One task or rounds of merges: the same clusters as pair by pair."""
    x = np.vstack([blobs(70, 5, 8, seed, 0.5), np.zeros((1, 5)), np.ones((3, 5))])
    want, threshold = plain_link(x)
    found = clusters.average_link(make(spark, x), small=small).collect()
    assert {r.vec_id: r.cluster for r in found} == want and {r.threshold for r in found} == {round(threshold, 6)}
    near = cosines(x)
    for r in found:
        own = [i for i, c in want.items() if c == r.cluster]
        pairs = [near[i, j] for i in own for j in own if i < j]
        assert r["size"] == len(own) and (r.mean_similarity is None if not pairs else r.mean_similarity == pytest.approx(np.mean(pairs), abs=2e-6))
        central = sorted((-round(float(np.mean([near[i, j] for j in own if j != i])), 9) if pairs else -1.0, i) for i in own)
        assert r.place == next((k + 1 for k, (_, i) in enumerate(central[:3]) if i == r.vec_id), None)
    order = sorted({(-r["size"], r.cluster, r.cluster_id) for r in found})
    assert [c for _, _, c in order] == [f"SEM-{k:04}" for k in range(1, len(order) + 1)]


def test_many_vectors(spark):
    """More than one task takes: rounds, then the rest; two thousand vectors in forty directions."""
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 40, 2000)
    x = np.eye(40)[kind] + 0.01 * rng.normal(size=(2000, 40))
    placed, _ = semantic.average_link(make(spark, x), small=60)
    found = {r.vec_id: r.cluster for r in placed.collect()}
    first = {k: int(np.flatnonzero(kind == k)[0]) for k in range(40)}
    assert found == {i: first[k] for i, k in enumerate(kind)}


def test_edges(spark):
    one = clusters.average_link(make(spark, np.ones((1, 3)))).collect()
    assert [(r.cluster_id, r["size"], r.mean_similarity, r.threshold) for r in one] == [("SEM-0001", 1, None, 0.46)]
    rows = make(spark, np.eye(3), [(0, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (7, None), (8, [None, 1.0, None])])
    found = {r.vec_id: r.cluster for r in clusters.average_link(rows).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 8: 1}
    assert clusters.average_link(make(spark, np.eye(2)).limit(0)).count() == 0
    assert semantic.nearest_similarities(make(spark, np.eye(1))).count() == 0


def test_tree_of_clusters(spark):
    found = spark.createDataFrame([("a", 0, "SEM-0001", 1, 0.9), ("b", 0, "SEM-0001", 2, 0.9), ("c", 2, "SEM-0002", 1, None)], "path string, cluster long, cluster_id string, place long, mean_similarity double")
    docs = spark.createDataFrame([("a", 10, "a.txt"), ("b", 2000, "b.txt"), ("c", 3, "c.txt"), ("d", 4, "d.txt")], "path string, size long, name string")
    rows = semantic.semantic_tree(found, docs, spark.createDataFrame([(0, "ports"), (2, "law")], "cluster long, name string")).collect()
    groups = {r.name: r for r in rows if r.kind == "group"}
    assert {n: (r.files, r.total_size, r.total_size_human, r.parent_id) for n, r in groups.items()} == {"ports": (2, 2010, "2.0 KB", "root"), "law": (1, 3, "3.0 B", "root")}
    assert {(r.path, r.parent_id) for r in rows if r.kind == "file"} == {("a", groups["ports"].node_id), ("b", groups["ports"].node_id), ("c", groups["law"].node_id)}
