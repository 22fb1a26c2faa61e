"""Trees against plain walks: chains, brooms, forests."""

from __future__ import annotations

import random

import pytest

from marlstone.operators import deep_tree


def walked(parents, order):
    below = {}
    for n, p in parents.items():
        below.setdefault(p if p in parents else None, []).append(n)
    out, stack = [], sorted(below.get(None, []), key=lambda n: (order[n], n), reverse=True)
    while stack:
        n = stack.pop()
        out.append(n)
        stack += sorted(below.get(n, []), key=lambda x: (order[x], x), reverse=True)
    return out


def way_up(parents, n):
    out = []
    while parents.get(n) in parents:
        n = parents[n]
        out.append(n)
    return out


def tables(spark, parents, order):
    nodes = spark.createDataFrame([(n, p, order[n]) for n, p in parents.items()], "node_id string, parent_id string, position int")
    return nodes, deep_tree.ancestors(nodes)


@pytest.mark.parametrize("shape", ["chain", "random", "wide"])
def test_against_a_walk(spark, shape):
    rng = random.Random(shape)
    if shape == "chain":
        parents = {f"n{k:04}": f"n{k - 1:04}" if k else None for k in range(1100)}
    elif shape == "wide":
        parents = {"r": "elsewhere"} | {f"c{k:03}": "r" for k in range(300)} | {"lone": None}
    else:
        parents = {"n0": None, "n1": None} | {f"n{k}": f"n{rng.randrange(max(0, k - 6), k)}" for k in range(2, 250)}
    order = {n: rng.randrange(4) for n in parents}
    nodes, above = tables(spark, parents, order)
    assert {r.node_id: r.depth for r in deep_tree.depths(nodes).collect()} == {n: len(way_up(parents, n)) for n in parents}
    if shape != "chain":
        assert {(r.node_id, r.ancestor_id, r.distance) for r in above.collect()} == {(n, a, k) for n in parents for k, a in enumerate(way_up(parents, n), 1)}
    assert above.count() == sum(len(way_up(parents, n)) for n in parents)
    places = {r.node_id: r.place for r in deep_tree.pre_order(nodes, above, ["position"]).collect()}
    assert sorted(places, key=places.get) == walked(parents, order) and sorted(places.values()) == list(range(1, len(parents) + 1))
    weights = {n: rng.randrange(9) for n in rng.sample(sorted(parents), 60)}
    sums = deep_tree.rolled_up(nodes, above, spark.createDataFrame(list(weights.items()), "node_id string, bytes long")).collect()
    want = dict.fromkeys(parents, 0)
    for n, w in weights.items():
        for a in [n, *way_up(parents, n)]:
            want[a] += w
    assert {r.node_id: r.bytes for r in sums} == want
    kept = rng.sample(sorted(parents), 7)
    stay = {r.node_id: r.kept_files for r in deep_tree.pruned(nodes, above, spark.createDataFrame([(n,) for n in kept], "node_id string")).collect()}
    assert set(stay) == {a for n in kept for a in [n, *way_up(parents, n)]} and stay == {n: sum(parents[k] == n for k in kept) for n in stay}


def test_edges(spark):
    nodes, above = tables(spark, {"a": None}, {"a": 1})
    assert above.count() == 0 and [tuple(r) for r in deep_tree.pre_order(nodes, above, ["position"]).collect()] == [("a", 1)]
    assert deep_tree.ancestors(nodes.limit(0)).count() == deep_tree.depths(nodes.limit(0)).count() == deep_tree.pre_order(nodes.limit(0), above, []).count() == 0
    assert deep_tree.pruned(nodes, above, nodes.limit(0).select("node_id")).count() == 0
    with pytest.raises(ValueError):
        deep_tree.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node_id string, parent_id string"))
    named = spark.createDataFrame([("x", None, 1, "same"), ("y", None, 0, "same"), ("z", "x", 0, "other")], "node_id string, parent_id string, position int, name string")
    places = deep_tree.pre_order(named, deep_tree.ancestors(named), ["position"])
    assert [r.node_id for r in deep_tree.first_of_id(named, places, "name", "same").collect()] == ["y"]
