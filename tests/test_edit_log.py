"""Logs of edits against a plain replay, edit by edit."""

from __future__ import annotations

import hashlib
import random

import pytest

from marlstone.operators import edit_log

NODES = "node_id string, parent_id string, name string, kind string, position int, confirmed boolean"


def manual(prefix, values):
    return f"manual-{prefix}-{hashlib.sha256('|'.join(map(str, values)).encode()).hexdigest()[:16]}"


def edit(seq, operation, **k):
    return (seq, k.pop("edit_id", f"e{seq}"), operation, *(k.get(c) for c in ("node_id", "name", "confirmed", "path", "target", "node_ids", "groups")))


def plain(nodes, members, log):
    """nodes: id to [parent, name, kind, position, confirmed]; members: id to paths."""
    nodes, members = {k: list(v) for k, v in nodes.items()}, {k: set(v) for k, v in members.items()}
    undone = set()
    for e in sorted(log):
        if e[2] == "undo" and e[7]:
            undone.add(e[7])
        elif e[2] == "redo":
            undone.discard(e[7])
    for seq, edit_id, op, node, name, confirmed, path, _, ids, groups in sorted(log):
        if edit_id in undone:
            continue
        if op == "rename" and node in nodes and (name or "").strip():
            nodes[node][1] = name.strip()[:120]
        elif op == "confirm" and node in nodes:
            nodes[node][4] = True if confirmed is None else confirmed
        elif op == "mount" and node in nodes and nodes[node][2] == "group" and path:
            members.setdefault(node, set()).add(path.replace("\\", "/"))
        elif op == "merge":
            chosen = sorted((nodes[n][3], n) for n in set(ids or []) if n in nodes and nodes[n][2] == "group")
            if len(chosen) < 2:
                continue
            head = nodes[chosen[0][1]]
            new = manual("merge", ids)
            paths = set().union(*(members.pop(n, set()) for _, n in chosen))
            for _, n in chosen:
                del nodes[n]
            nodes[new], members[new] = [head[0], (name or "").strip()[:120] or "merged", "group", 1_000_000 + seq, head[4]], paths
        elif op == "split" and node in nodes and nodes[node][2] == "group" and len(groups or []) >= 2:
            used, parts = set(), []
            for i, (label, paths) in enumerate(groups, 1):
                own = sorted(set(paths) & members.get(node, set()) - used)
                if own:
                    used |= set(own)
                    parts.append((i, label, own))
            if len(parts) < 2:
                continue
            old = nodes.pop(node)
            members.pop(node, None)
            for i, label, own in parts:
                new = manual("split", [node, i, *own])
                nodes[new], members[new] = [old[0], (label or "").strip()[:120] or f"part {i}", "group", old[3] + i, True], set(own)
    return {(k, *v) for k, v in nodes.items()}, {(k, p) for k, ps in members.items() if k in nodes for p in ps}


def replay(spark, nodes, members, log):
    found = edit_log.replayed(spark.createDataFrame([(k, *v) for k, v in nodes.items()], NODES), spark.createDataFrame([(k, p) for k, ps in members.items() for p in ps], "node_id string, path string"), spark.createDataFrame(log, edit_log.LOG))
    return tuple({tuple(r) for r in df.collect()} for df in found)


def groups(n, rng):
    nodes = {f"g{k}": ["root", f"group {k}", "group", k, rng.random() < 0.3] for k in range(n)} | {"f": ["root", "a file", "file", 99, False]}
    return nodes, {f"g{k}": {f"p{k}.{j}" for j in range(rng.randrange(6))} for k in range(n)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_logs(spark, seed):
    """Chains of merges and splits, edits of nodes that are gone or not yet there, undo before and after."""
    rng = random.Random(seed)
    nodes, members = groups(12, rng)
    log, known = [], list(nodes)
    for seq in range(1, 90):
        current = [n for n, *_ in plain(nodes, members, log)[0]]
        known = list(dict.fromkeys([*known, *current]))
        node = rng.choice(current if rng.random() < 0.7 else known)
        paths = sorted({p for n, p in plain(nodes, members, log)[1] if n == node})
        op = rng.choices(["rename", "confirm", "mount", "merge", "split", "undo", "redo"], [5, 4, 4, 2, 2, 2, 1])[0]
        log.append({
            "rename": lambda: edit(seq, "rename", node_id=node, name=rng.choice([f" name {seq} ", "", None])),
            "confirm": lambda: edit(seq, "confirm", node_id=node, confirmed=rng.choice([True, False, None])),
            "mount": lambda: edit(seq, "mount", node_id=node, path=rng.choice([f"new\\{seq}", "p1.1", None])),
            "merge": lambda: edit(seq, "merge", node_ids=rng.sample(known, 2) + rng.sample(current, min(2, len(current))), name=rng.choice([None, f"both {seq}"])),
            "split": lambda: edit(seq, "split", node_id=node, groups=[(rng.choice([None, f"s{seq}.{i}"]), paths[i::2] + rng.sample(paths, min(1, len(paths)))) for i in range(2)]),
            "undo": lambda: edit(seq, "undo", target=f"e{rng.randrange(1, seq + 3)}"), "redo": lambda: edit(seq, "redo", target=f"e{rng.randrange(1, seq + 3)}"),
        }[op]())
    rng.shuffle(log)
    assert replay(spark, nodes, members, log) == plain(nodes, members, log)


def test_edits_that_wait_for_a_split(spark):
    nodes, members = {"a": ["r", "a", "group", 1, False], "b": ["r", "b", "group", 2, False]}, {"a": {"1", "2", "3"}, "b": {"4"}}
    one, two = manual("split", ["a", 1, "1", "9"]), manual("split", ["a", 2, "2", "3"])
    log = [edit(1, "mount", node_id="a", path="9"), edit(2, "split", node_id="a", groups=[("x", ["1", "9", "7"]), ("y", ["2", "3", "1"])]), edit(3, "merge", node_ids=[one, "b"], name="xb"), edit(4, "rename", node_id=two, name="why"), edit(5, "merge", node_ids=[manual("merge", [one, "b"]), two]), edit(6, "mount", node_id="a", path="late"), edit(7, "merge", node_ids=["a", "b"])]
    found = replay(spark, nodes, members, log)
    assert found == plain(nodes, members, log) and {p for _, p in found[1]} == {"1", "2", "3", "4", "9"}
    assert replay(spark, nodes, members, log[:0]) == plain(nodes, members, [])


def test_many_edits_make_no_longer_plan(spark):
    """A hundred thousand edits: as many rounds as for ten."""
    rng = random.Random(4)
    nodes, members = groups(40, rng)
    log = [edit(k, "rename", node_id=f"g{k % 41}", name=f"n{k}") if k % 3 else edit(k, "confirm", node_id=f"g{k % 37}", confirmed=k % 2 == 0) for k in range(1, 100_000)]
    log += [edit(100_000 + k, "undo", target=f"e{99_999 - k}") for k in range(50)] + [edit(200_000 + k, "merge", node_ids=[f"g{2 * k}", f"g{2 * k + 1}"], name=f"pair {k}") for k in range(20)]
    assert replay(spark, nodes, members, log) == plain(nodes, members, log)
