"""Listings against os.walk, with what is refused in the ledger."""

from __future__ import annotations

import os
import random

from marlstone.sources import files, listing


def test_listing_against_a_walk(spark, tmp_path):
    rng = random.Random(6)
    folders = [tmp_path]
    for k in range(40):
        folders.append(rng.choice(folders) / rng.choice([f"f{k}", f"sub {k}", f"ä{k}%20"]))
        folders[-1].mkdir(exist_ok=True)
    for k in range(120):
        (rng.choice(folders) / f"x{k}.txt").write_bytes(b"a" * rng.randrange(50))
    found = listing.walk(spark, str(tmp_path)).collect()
    want = {os.path.relpath(os.path.join(d, n), tmp_path): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(tmp_path) for n in names}
    assert {r.path: r.size for r in found if r.kind == "file"} == want and len(found) == len({r.path for r in found})
    assert {r.path for r in found if r.kind == "folder"} == {os.path.relpath(f, tmp_path) for f in folders[1:]} and all(r.reason is None for r in found)
    assert {r.path: r.size for r in files.scan(spark, str(tmp_path)).collect()} == want


def test_refused_branches_are_seen(spark, tmp_path):
    """Depth, links and loops, folders that are left out, and ones that aren't there."""
    deep = tmp_path / "one" / "two" / "three"
    deep.mkdir(parents=True)
    (deep / "deep.txt").write_text("deep")
    (tmp_path / "one" / "near.txt").write_text("near")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("x")
    (tmp_path / "self").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "file-link").symlink_to(tmp_path / "one" / "near.txt")
    found = listing.walk(spark, f"file://{tmp_path}", max_depth=2)
    rows = {r.path: (r.kind, r.reason) for r in found.collect()}
    assert rows == {"one": ("folder", None), "one/near.txt": ("file", None), "one/two": ("folder", None), "one/two/three": ("folder", "too deep"), ".git": ("folder", "left out"), "self": ("link", "link"), "file-link": ("link", "link")}
    assert {(r.reason, r.kind): r.entries for r in listing.ledger(found).collect()} == {(None, "folder"): 2, (None, "file"): 1, ("too deep", "folder"): 1, ("left out", "folder"): 1, ("link", "link"): 2}
    assert [r.path for r in files.scan(spark, str(tmp_path)).orderBy("path").collect()] == ["one/near.txt", "one/two/three/deep.txt"]
    gone = listing.walk(spark, str(tmp_path / "nowhere")).collect()
    assert [(r.path, r.kind) for r in gone] == [(".", "folder")] and gone[0].reason.startswith("unreadable")


def test_deep_chain(spark, tmp_path):
    path = tmp_path
    for k in range(40):
        path = path / "d"
        path.mkdir()
    (path / "end.txt").write_text("x")
    assert listing.walk(spark, str(tmp_path), max_depth=100).filter("kind = 'file'").first().depth == 40
    assert listing.walk(spark, str(tmp_path)).filter("reason = 'too deep'").first().path.count("/") == 32
