"""People's edits of the analysis tree as a table, replayed as joins.

log: seq (the order), edit_id, operation, and what the operation needs: node_id,
name, confirmed, path, target (of undo and redo), node_ids (of a merge), groups (of
a split: name and paths). nodes: node_id, parent_id, name, kind, position,
confirmed. members: node_id, path.

Names, confirmations and added paths need no order among themselves but time: of a
node the last writer counts, and only edits made while the node was there. Merges and
splits end nodes and begin others, so they are worked off in rounds: in each, all
those that come first for every node that they touch. The number of rounds follows
the longest chain of merges and splits of one node, not the number of edits, and
each round is written, so the plan doesn't grow.

An edit that doesn't fit the tree at its time is passed over: of a node that isn't
there, a blank name, a path for a node that is no group, a merge of fewer than two
groups, a split into fewer than two parts that have members. An edit that was undone
last, and not redone since, doesn't count, wherever the undo stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

LOG = "seq long, edit_id string, operation string, node_id string, name string, confirmed boolean, path string, target string, node_ids array<string>, groups array<struct<name:string,paths:array<string>>>"
SPLIT = "manual-split-"


def active(log: DataFrame) -> DataFrame:
    """The edits without undo and redo and what they leave undone."""
    turned = log.filter(F.col("operation").isin("undo", "redo") & (F.coalesce("target", F.lit("")) != ""))
    last = turned.groupBy(F.col("target").alias("edit_id")).agg(F.max_by("operation", "seq").alias("turn"))
    rest = log.filter(~F.col("operation").isin("undo", "redo"))
    return rest.join(last, "edit_id", "left").filter("turn is null or turn = 'redo'").drop("turn")


def manual_id(prefix: str, joined: Column) -> Column:
    """Made of what the node consists of, joined with bars."""
    return F.concat(F.lit(f"manual-{prefix}-"), F.substring(F.sha2(joined, 256), 1, 16))


def _label(name: Column, otherwise: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(F.trim(name), F.lit("")), otherwise), 1, 120)


def _last(edits: DataFrame, value: str, lives: DataFrame, until: Column) -> DataFrame:
    """node_id and the value that was written last while the node was there, before ``until``."""
    met = edits.select("node_id", "seq", F.col(value).alias("value")).join(lives, "node_id").filter((F.col("seq") > F.col("born")) & (F.col("seq") < until))
    return met.groupBy("node_id").agg(F.max_by("value", "seq").alias("written"))


def replayed(nodes: DataFrame, members: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and members after the edits."""
    edits = materialize(active(log), "edits")
    renames = edits.filter("operation = 'rename' and trim(coalesce(name, '')) <> ''").select("seq", "node_id", F.substring(F.trim("name"), 1, 120).alias("name"))
    confirms = edits.filter("operation = 'confirm'").select("seq", "node_id", F.coalesce("confirmed", F.lit(True)).alias("confirmed"))
    mounts = edits.filter("operation = 'mount' and coalesce(path, '') <> ''").select("node_id", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.col("seq").alias("since"))
    begin, never = F.lit(-1).cast("long"), F.lit(None).cast("long")
    there = materialize(nodes.select("node_id", "parent_id", "name", "kind", F.col("position").cast("long").alias("position"), "confirmed", begin.alias("born"), never.alias("died")), "nodes")
    inside = members.select("node_id", "path", begin.alias("since"))
    pending = materialize(edits.filter("operation in ('merge', 'split')").select("seq", "operation", "node_id", "name", F.array_distinct(F.when(F.col("operation") == "merge", F.filter("node_ids", lambda x: x.isNotNull())).otherwise(F.array("node_id"))).alias("ids"), "node_ids", "groups"), "pending")
    while not pending.isEmpty():
        made = F.when(F.col("operation") == "merge", F.array(manual_id("merge", F.array_join("node_ids", "|")))).otherwise(F.array().cast("array<string>"))
        touched = pending.select("seq", F.explode(F.array_union(F.coalesce("ids", F.array().cast("array<string>")), made)).alias("node_id")).distinct()
        first = touched.groupBy("node_id").agg(F.min("seq").alias("first"))
        late = touched.join(first, "node_id").filter("seq > first").select("seq")
        # a part of a split is known by its id only once the split is done
        split = pending.filter("operation = 'split'").agg(F.min("seq").alias("split"))
        unknown = touched.filter(F.col("node_id").startswith(SPLIT)).join(there.select("node_id"), "node_id", "left_anti").join(F.broadcast(split), F.col("seq") > F.col("split")).select("seq")
        ready = materialize(pending.join(late.union(unknown).distinct(), "seq", "left_anti"), "ready")
        asked = ready.select("seq", "operation", "name", "node_ids", "groups", F.explode("ids").alias("node_id"))
        chosen = materialize(asked.join(there.filter("died is null and kind = 'group'").select("node_id", "parent_id", "position", F.col("confirmed").alias("was"), "born", F.col("name").alias("old_name")), "node_id").filter("seq > born"), "chosen")

        merges = chosen.filter("operation = 'merge'")
        fits = merges.groupBy("seq").agg(F.count("*").alias("n"), F.min(F.struct("position", "node_id", "parent_id", "was")).alias("head")).filter("n >= 2")
        named = ready.filter("operation = 'merge'").join(fits, "seq").select("seq", manual_id("merge", F.array_join("node_ids", "|")).alias("new_id"), _label(F.col("name"), F.lit("merged")).alias("new_name"), "head")
        named = materialize(named, "merges")
        lives = named.select(F.col("head.node_id").alias("node_id"), F.col("seq").alias("until")).join(there.filter("died is null").select("node_id", "born"), "node_id")
        written = _last(confirms, "confirmed", lives, F.col("until"))
        merged = named.join(written.withColumnRenamed("node_id", "head_id"), F.col("head.node_id") == F.col("head_id"), "left").select(
            F.col("new_id").alias("node_id"), "head.parent_id", F.col("new_name").alias("name"), F.lit("group").alias("kind"), (F.lit(1_000_000) + F.col("seq")).alias("position"), F.coalesce("written", "head.was").alias("confirmed"), F.col("seq").alias("born"), never.alias("died")
        )
        gone = merges.join(named.select("seq", "new_id"), "seq").select("node_id", "seq", "new_id", "born")

        splits = chosen.filter("operation = 'split'").select("seq", "node_id", "parent_id", "position", "born", F.posexplode("groups").alias("i", "g"))
        wanted = splits.select("seq", "node_id", "parent_id", "position", "born", (F.col("i") + 1).alias("part"), F.col("g.name").alias("name"), F.explode("g.paths").alias("path")).filter("path is not null")
        wanted = wanted.groupBy("seq", "node_id", "path").agg(F.min(F.struct("part", "name", "parent_id", "position", "born")).alias("x")).select("seq", "node_id", "path", "x.*")
        known = _known(inside, mounts)
        parts = wanted.join(known, ["node_id", "path"]).filter(_then(F.col("seq"))).groupBy("seq", "node_id", "part", "name", "parent_id", "position").agg(F.array_sort(F.collect_set("path")).alias("paths"))  # paths that the edit names
        parts = materialize(parts, "parts")
        several = parts.groupBy("seq").agg(F.count("*").alias("n")).filter("n >= 2").select("seq")
        parts = parts.join(several, "seq").withColumn("new_id", manual_id("split", F.concat_ws("|", "node_id", F.col("part").cast("string"), F.array_join("paths", "|"))))
        parted = parts.select(F.col("new_id").alias("node_id"), "parent_id", _label(F.col("name"), F.concat(F.lit("part "), F.col("part").cast("string"))).alias("name"), F.lit("group").alias("kind"), (F.col("position") + F.col("part")).alias("position"), F.lit(True).alias("confirmed"), F.col("seq").alias("born"), never.alias("died"))

        moved = gone.join(known, "node_id").filter(_then(F.col("seq"))).select(F.col("new_id").alias("node_id"), "path", F.col("seq").alias("since"))
        inside = materialize(inside.union(moved.distinct()).union(parts.select(F.col("new_id").alias("node_id"), F.explode("paths").alias("path"), F.col("seq").alias("since"))), "inside")
        ended = gone.select("node_id", "seq").union(parts.select("node_id", "seq")).groupBy("node_id").agg(F.min("seq").alias("ended"))
        there = materialize(there.join(ended, "node_id", "left").withColumn("died", F.coalesce("died", "ended")).drop("ended").union(merged).union(parted), "nodes")
        pending = materialize(pending.join(ready.select("seq"), "seq", "left_anti"), "pending")

    left = there.filter("died is null")
    lives = left.select("node_id", "born")
    forever = F.lit(1 << 62)
    names, marks = (_last(e, c, lives, forever) for e, c in ((renames, "name"), (confirms, "confirmed")))
    out = left.join(names.withColumnRenamed("written", "new_name"), "node_id", "left").join(marks.withColumnRenamed("written", "mark"), "node_id", "left")
    out = out.select("node_id", "parent_id", F.coalesce("new_name", "name").alias("name"), "kind", F.col("position").cast("int").alias("position"), F.coalesce("mark", "confirmed").alias("confirmed"))
    groups = left.select("node_id", "born", "kind")
    kept = _known(inside, mounts).join(groups, "node_id").filter("not mounted or (since > born and kind = 'group')").select("node_id", "path").distinct()
    return out, kept


def _known(inside: DataFrame, mounts: DataFrame) -> DataFrame:
    return inside.select("node_id", "path", "since", F.lit(False).alias("mounted")).union(mounts.select("node_id", "path", "since", F.lit(True)))


def _then(seq: Column) -> Column:
    """Whether a membership counts at that time: a path is added only to a node that is there."""
    return (F.col("since") < seq) & (~F.col("mounted") | (F.col("since") > F.col("born")))
