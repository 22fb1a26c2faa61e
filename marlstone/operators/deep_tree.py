"""Trees of any depth as a table of nodes and their parents.

Ways to the root are doubled in each round (a node's jump of 2k levels is two jumps
of k), so a chain of a thousand folders takes ten rounds, and no round looks at more
than a row for each node or each pair that it has already found. Nothing depends on
paths as text: a node is known by its id, and its parent by that one's.

nodes: node_id (each once), parent_id (null, or an id that no node has, for a root).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, running_sum


def _jumps(nodes: DataFrame, weight: Column) -> DataFrame:
    """node_id, up (its parent, if that is a node), weight."""
    own = nodes.select("node_id", "parent_id", weight.alias("weight"))
    there = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    return own.join(there, "parent_id", "left").select("node_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), "weight")


def sums_to_root(nodes: DataFrame, weight: Column, name: str) -> DataFrame:
    """node_id, and the sum of a weight over the node and all above it."""
    jumps, rounds = materialize(_jumps(nodes, weight), "jumps"), nodes.count().bit_length() + 1
    while not jumps.filter("up is not null").isEmpty():
        if not rounds:
            raise ValueError("a node is above itself")
        above = jumps.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("weight").alias("more"))
        jumps = materialize(jumps.join(above, "up", "left").select("node_id", F.col("next").alias("up"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight")), "jumps")
        rounds -= 1
    return jumps.select("node_id", F.col("weight").alias(name))


def depths(nodes: DataFrame) -> DataFrame:
    """node_id, depth (0 for a root)."""
    return sums_to_root(nodes, F.lit(1).cast("long"), "n").select("node_id", (F.col("n") - 1).alias("depth"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id, distance (1 for the parent) for each node and all above it."""
    jumps, rounds = materialize(_jumps(nodes, F.lit(0)).filter("up is not null").select("node_id", "up"), "jumps"), nodes.count().bit_length() + 1
    found, step = jumps.select("node_id", F.col("up").alias("ancestor_id"), F.lit(1).cast("long").alias("distance")), 1
    while not jumps.isEmpty():
        if not rounds:
            raise ValueError("a node is above itself")
        further = jumps.select(F.col("node_id").alias("ancestor_id"), F.col("up").alias("next"))
        more = found.join(further, "ancestor_id").select("node_id", F.col("next").alias("ancestor_id"), (F.col("distance") + step).alias("distance"))
        found = materialize(found.union(more), "ancestors")
        twice = jumps.select(F.col("node_id").alias("up"), F.col("up").alias("next"))
        jumps = materialize(jumps.join(twice, "up").select("node_id", F.col("next").alias("up")), "jumps")
        step, rounds = 2 * step, rounds - 1
    return found


def rolled_up(nodes: DataFrame, above: DataFrame, figures: DataFrame) -> DataFrame:
    """Sums of the figures (node_id and numbers, one row a node or none) over each node and all below it; nodes without any have nought."""
    names = [c for c in figures.columns if c != "node_id"]
    upward = figures.join(above.select("node_id", "ancestor_id"), "node_id").select(F.col("ancestor_id").alias("node_id"), *names)
    sums = figures.select("node_id", *names).union(upward).groupBy("node_id").agg(*(F.sum(c).alias(c) for c in names))
    return nodes.select("node_id").join(sums, "node_id", "left").select("node_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def pre_order(nodes: DataFrame, above: DataFrame, order: list[str]) -> DataFrame:
    """node_id, place (from 1): each node before those below it, siblings and roots in the order given (columns of nodes, none called size), then by id.

    A node stands behind its parent, and behind all that is below its earlier
    siblings; the steps from the root down are added up along the way.
    """
    sizes = rolled_up(nodes, above, nodes.select("node_id", F.lit(1).cast("long").alias("size")))
    nodes = nodes.drop("size")
    there = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    own = nodes.join(sizes, "node_id").join(there, "parent_id", "left").withColumn("group", F.when(F.col("known"), F.col("parent_id")))
    keys = [c for c in dict.fromkeys(order) if c not in ("node_id", "parent_id", "size")]
    keyed = own.select("node_id", "parent_id", F.col("group").isNotNull().alias("inner"), F.coalesce("group", F.lit("")).alias("group"), "size", *keys)
    dealt = materialize(running_sum(keyed, ["inner", "group", *keys, "node_id"], F.col("size"), "upto"), "siblings")
    first = dealt.groupBy("inner", "group").agg(F.min(F.col("upto") - F.col("size")).alias("before"))
    steps = dealt.join(first, ["inner", "group"]).select("node_id", "parent_id", (F.col("upto") - F.col("size") - F.col("before") + 1).alias("step"))
    return sums_to_root(steps, F.col("step"), "place")


def pruned(nodes: DataFrame, above: DataFrame, kept: DataFrame) -> DataFrame:
    """The nodes that are kept (node_id) and all above them, with the number of kept children of each."""
    wanted = kept.select("node_id").distinct()
    stay = materialize(wanted.union(above.join(wanted, "node_id", "left_semi").select(F.col("ancestor_id").alias("node_id"))).distinct(), "stay")
    files = nodes.join(wanted, "node_id", "left_semi").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kept_files"))
    return nodes.join(stay, "node_id", "left_semi").join(files, "node_id", "left").withColumn("kept_files", F.coalesce("kept_files", F.lit(0)))


def first_of_id(nodes: DataFrame, places: DataFrame, name: str, value: str) -> DataFrame:
    """Of all nodes whose column has the value, the one that comes first in pre-order."""
    return nodes.filter(F.col(name) == F.lit(value)).join(places, "node_id").orderBy("place").limit(1)
