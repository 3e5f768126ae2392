"""Connected components by rounds of hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.stage import staged


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (node, root): the smallest node reachable, for nodes with an edge.

    Each round hooks every node to its smallest neighbour if that is smaller, jumps to
    the roots of the trees so made, and goes on with the edges between roots. A root that
    still has an edge has swallowed a node or is about to, so their number falls at least
    by half in two rounds. Every step is a join or a grouped minimum, written down.
    """
    edges = staged(edges.where("u <> v").select("u", "v").distinct())
    found = None
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = staged(both.groupBy("u").agg(F.min("v").alias("v")).select(
            F.col("u").alias("node"), F.least("u", "v").alias("root")))
        step = roots(step)
        found = step if found is None else staged(
            found.join(step.select(F.col("node").alias("root"), F.col("root").alias("_next")), "root", "left")
            .select("node", F.coalesce("_next", "root").alias("root")))
        name = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        edges = staged(
            edges.join(name("u"), "u").join(name("v"), "v").where("_u <> _v")
            .select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct())
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) with root a parent that is no larger: jump until it is a root."""
    while True:
        up = parents.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = staged(parents.join(up, "root", "left").select(
            "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        moved = jumped.where("_moved").limit(1).count()
        parents = jumped.drop("_moved")
        if not moved:
            return parents
