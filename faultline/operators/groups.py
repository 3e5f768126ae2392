"""Groups of alike rows over a whole table: a similarity join, then connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as S
from .simjoin import similar_sets
from .skew import salted_join
from .stage import staged

_ID = "_id"


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One half round on distinct edges (u, v) with u > v.

    The large star links every larger neighbour of a node to the smallest node next to it,
    the small star links a node and its smaller neighbours to their smallest. Minima are
    found by a grouped aggregation and joined back with frequent nodes spread, so a node
    with very many neighbours is no single task.
    """
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    sides = edges.union(flipped) if larger else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    if larger:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = salted_join(flipped, least, ["u"], F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = salted_join(edges, least, ["u"], F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return staged(moved.where("u > v").distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) with the smallest reachable id, for every id in ``edges(u, v)`` that has a
    neighbour. Large and small stars alternate until neither changes an edge; the rounds
    grow with the logarithm of the longest path, not with the path.
    """
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = staged(turned.where("u > v").distinct())
    state = None
    while True:
        now = _stars(_stars(now, True), False)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(
            F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        roots.select("id", F.col("id").alias("root")))


def alike_groups(sets: DataFrame, threshold: float) -> DataFrame:
    """id, group_id, n_links for every row of ``sets(id, words)``.

    Two rows are linked when their word sets have a Jaccard similarity of ``threshold`` or
    more; rows that a chain of links joins form a group, named by its smallest id. A row
    without words, or like no other, is a group of its own. ``n_links`` counts the other rows
    that a row is linked with.

    Rows with equal sets are joined once, as one class, and take its group; no copies are
    expanded into pairs. Ids must be distinct and not missing.
    """
    rows = staged(sets.select("id", F.array_sort(F.array_distinct("words")).alias("words")))
    classes = staged(
        rows.where(F.size("words") > 0).groupBy("words")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    pairs = staged(
        similar_sets(classes.select("id", "words"), classes.select("id", "words"), threshold)
        .where("left_id <> right_id").select(F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    roots = connected(pairs)
    sizes = classes.select(F.col("id").alias("v"), "n")
    links = salted_join(pairs, sizes, ["v"], F.xxhash64("u")).groupBy("u").agg(F.sum("n").alias("more"))
    named = (
        classes.join(roots, "id", "left")
        .join(links.withColumnRenamed("u", "id"), "id", "left")
        .select("words", F.coalesce("root", "id").alias("group_id"),
                (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    )
    # A third of all rows may share one set; the classes' side has one row of each.
    found = salted_join(rows.where(F.size("words") > 0), staged(named), ["words"], F.xxhash64("id"))
    alone = rows.where(F.size("words") == 0).select(
        "id", F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links"))
    return found.select("id", "group_id", "n_links").union(alone)


def text_groups(rows: DataFrame, text: str, threshold: float,
                words: Callable[[str], Column], weight: float = S.COMPARE_KEYWORD_WEIGHT) -> DataFrame:
    """Groups of rows ``(id, <text>)`` whose texts compare at ``threshold`` or more by the score
    ``weight`` times keyword Jaccard, as two errors are compared."""
    if not 0 < threshold <= weight:
        raise ValueError(f"the threshold must be above 0 and at most {weight}, the best score there is")
    return alike_groups(rows.select("id", words(text).alias("words")), threshold / weight)


def group_report(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """What a group is about: group_id, n_rows, n_texts, and its most frequent text, ties to the
    smallest. ``rows`` has id and text; counts per text meet before groups do."""
    per_text = rows.join(groups.select("id", "group_id"), "id").groupBy("group_id", "text").agg(
        F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("cost"), "text"))
    return per_text.groupBy("group_id").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"), best.alias("b")
    ).select("group_id", "n_rows", "n_texts", F.col("b.text").alias("text"), (-F.col("b.cost")).alias("n_text"))
