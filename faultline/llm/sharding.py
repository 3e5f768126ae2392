"""Sharding by minimax contiguous partition of atomic groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.stage import staged
from .common import plain, rank_in_group, with_row_id

#: Bits of the group key that one look resolves in a run.
LEVEL_BITS = 9


class Runs:
    """The ordered groups seen at the detail needed so far.

    A run is a range of keys with its total size, number of groups and largest group. A
    run of one group is atomic. One look replaces some runs, of which there are never more
    than two a cut, by at most 2**LEVEL_BITS parts each.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.runs = self._look([(None, None)], 64 - LEVEL_BITS)

    def _look(self, ranges: list[tuple], shift: int) -> list[tuple]:
        key, g, number = F.col("key"), self.groups, F.lit(0)
        if ranges[0][0] is not None:
            wanted = key.between(*ranges[0])
            for lo, hi in ranges[1:]:  # at most two a cut
                wanted = wanted | key.between(lo, hi)
                number = number + (key >= lo).cast("int")
            g = g.where(wanted)
        rows = g.groupBy(number.alias("range"), F.shiftright(key, shift).alias("part")).agg(
            F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("size"),
            F.count(F.lit(1)).alias("n"), F.max("size").alias("most"),
        ).collect()  # at most 2**LEVEL_BITS rows a range
        return sorted((r.lo, r.hi, int(r.size), r.n, int(r.most)) for r in rows)

    def refine(self, wanted: set[int]) -> None:
        spans = sorted(self.runs[i][:2] for i in wanted)
        width = max(hi - lo for lo, hi in spans)
        finer = self._look(spans, max(0, width.bit_length() - LEVEL_BITS + 1))
        rest = [r for i, r in enumerate(self.runs) if i not in wanted]
        self.runs = sorted(rest + finer)


def ends(runs: list[tuple], shards: int, cap: int, divisible: bool) -> list[int] | None:
    """Greedy filling: the run index where each shard ends, or None if the rest won't fit.

    ``divisible`` lets a run of several groups be cut anywhere, which can only help; else
    runs stay whole, which can only hurt.
    """
    out, left, used = [], cap, 1
    for i, (_, _, size, n, most) in enumerate(runs):
        if divisible and n > 1:
            while size > left and used <= shards:
                size -= left
                out.append(i)
                used, left = used + 1, cap
        elif size > left:
            out.append(i)
            used, left = used + 1, cap
        if used > shards or size > cap:
            return None
        left -= size
    return out


def smallest(runs: list[tuple], shards: int, divisible: bool, low: int = 0, high: int | None = None) -> int:
    """Binary search for the smallest capacity that the greedy check accepts, from ``low`` on;
    ``high`` is known to be accepted."""
    total = sum(r[2] for r in runs)
    low = max(low, -(-total // shards), max(r[4] for r in runs))
    high = total if high is None else high
    while low < high:
        mid = (low + high) // 2
        if ends(runs, shards, mid, divisible) is None:
            low = mid + 1
        else:
            high = mid
    return low


def plan(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the last key of each shard but the last.

    ``groups`` holds one row (key bigint, size bigint) per atomic group; shards are
    contiguous in key order. The binary search runs on the driver over runs of groups, a
    bounded summary. What it knows bounds the capacity from both sides; the one halfway is
    decided next, for which only the runs that its cuts fall in are looked into: at most two
    a cut, whatever the groups.
    """
    runs = Runs(groups)
    if not runs.runs:
        return 0, []
    low, high = 0, None
    while True:
        low = smallest(runs.runs, shards, True, low, high)
        high = smallest(runs.runs, shards, False, low, high)
        if low == high:  # filling whole runs reaches the bound, so no finer cut can beat it
            return low, [runs.runs[i - 1][1] for i in ends(runs.runs, shards, low, False)]
        middle = (low + high) // 2
        runs.refine({i for d in (True, False) for i in _cuts(runs.runs, shards, middle, d) if runs.runs[i][3] > 1})


def _cuts(runs: list[tuple], shards: int, cap: int, divisible: bool) -> list[int]:
    """Where greedy shards end at this capacity, as far as ``shards`` of them reach."""
    out, left = [], cap
    for i, (_, _, size, n, _) in enumerate(runs):
        while size > left and len(out) < shards:
            out.append(i)
            size = size - left if divisible and n > 1 else min(size, cap)
            left = cap
        left -= size
    return out


def shard_of(key: Column, cuts: list[int]) -> Column:
    """The shard of a group key: how many cuts lie below it."""
    out = F.lit(0)
    for c in cuts:
        out = out + (key > F.lit(c)).cast("int")
    return out


def group_key(text: Column) -> Column:
    """Groups are equal texts, ordered by the text's hash."""
    return F.xxhash64(text)


def shard(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """Adds ``size``, ``shard`` and the row's place ``slot`` in it, and drops no row.

    Size is the text's UTF-8 bytes plus 1. Equal texts form a group that no cut divides;
    a missing text counts as an empty one. Groups are ordered by the hash of their text
    and cut where the greedy check of the smallest feasible capacity cuts. Slots count
    from 0 without gaps in every shard, repeated rows included. An empty table gives an
    empty table; input columns of the added names, or that begin with an underscore, are
    dropped.

    Rows are shuffled once, to their place in the shard; cuts are found on (key, size).
    """
    content = F.coalesce(F.col(text), F.lit(""))
    docs = plain(docs, "size", "shard", "slot")
    rows = with_row_id(docs.withColumn("_key", group_key(content)).withColumn(
        "size", (F.octet_length(content) + 1).cast("long")))
    return place(rows, shards)


def place(rows: DataFrame, shards: int) -> DataFrame:
    """Shard and slot for rows with ``_key``, ``size`` and ``_rid``."""
    groups = rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("size"))
    # In key order, so that a look at some ranges reads little else.
    groups = staged(groups.repartitionByRange("key").sortWithinPartitions("key"))
    _, cuts = plan(groups, shards)
    put = rows.withColumn("shard", shard_of(F.col("_key"), cuts))
    return rank_in_group(put, ["shard"], "slot").drop("_key", "_rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    content = F.coalesce(F.col("text"), F.lit(""))
    rows = with_row_id(documents(spark, sf_dir).select(
        "doc_id", group_key(content).alias("_key"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    ))
    return place(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
