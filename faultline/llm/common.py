"""What the corpus operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.stage import staged

#: Documents handed to Python at once: bounds a worker's memory with long texts.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in small batches, so that long ones fit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def plain(docs: DataFrame, *added: str) -> DataFrame:
    """The input without columns that the operator adds or that begin with an underscore."""
    return docs.drop(*[c for c in docs.columns if c in added or c.startswith("_")])


def worker_state(name: str) -> dict:
    """A dictionary that a Python worker keeps from task to task, until one of another name is asked for."""
    module = sys.modules.setdefault("faultline_worker_state", types.ModuleType("faultline_worker_state"))
    states = module.__dict__.setdefault("states", {})
    for other in states.keys() - {name}:
        del states[other]
    return states.setdefault(name, {})


def no_worker_state() -> None:
    """What earlier tasks left in this Python worker goes, as what follows needs the memory."""
    worker_state("")


def with_row_id(df: DataFrame) -> DataFrame:
    """The rows staged with a number of their own, ``_rid``; its high bits name a slice."""
    return staged(df.withColumn("_rid", F.monotonically_increasing_id()))


def slice_of(rid: Column) -> Column:
    """The task that wrote a row and, within it, the run of 65,536 rows."""
    return F.shiftright(rid, 16)


def rank_in_group(rows: DataFrame, group: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0, without a whole group in one task.

    ``rows`` come from ``with_row_id``. They are numbered inside a slice of the table and
    shifted by the group's sizes in earlier slices; only those sizes meet per group.
    """
    rows = rows.withColumn("_slice", slice_of(F.col("_rid")))
    keys = [*group, "_slice"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys).orderBy("_rid")
    return (
        rows.withColumn("_at", F.row_number().over(inside) - 1)
        .join(shifts, keys)
        .withColumn(out, (F.col("_at") + F.col("_shift")).cast("long"))
        .drop("_at", "_shift", "_slice")
    )


class HashFilter:
    """A bit table of bounded size that lets the members of a set of hashes through, and some others.

    It only spares rows a shuffle: what passes is joined exactly afterwards. The table has
    one row of ``slots`` bits, so its broadcast never grows with the data.
    """

    def __init__(self, hashes: DataFrame, slots: int = 1 << 23):
        """``hashes`` has one column of hashes."""
        self.slots = slots
        slot = F.pmod(F.col(hashes.columns[0]), F.lit(slots))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
        words = hashes.select(F.floor(slot / 64).alias("id"), one.alias("bit")).groupBy("id").agg(
            F.bit_or("bit").alias("word"))
        # At most slots / 64 words make up the one row.
        all_words = hashes.sparkSession.range(slots // 64).join(words, "id", "left").select(
            F.struct("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word")).alias("w"))
        self.table = staged(all_words.agg(F.transform(
            F.sort_array(F.collect_list("w")), lambda w: w["word"]).alias("_bits")))

    def _join(self, df: DataFrame, value: Column, how: str) -> DataFrame:
        slot = F.pmod(value, F.lit(self.slots))
        word = F.get(self.table["_bits"], F.floor(slot / 64).cast("int"))
        hit = F.bit_get(word, F.pmod(slot, F.lit(64)).cast("int")) == 1
        return df.join(F.broadcast(self.table), hit, how)

    def keep(self, df: DataFrame, value: Column) -> DataFrame:
        """All rows with a member, and some others."""
        return self._join(df, value, "left_semi")

    def rest(self, df: DataFrame, value: Column) -> DataFrame:
        """The rows that ``keep`` leaves out; none has a member."""
        return self._join(df, value, "left_anti")


def row_key() -> Column:
    """Hash of what a verdict on a document may rest on."""
    return F.xxhash64("doc_id", "lang", "text")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose ``row_key`` is not among the ``_key`` of ``gone``.

    Only documents that a bounded filter can't clear are shuffled. Columns that begin with
    an underscore are dropped.
    """
    docs = plain(docs)
    gone = staged(gone.select("_key").distinct())
    maybe = HashFilter(gone)
    keyed = docs.withColumn("_key", row_key())
    clear = maybe.rest(keyed, F.col("_key"))
    rest = maybe.keep(keyed, F.col("_key")).join(gone, "_key", "left_anti")
    return clear.select(docs.columns).union(rest.select(docs.columns))
