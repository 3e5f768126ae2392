"""Keeping one hot key from becoming one slow task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stage import staged

#: Rows of one key that a task may join; more are spread.
TASK_ROWS = 200_000


def salted_join(many: DataFrame, few: DataFrame, on: list[str], salt: Column,
                how: str = "inner", salts: int | None = None, task_rows: int = TASK_ROWS,
                counted: DataFrame | None = None, broadcast: bool = True) -> DataFrame:
    """Join rows to per-key facts with frequent keys spread over several tasks.

    ``few`` holds a bounded number of rows per key and is repeated once per salt; ``salt``
    is any integer expression on ``many`` that varies within a key. A key gets one salt per
    ``task_rows`` rows that ``many`` holds of it, which is counted first, so pass a staged
    or cheap table; a number of ``salts`` spares the count and gives every key so many, and
    so does ``counted``, a table of the keys and their number ``n`` of rows. Without
    ``broadcast`` Spark is told not to broadcast ``few``: a staged table of repeating texts
    packs so well that its size on disk says little about its size in memory.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if salts is not None:
        left = many.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
        return left.join(few.withColumn("_salt", every(F.lit(salts))), on + ["_salt"], how).drop("_salt")
    if counted is None:
        counted = many.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot = staged(
        counted.withColumnRenamed("n", "_n").where(F.col("_n") > task_rows)
        .select(*on, F.ceil(F.col("_n") / task_rows).cast("int").alias("_copies"))
    )  # short: at most one row per task_rows rows
    copies = F.coalesce("_copies", F.lit(1))
    missing = F.lit(False)
    for k in on:
        missing = missing | F.col(k).isNull()
    # Rows without a key match nothing and may lie anywhere.
    spread = F.when(missing, F.pmod(salt, F.lit(1024))).otherwise(F.pmod(salt, copies)).cast("int")
    left = many.join(hot, on, "left").withColumn("_salt", spread).drop("_copies")
    right = few.join(hot, on, "left").withColumn("_salt", every(copies)).drop("_copies")
    if not broadcast:
        right = right.hint("merge")
    return left.join(right, on + ["_salt"], how).drop("_salt")


def left_lookup(many: DataFrame, few: DataFrame, key: str | list[str], spread: Column) -> DataFrame:
    """Left join on a key, of one column or several, that is often missing.

    All missing keys would hash to one task; here they are spread by ``spread``. Frequent
    values are left to the skew handling of adaptive execution, which may split them, as
    nothing after the join needs its partitioning.
    """
    keys = [key] if isinstance(key, str) else key
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    left = many.withColumn("_spread", F.when(missing, F.xxhash64(spread)).otherwise(F.lit(0)))
    right = few.withColumn("_spread", F.lit(0).cast("bigint"))
    return left.join(right, [*keys, "_spread"], "left").drop("_spread")


def number_rows(df: DataFrame, key: str, order: list[str], slice_col: str, out: str) -> DataFrame:
    """Number the rows of each key from 1 without sorting a whole key in one task.

    ``slice_col`` cuts a key into ordered slices (a day, a file split). Rows are numbered
    inside a slice and shifted by the size of the slices before it; only the slice counts
    of a key ever meet in one task.
    """
    # One column for both, so that the join and the window need the rows moved once. Two records
    # with missing fields are equal; two missing values are not.
    df = df.withColumn("_slice", F.struct(key, slice_col))
    sizes = df.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(f"_slice.{key}").orderBy(f"_slice.{slice_col}").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_slice").orderBy(*order)
    return (
        df.join(shifts, "_slice")
        .withColumn(out, (F.row_number().over(inside) + F.col("_shift")).cast("int"))
        .drop("_shift", "_slice")
    )


def grid_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str,
              cell_rows: int, left_n: DataFrame | None = None, right_n: DataFrame | None = None) -> DataFrame:
    """Inner join on a key that may be frequent on both sides.

    A key with more than ``cell_rows`` rows on a side is laid out as a grid: each side is cut
    into parts by a hash of its id and repeated once per part of the other, so every pair
    meets in just one cell and no task takes more than a cell. Counts per key are measured;
    tables ``(key, n)`` that are there already spare that.
    """
    counted = lambda df, known, name: (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if known is None else known
    ).select(key, F.ceil(F.col("n") / cell_rows).cast("int").alias(name))
    hot = staged(
        counted(left, left_n, "_rows").join(counted(right, right_n, "_cols"), key)
        .where((F.col("_rows") > 1) | (F.col("_cols") > 1)))  # short: only frequent keys
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    pick = lambda i, c: F.pmod(F.xxhash64(i), one(c)).cast("int")
    a = left.join(hot, key, "left").withColumn("_r", pick(left_id, "_rows")).withColumn("_c", every("_cols"))
    b = right.join(hot, key, "left").withColumn("_c", pick(right_id, "_cols")).withColumn("_r", every("_rows"))
    return a.drop("_rows", "_cols").join(b.drop("_rows", "_cols"), [key, "_r", "_c"]).drop("_r", "_c")
