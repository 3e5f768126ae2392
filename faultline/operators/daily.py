"""Issue statistics kept per day as states that merge, so that any span of days is read from
the days alone.

A day's state holds exact counts, sums and extremes beside sketches: quantiles (KLL) and
distinct numbers (HLL). Merged, a quantile's rank is off by at most RANK_ERROR (with 99 %
confidence), a distinct number by about DISTINCT_ERROR of itself; both are exact for small
numbers. New days are appended; a day that is loaded again replaces its own state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import similarity as S

DAY = 86_400
#: Size of a quantile sketch, and the error of a rank that follows from it.
QUANTILE_K = 400
RANK_ERROR = 0.01
#: Logarithm of a distinct sketch's size, and the standard error that follows from it.
DISTINCT_K = 12
DISTINCT_ERROR = 0.02


def issue_days(issues: DataFrame, created: str, updated: str) -> DataFrame:
    """day, status, resolution and the state of the issues last updated that day."""
    seconds = F.when(S.settled("status"), F.col(updated) - F.col(created)).cast("bigint")
    rows = issues.select(
        F.floor(F.col(updated) / DAY).cast("int").alias("day"), "status",
        F.coalesce("resolution", F.lit("Unresolved")).alias("resolution"), "project", seconds.alias("seconds"))
    return rows.groupBy("day", "status", "resolution").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count("seconds").alias("n_settled"),
        F.sum("seconds").alias("sum_seconds"), F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.kll_sketch_agg_bigint("seconds", QUANTILE_K).alias("quantiles"),
        F.hll_sketch_agg("project", DISTINCT_K).alias("projects"))


def over_days(days: DataFrame, first: int | None = None, last: int | None = None,
              by: tuple[str, ...] = ("status",)) -> DataFrame:
    """Statistics of a span of days, both ends included, from the states alone.

    Counts, averages, minimum and maximum are exact; ``median_seconds`` and ``n_projects``
    are estimates. Merging is associative, so partial sums meet before the shuffle.
    """
    if first is not None:
        days = days.where(F.col("day") >= first)
    if last is not None:
        days = days.where(F.col("day") <= last)
    merged = days.groupBy(*by).agg(
        F.sum("n_issues").alias("n_issues"), F.sum("n_settled").alias("n_settled"),
        F.sum("sum_seconds").alias("sum_seconds"), F.min("min_seconds").alias("min_seconds"),
        F.max("max_seconds").alias("max_seconds"),
        F.kll_merge_agg_bigint("quantiles").alias("quantiles"), F.hll_union_agg("projects").alias("projects"))
    some = F.col("n_settled") > 0
    return merged.select(
        *by, "n_issues", "n_settled",
        F.when(some, F.col("sum_seconds") / F.col("n_settled")).alias("avg_seconds"), "min_seconds", "max_seconds",
        F.when(some, F.kll_sketch_get_quantile_bigint("quantiles", F.lit(0.5))).alias("median_seconds"),
        F.hll_sketch_estimate("projects").alias("n_projects"))
