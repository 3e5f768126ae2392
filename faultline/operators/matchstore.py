"""Matches kept by error fingerprint, and brought up to date by what is new.

A stored table holds the ranked matches of all errors known so far. A later run brings new
errors, and the tracker new or changed issues. Only new errors x all issues and known errors
x those issues are matched; the result equals a full computation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .matching import error_queries, rank_matches
from .stage import staged


def all_matches(errors: DataFrame, issues: DataFrame, max_results: int | None = 10, **how) -> DataFrame:
    """The matches of distinct errors, to be stored: what ``rank_matches`` returns."""
    return rank_matches(staged(distinct_errors(errors)), issues, max_results=max_results, **how)


def distinct_errors(errors: DataFrame) -> DataFrame:
    """query, signature, error_keywords, once per fingerprint."""
    return error_queries(errors.select("signature", "error_keywords")).groupBy("query").agg(
        F.any_value("signature").alias("signature"), F.any_value("error_keywords").alias("error_keywords"))


def updated_matches(
    stored: DataFrame, known: DataFrame, errors: DataFrame, issues: DataFrame, touched: DataFrame,
    max_results: int | None = 10, **how,
) -> tuple[DataFrame, DataFrame]:
    """The stored matches after an update, and the errors then known.

    ``stored`` and ``known`` (query, signature, error_keywords) are from the last time,
    ``errors`` are those of new runs, ``issues`` all issues as they are now, and ``touched``
    has the ``issue_key`` of each that is new, changed or gone. ``how`` is passed on to
    ``rank_matches`` and must be the same every time.

    Matches with touched issues are dropped and found again among the touched. Where a full
    list has lost one, a match that was cut off may move up, so those few errors are matched
    with all issues; every other list keeps what it had.
    """
    touched = staged(touched.select("issue_key").distinct())
    new = staged(distinct_errors(errors).join(known.select("query"), "query", "left_anti"))
    kept = stored.join(touched, "issue_key", "left_anti")
    changed = staged(issues.join(touched, "issue_key", "left_semi"))
    again = new
    if max_results is not None:
        full = stored.where(F.col("rank") == max_results).select("query")
        short = stored.join(touched, "issue_key", "left_semi").select("query").distinct().join(full, "query", "left_semi")
        short = staged(short)
        again = staged(new.union(known.join(short, "query", "left_semi").select(new.columns)))
        kept = kept.join(short, "query", "left_anti")
        known_left = known.join(short, "query", "left_anti")
    else:
        known_left = known
    cols = stored.columns
    fresh = rank_matches(again, issues, max_results=max_results, **how).select(cols)
    more = rank_matches(staged(known_left), changed, max_results=max_results, **how).select(cols)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity_score"), "issue_key"))
    merged = kept.select(cols).union(more).withColumn("rank", rank)
    if max_results is not None:
        merged = merged.where(F.col("rank") <= max_results)
    return merged.select(cols).union(fresh), known.select(new.columns).union(new)
