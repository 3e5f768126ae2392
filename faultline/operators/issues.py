"""Queries over the issue table, its comments and links."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity as S
from ..functions.text import issue_link
from .matching import in_project, with_status
from .skew import number_rows, salted_join

# Default result sizes.
SEARCH_RESULTS = 50
TEXT_RESULTS = 20

# How a long thread or a span of seconds is cut into parts that fit a task.
THREAD_SLICE = 10_000
DAY = 86_400


def _newest(issues: DataFrame, limit: int | None, updated: str) -> DataFrame:
    if limit is None:
        return issues
    return issues.orderBy(F.desc_nulls_last(updated), F.asc("issue_key")).limit(limit)


def search_issues(
    issues: DataFrame, where: str | Column, max_results: int | None = SEARCH_RESULTS,
    updated: str = "updated",
) -> DataFrame:
    """Issues a Spark predicate selects, latest update first."""
    return _newest(issues.where(where), max_results, updated)


def search_text(
    issues: DataFrame, text: str, status: str | None = None, project: str | None = None,
    max_results: int | None = TEXT_RESULTS, updated: str = "updated",
) -> DataFrame:
    """Issues that hold every word of the text, short and common ones too.

    A text without a word finds nothing. ``max_results`` None gives all.
    """
    words = sorted(set(re.findall(r"\w+", text.lower())))
    if not words:
        return issues.where(F.lit(False))
    found = with_status(in_project(issues, project), status)
    whole = F.lower(F.concat_ws(" ", "summary", "description", F.array_join("labels", " ")))
    for w in words:  # cheap, and all that the words must pass
        found = found.where(F.contains(whole, F.lit(w)))
    held = F.regexp_extract_all(whole, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    asked = F.array(*[F.lit(w) for w in words])
    return _newest(found.where(F.size(F.array_except(asked, held)) == 0), max_results, updated)


def search_labels(
    issues: DataFrame, labels: list[str], match_all: bool = False,
    max_results: int | None = TEXT_RESULTS, updated: str = "updated",
) -> DataFrame:
    """Issues with any, or all, of the labels; no labels select nothing."""
    if not labels:
        return issues.where(F.lit(False))
    asked = F.array(*[F.lit(x) for x in labels])
    if match_all:
        found = F.size(F.array_except(asked, F.col("labels"))) == 0
    else:
        found = F.arrays_overlap(asked, F.col("labels"))
    return _newest(issues.where(found), max_results, updated)


def issue_comments(comments: DataFrame, issue_key: str | None = None) -> DataFrame:
    """Comments with their position in the thread, one row each.

    A thread stays a set of rows: positions come from slices of the sequence number, so
    a thread of any length is never gathered.
    """
    if issue_key is not None:
        comments = comments.where(F.col("issue_key") == issue_key)
    cut = comments.withColumn("slice", F.floor(F.col("seq") / THREAD_SLICE))
    return number_rows(cut, "issue_key", ["seq"], "slice", "position").drop("slice")


def with_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Issues with what the text functions need of their comments.

    first_comments: the first three; match_comments and issue_comments: the first one
    that holds a solution word (of either list), as arrays of at most one; n_comments.
    """
    rank = F.row_number().over(Window.partitionBy("issue_key").orderBy("seq"))
    first = (
        comments.select("issue_key", "seq", "body")
        .withColumn("n", rank).where(F.col("n") <= S.TEXT_COMMENTS)
        .groupBy("issue_key")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("first_comments"))
    )
    low = F.lower("body")
    telling = lambda words: F.min(
        F.when(S.holds_any(low, words), F.struct("seq", "body")))
    told = comments.groupBy("issue_key").agg(
        F.count(F.lit(1)).alias("n_comments"),
        telling(S.MATCH_SOLUTION_WORDS).alias("m"), telling(S.ISSUE_SOLUTION_WORDS).alias("i"),
    )
    return (
        issues.join(first, "issue_key", "left").join(told, "issue_key", "left")
        .withColumns({
            "match_comments": F.array_compact(F.array("m")),
            "issue_comments": F.array_compact(F.array("i")),
            "n_comments": F.coalesce("n_comments", F.lit(0)),
        })
        .drop("m", "i")
    )


def issue_details(
    issues: DataFrame, comments: DataFrame | None = None, issue_key: str | None = None
) -> DataFrame:
    """Issues with the sentence that tells the solution; ``issue_comments`` has the thread."""
    if issue_key is not None:
        issues = issues.where(F.col("issue_key") == issue_key)
        if comments is not None:
            comments = comments.where(F.col("issue_key") == issue_key)
    if comments is None:
        return issues.withColumn("solution_summary", S.solution_for_issue())
    return with_comments(issues, comments).withColumn(
        "solution_summary", S.solution_for_issue(comments="issue_comments")
    ).drop("first_comments", "match_comments", "issue_comments")


def related_issues(issues: DataFrame, links: DataFrame, base_url: str) -> DataFrame:
    """Linked issues of each issue, with what the link says in its direction.

    ``links`` has src_key, dst_key, direction (outward or inward) and the names of its type,
    ``outward`` and ``inward``. A linked issue outside the table keeps its link, without a
    summary and with the status Unknown. Links to a hub are spread by their source.
    """
    other = issues.select(F.col("issue_key").alias("dst_key"), "summary", "status")
    said = F.when(F.col("direction") == "outward", F.col("outward")).otherwise(F.col("inward"))
    return salted_join(links, other, ["dst_key"], F.xxhash64("src_key"), how="left").select(
        F.col("src_key").alias("issue_key"), F.col("dst_key").alias("key"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("status", F.lit("Unknown")).alias("status"),
        F.coalesce(said, F.lit("relates to")).alias("relation"),
        issue_link(base_url, "dst_key").alias("link"),
    )


def project_info(projects: DataFrame, base_url: str, key: str | None = None) -> DataFrame:
    if key is not None:
        projects = projects.where(F.col("key") == key)
    return projects.select(
        "key", "name", "description", "lead", issue_link(base_url, "key").alias("url")
    )


def solution_sentences(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Every sentence of a description or comment that speaks of a solution."""
    said = issues.select(
        "issue_key", F.lit(-1).cast("bigint").alias("seq"), F.col("description").alias("body")
    ).unionByName(comments.select("issue_key", "seq", "body"))
    return (
        said.where(F.lower("body").rlike("|".join(S.ISSUE_SOLUTION_WORDS)))
        .select("issue_key", "seq", F.posexplode(F.split("body", "\\.")).alias("pos", "s"))
        .where(F.lower("s").rlike("|".join(S.ISSUE_SOLUTION_WORDS)))
        .select("issue_key", "seq", "pos", S.strip("s").alias("sentence"))
    )


def issue_stats(issues: DataFrame) -> DataFrame:
    """Issue counts by status and resolution, with subtotals and a total."""
    rows = issues.select(
        "status", F.coalesce("resolution", F.lit("Unresolved")).alias("resolution")
    )
    return rows.rollup("status", "resolution").agg(F.count(F.lit(1)).alias("n_issues"))


def _median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of whole numbers per key: first by day, then inside one or two days.

    No key is sorted as a whole; per key only its days meet, and then the values of the
    days that hold the middle.
    """
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "day", F.floor(F.col(value) / DAY)
    )
    whole = Window.partitionBy(key)
    upto = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = counts.groupBy(key, "day").agg(F.sum("n").alias("in_day"))
    days = days.withColumn("before", F.coalesce(F.sum("in_day").over(upto), F.lit(0)))
    days = days.withColumn("total", F.sum("in_day").over(whole))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = days.where(
        (F.col("before") <= high) & (F.col("before") + F.col("in_day") > low)
    ).drop("in_day")
    inside = Window.partitionBy(key, "day").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    near = counts.join(middle, [key, "day"]).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    at = lambda r: F.max(
        F.when((F.col("start") <= r) & (r < F.col("start") + F.col("n")), F.col(value)))
    return near.groupBy(key).agg(((at(low) + at(high)) / 2).alias(f"median_{value}"))


def resolution_time(issues: DataFrame, created: str, updated: str) -> DataFrame:
    """Seconds from creation to last update of settled issues, by status."""
    took = (F.col(updated) - F.col(created)).alias("seconds")
    rows = issues.where(S.settled("status")).select("status", took)
    basic = rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_issues"),
        F.avg("seconds").alias("avg_seconds"),
        F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
    )
    return basic.join(_median(rows, "status", "seconds"), "status", "left")
