"""Whole triage jobs: from test rows to analysed logs to known issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import similarity as S
from ..functions.rules import ERROR_RULES
from ..functions.text import keyword_set, test_name_keywords
from ..operators import logscan as L
from ..operators import matching as M
from ..operators import warehouse as W
from ..operators.simjoin import similar_sets
from ..operators.skew import salted_join
from ..operators.stage import drop, staged

# Lines of a log report, matches per test in a batch and what it shows.
REPORT_TAIL = 50
BATCH_RESULTS = 5
BATCH_SHOWN = 3

#: What is told of a test beside its error.
ERROR_FIELDS = (
    "regression_run_id", "test_name", "status", "block_name", "num_error", "num_warning", "end_time",
)


def with_analysis(
    wh: W.Warehouse, tests: DataFrame, lines: DataFrame, rules=ERROR_RULES, tail: int | None = None
) -> DataFrame:
    """Tests with their log path and, where the log exists, its analysis as a record.

    Suite and test are known here (block and test name), so logs are analysed without
    looking for them, once per log however many tests share it. With ``tail`` the last lines
    of each log come along as ``log_tail``. All that is told of a log meets before the tests
    do, so no test carries one part of it to another.
    """
    starred = staged(tests)  # the star is evaluated once, before the commands are read
    tests = staged(W.with_log_path(wh, starred))
    drop(starred)
    lines = wanted_lines(lines, tests)
    if tail is not None:
        lines = staged(lines)  # read twice
    found = L.analyze_logs(lines, rules, detect=False).drop("suite", "test")
    found = found.select("log_file", F.struct(*[c for c in found.columns if c != "log_file"])
                         .alias("a"))
    if tail is not None:
        found = staged(found.join(L.log_tail_text(lines, tail), "log_file", "left"))
    # a log may be that of a third of all tests, or of none
    rows = salted_join(tests, found, ["log_file"], F.xxhash64("test_object_run_id"), how="left")
    words = F.col("a.error_keywords")
    return rows.withColumn(
        "analysis",
        F.when(F.col("a").isNotNull(), F.struct(
            F.col("block_name").alias("suite"), F.col("test_name").alias("test"),
            "a.signature", "a.tool", "a.line_number", "a.error_level", "a.error_line",
            "a.pattern_pos", "a.num_lines_scanned",
            F.when(F.size(words) > 0, words).otherwise(test_name_keywords("test_name"))
            .alias("error_keywords"),
        )),
    ).drop("a")


def wanted_lines(lines: DataFrame, tests: DataFrame) -> DataFrame:
    """Lines of the logs that some test refers to; nothing else of the logs is analysed.

    Their names are staged, so that Spark knows their size before it moves any line.
    """
    logs = staged(tests.select("log_file").where(F.col("log_file").isNotNull()).distinct())
    return lines.join(logs, "log_file", "left_semi")


def failed_tests_with_errors(wh: W.Warehouse, lines: DataFrame, **which) -> DataFrame:
    """Failed tests with signature, keywords, level, tool and path of their log."""
    rows = with_analysis(wh, W.failed_rows(wh, **which), lines)
    seen = F.col("analysis").isNotNull()
    return rows.select(
        *W.TEST_COLUMNS,
        F.when(seen, F.col("log_file")).alias("log_file"),
        "analysis.signature", F.col("analysis.error_keywords").alias("keywords"),
        "analysis.error_level", "analysis.tool",
    )


def test_details_with_errors(wh: W.Warehouse, lines: DataFrame, **which) -> DataFrame:
    """Newest row of each run and test name, with the full analysis of its log."""
    rows = with_analysis(wh, W.test_details(wh, **which), lines)
    seen = F.col("analysis").isNotNull()
    return rows.withColumn("log_file", F.when(seen, F.col("log_file")))


def test_log_report(wh: W.Warehouse, lines: DataFrame, **which) -> DataFrame:
    """Analysis and log tail of each test, or the reason why there is none."""
    tests = W.test_details(wh, **which).select(
        "regression_run_id", "test_object_run_id", "test_name", "block_name", "failed_job_run_ref")
    rows = with_analysis(wh, tests, lines, tail=REPORT_TAIL)
    no_path, no_log = F.col("log_file").isNull(), F.col("analysis").isNull()
    return rows.select(
        "regression_run_id", "test_object_run_id", "test_name", "log_file",
        F.when(no_path, "Log file path not found in database")
        .when(no_log, "Log file not accessible").alias("error"),
        F.when(~no_path & no_log, test_name_keywords("test_name")).alias("keywords"),
        "analysis", "log_tail",
    )


for _job in (test_details_with_errors, test_log_report):
    _job.__test__ = False  # not pytest cases


def test_errors(wh: W.Warehouse, tests: DataFrame, lines: DataFrame) -> DataFrame:
    """id, signature, error_keywords of each test, from its log or else from its name."""
    tests = tests.select("test_object_run_id", "failed_job_run_ref", *ERROR_FIELDS)
    rows = with_analysis(wh, tests, lines)
    name = F.col("test_name")
    by_name = F.when(
        F.col("failed_job_run_ref").isNotNull(),
        F.concat(F.lit("Test "), name, F.lit(" failed (log not accessible)")),
    ).otherwise(F.concat(F.lit("Test "), name, F.lit(" failed")))
    return rows.select(
        F.col("test_object_run_id").alias("id"),
        F.coalesce("analysis.signature", by_name).alias("signature"),
        F.coalesce("analysis.error_keywords", test_name_keywords("test_name"))
        .alias("error_keywords"),
        *ERROR_FIELDS,
    )


test_errors.__test__ = False


def find_solutions(
    wh: W.Warehouse, lines: DataFrame, issues: DataFrame, base_url: str = "",
    tests: DataFrame | None = None, max_results: int = 10, min_score: float = 0.3, **which,
) -> DataFrame:
    """Known issues for every test: one row per match, or one row without a match.

    The one-call report for all tests in one job. ``relevant_matches`` and
    ``top_match_score`` are per test.
    """
    if tests is None:
        tests = W.test_details(wh, **which)
    errors = staged(M.error_queries(test_errors(wh, tests, lines)))
    ranked = M.rank_matches(errors, issues, min_score, max_results, search=True)
    per_query = Window.partitionBy("query")
    ranked = staged(ranked.withColumn(
        "relevant_matches", F.count(F.lit(1)).over(per_query)
    ).withColumn("top_match_score", F.max("similarity_score").over(per_query)))
    found = issues.join(ranked.select("issue_key").distinct(), "issue_key", "left_semi")
    matches = ranked.join(M.issue_report(found, base_url), "issue_key").withColumnRenamed("status", "issue_status")
    # The texts of an error meet its matches once, not once per test.
    texts = errors.groupBy("query").agg(
        F.any_value("signature").alias("signature"), F.any_value("error_keywords").alias("error_keywords"))
    told = staged(texts.join(matches, "query", "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    # an error may be that of a third of all tests; its matches are few
    rows = salted_join(errors.drop("signature", "error_keywords"), told, ["query"], F.xxhash64("id"))
    return rows.select(
        F.col("id").alias("test_object_run_id"), "regression_run_id", "test_name", "status",
        "block_name", "num_error", "num_warning", "signature", "error_keywords",
        "rank", "issue_key", "summary", "description", "issue_status", "resolution",
        "similarity_score", "matching_keywords", "relevance_reason", "solution_summary", "link",
        zero("relevant_matches"), zero("top_match_score"),
    )


def batch_solutions(
    wh: W.Warehouse, lines: DataFrame, issues: DataFrame, base_url: str = "",
    limit: int | None = None, results: int = BATCH_RESULTS, shown: int = BATCH_SHOWN, **which,
) -> DataFrame:
    """The first ``shown`` of the ``results`` best matches of every failed test."""
    tests = W.failed_rows(wh, limit=limit, **which)
    found = find_solutions(wh, lines, issues, base_url, tests=tests, max_results=results)
    return (
        found.withColumn("has_solution", F.col("issue_key").isNotNull())
        .where(F.coalesce("rank", F.lit(1)) <= shown)
        .select("regression_run_id", "test_object_run_id", "test_name", "has_solution",
                "error_keywords", "rank", "issue_key", "similarity_score",
                "matching_keywords", "relevance_reason", "solution_summary")
    )


def batch_summary(
    wh: W.Warehouse, lines: DataFrame, issues: DataFrame, min_score: float = 0.3, **which
) -> DataFrame:
    """Failed tests of each run, and how many of them have a match.

    Whether an error has one is known from the ranked pairs; no report is made.
    """
    errors = staged(M.error_queries(test_errors(wh, W.failed_rows(wh, **which), lines)))
    ranked = M.rank_matches(errors, issues, min_score, 1, search=True)
    solved = ranked.select("query", F.lit(True).alias("solved"))
    # Equal errors of a run meet before the join.
    per_error = errors.groupBy("regression_run_id", "query").agg(F.count(F.lit(1)).alias("n"))
    found = F.coalesce("solved", F.lit(False))
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return per_error.join(solved, "query", "left").groupBy("regression_run_id").agg(
        F.sum("n").alias("total_failed_tests"),
        of(found).alias("tests_with_solutions"), of(~found).alias("tests_without_solutions"),
    )


def frequent_issues(
    wh: W.Warehouse, lines: DataFrame, issues: DataFrame, k: int | None = None,
    min_score: float = 0.3, **which,
) -> DataFrame:
    """Issues by the number of failed tests that they match, over all matches of a test.

    Distinct errors are counted with the tests that have them, then summed by issue, so no
    match is joined back to single tests. ``k`` keeps the most frequent ones only.
    """
    errors = staged(M.error_queries(test_errors(wh, W.failed_rows(wh, **which), lines)))
    ranked = M.rank_matches(errors, issues, min_score, None, search=True)
    tests = errors.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    counted = ranked.join(tests, "query").groupBy("issue_key").agg(F.sum("n").alias("n_tests"))
    return counted if k is None else counted.orderBy(F.desc("n_tests"), F.asc("issue_key")).limit(k)


def similar_failures(errors: DataFrame, min_score: float = 0.3, k: int | None = None) -> DataFrame:
    """For each family of failures, similar families that failed before its last failure.

    ``errors`` has signature, end_time. Failures with the same set of keywords form one
    family, with their number and times. A family counts among its own earlier ones if it
    failed more than once; a failure without an end time is later than all others, and
    a family that has no other has no time to be found by. ``k`` keeps the best of each.
    """
    seen = staged(
        errors.withColumn("words", F.array_sort(keyword_set("signature")))
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.min("signature").alias("signature"), F.count(F.lit(1)).alias("n_failures"),
             F.min("end_time").alias("first_seen"), F.max("end_time").alias("last_seen"),
             F.bool_or(F.col("end_time").isNull()).alias("open"))
        .withColumn("id", F.md5(F.array_join("words", " ")))
    )
    later = seen.select("id", "words")
    earlier = seen.where(F.col("first_seen").isNotNull()).select("id", "words")
    pairs = similar_sets(later, earlier, min_score / S.COMPARE_KEYWORD_WEIGHT)
    new = seen.select(F.col("id").alias("left_id"), "signature", F.col("last_seen").alias("at"), "open")
    old = seen.select(
        F.col("id").alias("right_id"), F.col("signature").alias("earlier_signature"),
        "n_failures", "first_seen", "last_seen",
    )
    score = F.col("n_both") / F.col("n_all") * S.COMPARE_KEYWORD_WEIGHT
    rank = F.row_number().over(
        Window.partitionBy("left_id").orderBy(
            F.desc("score"), F.desc("first_seen"), F.asc("earlier_signature"))
    )
    ranked = (
        pairs.join(new, "left_id").join(old, "right_id")
        .where(F.col("open") | (F.col("first_seen") < F.col("at")))
        .withColumn("score", score).where(F.col("score") >= min_score)
        .withColumn("rank", rank)
    )
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select("signature", "rank", "earlier_signature", "score", "n_failures",
                         "first_seen", "last_seen")
