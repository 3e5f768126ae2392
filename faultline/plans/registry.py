"""Every operator as a named query over the driver's tables.

Results are flat: arrays and maps are joined to text, records become columns, so that
any engine can compare them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions.rules import ERROR_RULES, Rule
from ..operators import daily as D
from ..operators import groups as G
from ..operators import history as H
from ..operators import index as X
from ..operators import issues as I
from ..operators import logscan as L
from ..operators import matching as M
from ..operators import matchstore as MS
from ..operators import rulesets as RS
from ..operators import warehouse as W
from ..operators.tfidf import tfidf_cosine, tfidf_search
from ..operators.stage import staged
from ..sources.logs import existing_logs
from . import triage as P
from .fixtures import TRACKER, Inputs

# Arguments of the parameterised queries; the oracle uses the same values.
NAME_KEYWORD = "ring"
SEARCH_LIMIT = 10
LINE_LIMIT = 30
SIMILAR_LIMIT = 5
END_BYTES = 2000
SEARCH_WORDS = ("workaround", "restart", "scum")
SEARCH_TEXT = "workaround restart"
SEARCH_SHORT = "to IS"
LABELS = ("fr", "src1")
GROUP_THRESHOLD = 0.25
LOW_SCORE = 0.17
COSINE_RESULTS = 5
HISTORY = 3
ALL_KEYWORDS = 10
CUSTOM_RULES = (
    Rule(r"tool[0-4]$", 6, "custom:tool"),
    Rule(r"^info purchase", 2, "custom:purchase"),
) + ERROR_RULES

SEP = " "


@lru_cache(maxsize=8)
def _inputs(app_id: str, sf_dir: str, spark: SparkSession) -> Inputs:
    return Inputs(spark, sf_dir)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays and maps as text."""
    cols = []
    for name, kind in df.dtypes:
        if kind == "array<string>":
            cols.append(F.array_join(name, SEP).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def _record(df: DataFrame, name: str) -> DataFrame:
    fields = [c for c in df.columns if c != name]
    return df.select(*fields, f"{name}.*")


def _errors_of_logs(x: Inputs) -> DataFrame:
    a = L.analyze_logs(x.log_lines)
    return a.select(F.col("log_file").alias("id"), "signature", "error_keywords")


def _linked(x: Inputs) -> DataFrame:
    """Pairs of linked issues: texts of both ends."""
    side = lambda p: x.issues.select(
        F.col("issue_key").alias(f"{p}_key"), F.col("summary").alias(f"{p}_summary"),
        F.col("description").alias(f"{p}_description"), F.col("status").alias(f"{p}_status"),
        F.col("labels").alias(f"{p}_labels"),
    )
    return x.issue_links.select("src_key", "dst_key").join(side("src"), "src_key").join(
        side("dst"), "dst_key"
    )


# ------------------------------------------------------------------------ warehouse


def status_map(x):
    return W.status_map(x.warehouse)


def run_dims(x):
    return W.run_dims(x.warehouse)


def failed_tests(x):
    return W.failed_tests(x.warehouse)


def test_details(x):
    return W.test_details(x.warehouse)


def log_paths(x):
    return W.log_paths(x.warehouse)


def run_header(x):
    return W.run_header(x.warehouse)


def status_counts(x):
    return W.status_counts(x.warehouse)


def regression_summary(x):
    s = W.regression_summary(x.warehouse)
    entries = F.transform(
        F.array_sort(F.map_entries("by_status")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return s.withColumn("by_status", F.array_join(entries, SEP))


def search_tests_run(x):
    return W.search_tests(x.warehouse, NAME_KEYWORD, limit=SEARCH_LIMIT)


def search_tests_recent(x):
    return W.search_tests_recent(x.warehouse, NAME_KEYWORD, limit=SEARCH_LIMIT)


def search_tests_all(x):
    names = X.Index.of(X.name_tokens(x.warehouse.test))
    return W.search_tests(x.warehouse, NAME_KEYWORD, limit=None, names=names)


def latest_run_with_test_all(x):
    return W.latest_run_with_test(x.warehouse, None)


def job_details(x):
    j = W.job_details(x.warehouse)
    command = [F.col(f"command.{c}").alias(f"command_{c}") for c in (
        "cmd_id", "cmd", "log_file", "exit_code", "start_time", "end_time", "host")]
    return j.select(*[c for c in j.columns if c != "command"], *command)


def runs_by_regression(x):
    return W.runs_by_regression(x.warehouse)


def list_runs(x):
    return W.list_runs(x.warehouse)


def latest_runs(x):
    return W.latest_runs(x.warehouse)


def latest_run_with_test(x):
    return W.latest_run_with_test(x.warehouse)


def failed_tests_with_errors(x):
    return P.failed_tests_with_errors(x.warehouse, x.log_lines)


def test_details_with_errors(x):
    d = P.test_details_with_errors(x.warehouse, x.log_lines)
    return _record(d.drop("mem_usage", "lsf_req_mb", "random_seed"), "analysis")


# ----------------------------------------------------------------------------- logs


def log_lines(x):
    return x.log_lines


def lines_of_text(x):
    return x.text_lines


def ignored_lines(x):
    return L.ignored_lines(x.log_lines)


def classified_lines(x):
    return L.classified_lines(x.log_lines)


def warnings_as_errors(x):
    return L.warnings_as_errors(x.log_lines)


def log_fileentity(x):
    return L.log_identity(x.log_lines)


def tool_events(x):
    return L.tool_events(x.log_lines)


def first_error(x):
    return L.first_error(x.log_lines)


def analyze_failure(x):
    return L.analyze_logs(x.log_lines).select(*L.RECORD)


def analyze_failure_capped(x):
    return L.analyze_logs(x.log_lines, max_lines=LINE_LIMIT).select(*L.RECORD)


def head_tail_lines(x):
    return L.head_tail_lines(x.log_lines, END_BYTES)


def all_errors(x):
    return L.all_errors(x.log_lines)


def log_tail(x):
    return L.log_tail_text(x.log_lines, P.REPORT_TAIL)


def error_context(x):
    worst = L.analyze_logs(x.log_lines).where(F.col("line_number") > 0)
    hits = worst.select("log_file", F.col("line_number").alias("error_line"))
    return L.error_context(x.log_lines, hits)


def has_error(x):
    return L.has_error(x.log_lines)


def test_log_report(x):
    r = P.test_log_report(x.warehouse, x.log_lines)
    return r.select(
        "regression_run_id", "test_object_run_id", "test_name", "log_file", "error", "keywords",
        "analysis.signature", "analysis.tool", "analysis.line_number", "analysis.error_level",
        "analysis.pattern_pos", "analysis.num_lines_scanned", "analysis.error_keywords",
        "log_tail",
    )


def custom_rules(x):
    return L.classified_lines(x.log_lines, CUSTOM_RULES)


def rules_by_project(x):
    number = F.split_part("log_file", F.lit("/"), F.lit(2)).cast("bigint")
    lines = x.log_lines.withColumn("project", F.when(number % 2 == 1, "custom").otherwise("builtin"))
    table = RS.rule_table(x.log_lines.sparkSession, {"custom": CUSTOM_RULES, "builtin": ERROR_RULES})
    return RS.classified_by_project(lines, table)


# ----------------------------------------------------------------------------- text


def _documents(x, **cols):
    return x.table("documents").select("doc_id", *[c.alias(n) for n, c in cols.items()])


def keywords(x):
    return _documents(x, words=T.keywords("text"), all_words=F.size(T.keyword_set("text")))


def test_name_keywords(x):
    return x.warehouse.test.select(
        "test_id", "test_name", T.test_name_keywords("test_name").alias("words"))


def clean_text(x):
    return _documents(x, cleaned=T.clean_text("text"))


def truncate_text(x):
    return _documents(x, short=T.truncate_text("text"))


def format_duration(x):
    return x.warehouse.test_object_run.select(
        "test_object_run_id", T.format_duration("cpu_time").alias("cpu"),
        T.format_duration("sim_time").alias("sim"),
        T.format_duration(F.col("sim_time") / 10).alias("short"))


def token_estimate(x):
    return _documents(x, tokens=T.token_estimate("text"))


def highlight_keywords(x):
    return _documents(x, marked=T.highlight_keywords("text", T.keywords("text", 5)))


def issue_link(x):
    return x.issues.select("issue_key", T.issue_link(TRACKER, "issue_key").alias("link"))


# ----------------------------------------------------------------------- similarity


def keyword_jaccard(x):
    p = _linked(x).withColumn("j", S.keyword_jaccard(
        T.keyword_set("src_description"), T.keyword_set("dst_description")))
    return p.select("src_key", "dst_key", "j.score", "j.matching", "j.total")


def simple_similarity(x):
    return _linked(x).select("src_key", "dst_key", S.simple_similarity(
        "src_description", "dst_description").alias("score"))


def edit_similarity(x):
    return _linked(x).select("src_key", "dst_key", S.edit_similarity(
        "src_summary", "dst_summary").alias("ratio"))


def tfidf_pairs(x):
    docs = x.issues.select(F.col("issue_key").alias("id"), F.col("description").alias("text"))
    pairs = x.issue_links.select(F.col("src_key").alias("left_id"), F.col("dst_key").alias("right_id"))
    return tfidf_cosine(docs, pairs).withColumn("cosine", F.round("cosine", 9))


def issue_text(x):
    both = I.with_comments(x.issues, x.comments)
    return both.select("issue_key", S.issue_text(comments="first_comments").alias("text"))


def match_scores(x):
    p = _linked(x).select(
        "src_key", "dst_key", F.col("src_summary").alias("signature"),
        T.keywords("src_summary", 10).alias("error_keywords"),
        F.col("dst_summary").alias("summary"), F.col("dst_status").alias("status"),
        T.keywords(S.issue_text("dst_summary", "dst_description", "dst_labels"),
                   M.ISSUE_KEYWORDS).alias("issue_words"),
    )
    return M.score_pairs(p).select(
        "src_key", "dst_key", "keyword_score", "edit_score", "similarity_score",
        "matching_keywords", "relevance_reason")


def _matches(x):
    return M.match_issues(
        _errors_of_logs(x), I.with_comments(x.issues, x.comments), TRACKER, with_comments=True)


def match_issues(x):
    return _matches(x)


def resolved_matches(x):
    return M.resolved_matches(_matches(x)).select("id", "rank", "issue_key", "status", "resolution")


def match_groups(x):
    return M.match_groups(_matches(x), GROUP_THRESHOLD)


def match_issues_low(x):
    return M.match_issues(
        _errors_of_logs(x), I.with_comments(x.issues, x.comments), TRACKER, LOW_SCORE, with_comments=True
    ).drop("description", "solution_summary")


def match_issues_delta(x):
    """Half of the errors and of the issues first, then the rest, with a few issues changed."""
    errors = staged(_errors_of_logs(x))
    number = F.split_part("issue_key", F.lit("-"), F.lit(2)).cast("bigint")
    now = I.with_comments(x.issues, x.comments)
    old = now.where(number % 2 == 0).withColumn(
        "summary", F.when(number % 10 == 0, F.lit("something else")).otherwise(F.col("summary")))
    first = errors.where(F.xxhash64("id") % 2 == 0)
    stored = staged(MS.all_matches(first, old, comments="first_comments"))
    touched = now.where((number % 2 == 1) | (number % 10 == 0)).select("issue_key")
    found, _ = MS.updated_matches(
        stored, staged(MS.distinct_errors(first)), errors, now, touched, comments="first_comments")
    ids = M.error_queries(errors).select("id", "query")
    return ids.join(found, "query").select("id", "rank", "issue_key", "similarity_score", "matching_keywords")


def nearest_issues(x):
    queries = _errors_of_logs(x).select("id", F.col("signature").alias("text"))
    docs = x.issues.select(F.col("issue_key").alias("id"), F.concat_ws(" ", "summary", "description").alias("text"))
    return tfidf_search(queries, docs, COSINE_RESULTS).select(
        F.col("query_id").alias("log_file"), "rank", F.col("id").alias("issue_key"), "cosine")


def _failed_errors(x):
    tests = W.failed_rows(x.warehouse)
    errors = P.test_errors(x.warehouse, tests, x.log_lines)
    return staged(errors.select("id", F.col("signature").alias("text")))


def error_groups(x):
    return G.text_groups(_failed_errors(x), "text", GROUP_THRESHOLD, lambda c: T.keywords(c, 10))


def error_group_report(x):
    errors = _failed_errors(x)
    return G.group_report(errors, G.text_groups(errors, "text", GROUP_THRESHOLD, lambda c: T.keywords(c, 10)))


def issue_groups(x):
    rows = x.issues.select(F.col("issue_key").alias("id"), "summary")
    return G.text_groups(rows, "summary", GROUP_THRESHOLD, lambda c: T.keywords(c, 10))


def compare_errors(x):
    return _linked(x).select("src_key", "dst_key", S.compare_errors(
        "src_summary", "dst_summary").alias("score"))


def suggest_keywords(x):
    e = _errors_of_logs(x)
    return e.select("id", S.suggest_keywords("signature", "error_keywords").alias("words"))


def candidate_issues(x):
    found = M.candidate_issues(x.issues, list(SEARCH_WORDS), status="Resolved")
    return found.select("issue_key", "project", "status")


def _issue_index(x):
    return X.Index.of(X.issue_tokens(x.issues))


def candidates_by_error(x):
    errors = _errors_of_logs(x).withColumnRenamed("id", "query")
    return X.candidates_by_keywords(_issue_index(x), errors, M.SEARCH_KEYWORDS).select(
        F.col("query").alias("log_file"), F.col("doc").alias("issue_key"), "n_words")


def issues_with_all_keywords(x):
    queries = x.issues.select(F.col("issue_key").alias("query"), T.keywords("summary", ALL_KEYWORDS).alias("words"))
    return _issue_index(x).search(queries, match_all=True).select(
        "query", F.col("doc").alias("issue_key"), "n_words")


def solution_sentence_match(x):
    both = I.with_comments(x.issues, x.comments)
    return both.select("issue_key", S.solution_for_match(comments="match_comments").alias("solution"))


def solution_sentence_issue(x):
    both = I.with_comments(x.issues, x.comments)
    return both.select("issue_key", S.solution_for_issue(comments="issue_comments").alias("solution"))


def find_solutions(x):
    return P.find_solutions(x.warehouse, x.log_lines, x.issues, TRACKER)


def _batch(x):
    return P.batch_solutions(x.warehouse, x.log_lines, x.issues, TRACKER)


def batch_solutions(x):
    return _batch(x)


def batch_summary(x):
    return P.batch_summary(x.warehouse, x.log_lines, x.issues)


# --------------------------------------------------------------------------- issues

_BRIEF = ("issue_key", "project", "summary", "status", "resolution", "updated_s")


def search_issues(x):
    where = "status = 'Resolved' AND array_contains(labels, 'en')"
    return I.search_issues(x.issues, where, updated="updated_s").select(*_BRIEF)


def search_text(x):
    return I.search_text(
        x.issues, SEARCH_TEXT, status="resolved", updated="updated_s").select(*_BRIEF)


def search_text_short(x):
    return I.search_text(x.issues, SEARCH_SHORT, max_results=None, updated="updated_s").select(*_BRIEF)


def issue_comments(x):
    return I.issue_comments(x.comments).drop("created")


def issue_details(x):
    d = I.issue_details(x.issues, x.comments)
    return d.select(*_BRIEF, "description", "labels", "n_comments", "solution_summary")


def labels_any(x):
    return I.search_labels(x.issues, list(LABELS), updated="updated_s").select(*_BRIEF)


def labels_all(x):
    return I.search_labels(
        x.issues, list(LABELS), match_all=True, updated="updated_s").select(*_BRIEF)


def related_issues(x):
    return I.related_issues(x.issues, x.issue_links, TRACKER)


def project_info(x):
    return I.project_info(x.tracker_projects, TRACKER)


def similar_failures(x):
    tests = W.failed_rows(x.warehouse)
    return P.similar_failures(P.test_errors(x.warehouse, tests, x.log_lines), k=SIMILAR_LIMIT)


def earlier_failures(x):
    tests = W.failed_rows(x.warehouse)
    return H.earlier_failures(P.test_errors(x.warehouse, tests, x.log_lines), HISTORY)


def solution_sentences_all(x):
    return I.solution_sentences(x.issues, x.comments)


def issue_stats(x):
    return I.issue_stats(x.issues)


def issue_stats_by_day(x):
    days = D.issue_days(x.issues, "created_s", "updated_s")
    merged = D.over_days(days)
    took = I.S.settled("status")
    seconds = x.issues.where(took).select("status", (F.col("updated_s") - F.col("created_s")).alias("s"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    ranks = seconds.join(merged.select("status", "median_seconds"), "status").groupBy("status").agg(
        share(F.col("s") < F.col("median_seconds")).alias("below"),
        share(F.col("s") <= F.col("median_seconds")).alias("upto"))
    near = (F.col("below") <= 0.5 + D.RANK_ERROR) & (F.col("upto") >= 0.5 - D.RANK_ERROR)
    return merged.join(ranks, "status", "left").select(
        "status", "n_issues", "n_settled", "avg_seconds", F.col("min_seconds").cast("string").alias("min_seconds"),
        F.col("max_seconds").cast("string").alias("max_seconds"),
        F.coalesce(near, F.lit(True)).alias("median_within_error"))


def frequent_issues(x):
    return P.frequent_issues(x.warehouse, x.log_lines, x.issues)


def resolution_time(x):
    return I.resolution_time(x.issues, "created_s", "updated_s")


QUERIES = (
    status_map, run_dims, failed_tests, test_details, log_paths, run_header, status_counts,
    regression_summary, search_tests_run, search_tests_recent, job_details,
    runs_by_regression, list_runs, latest_runs, latest_run_with_test,
    search_tests_all, latest_run_with_test_all,
    failed_tests_with_errors, test_details_with_errors,
    log_lines, lines_of_text, ignored_lines, classified_lines, warnings_as_errors, log_fileentity,
    tool_events, first_error, analyze_failure, analyze_failure_capped, head_tail_lines,
    all_errors, log_tail, error_context, has_error, test_log_report, custom_rules, rules_by_project,
    keywords, test_name_keywords, clean_text, truncate_text, format_duration,
    token_estimate, highlight_keywords, issue_link,
    keyword_jaccard, simple_similarity, edit_similarity, tfidf_pairs, issue_text,
    match_scores, match_issues, resolved_matches, match_groups, compare_errors,
    match_issues_low, match_issues_delta, nearest_issues, error_groups, error_group_report, issue_groups,
    suggest_keywords, candidate_issues, candidates_by_error, issues_with_all_keywords, solution_sentence_match, solution_sentence_issue,
    find_solutions, batch_solutions, batch_summary,
    search_issues, search_text, search_text_short, issue_comments, issue_details, labels_any, labels_all,
    related_issues, project_info,
    similar_failures, earlier_failures, solution_sentences_all, issue_stats, issue_stats_by_day, frequent_issues, resolution_time,
)
_NAMES = {"tfidf_pairs": "tfidf_cosine"}



# Integers that may be missing; they compare as text, because some engines read a column
# of integers with gaps as floats.
_LOG_NUMBERS = ("error_level", "line_number", "num_lines_scanned")
NULLABLE_INTEGERS = {
    "failed_tests": ("failed_job_run_ref",),
    "test_details": ("failed_job_run_ref",),
    "search_tests_run": ("failed_job_run_ref",),
    "search_tests_recent": ("failed_job_run_ref",),
    "search_tests_all": ("failed_job_run_ref",),
    "job_details": ("command_cmd_id", "command_exit_code"),
    "failed_tests_with_errors": ("failed_job_run_ref", "error_level"),
    "test_details_with_errors": ("failed_job_run_ref",) + _LOG_NUMBERS,
    "test_log_report": _LOG_NUMBERS,
    "find_solutions": ("rank",),
    "batch_solutions": ("rank",),
}


def _entry(name, fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _flat(fn(_inputs(spark.sparkContext.applicationId, sf_dir, spark)))
        texts = {c: F.col(c).cast("string") for c in NULLABLE_INTEGERS.get(name, ())}
        return out.withColumns(texts) if texts else out

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict:
    names = {_NAMES.get(fn.__name__, fn.__name__): fn for fn in QUERIES}
    return {name: _entry(name, fn) for name, fn in names.items()}
