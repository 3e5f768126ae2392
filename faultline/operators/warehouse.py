"""Relational queries over the test-results warehouse.

The tables form a star: facts point to runs, test objects and small lookups. No join is
forced to broadcast; Spark broadcasts a lookup when its measured size allows it. Times
sort newest first with missing times on top, ties by id.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F

from .index import Index, tests_named
from .skew import left_lookup
from .stage import staged

# The fields of a test, a run and a search result, in their order.
TEST_COLUMNS = (
    "test_object_run_id", "test_name", "block_name", "status", "arch", "conf", "test_group",
    "start_time", "end_time", "cpu_time", "num_error", "num_warning", "host", "random_seed",
    "failed_job_run_ref", "mem_usage", "lsf_req_mb", "regression_run_id",
)
RUN_COLUMNS = (
    "regression_run_id", "project_name", "regression_name", "changelist", "iteration",
    "start_time", "end_time", "status",
)
SEARCH_COLUMNS = (
    "test_object_run_id", "test_name", "block_name", "status", "start_time", "end_time",
    "num_error", "failed_job_run_ref", "regression_run_id",
)


@dataclass(frozen=True)
class Warehouse:
    """The tables of a warehouse."""

    project: DataFrame
    regression: DataFrame
    regression_status: DataFrame
    regression_run: DataFrame
    test_status: DataFrame
    test: DataFrame
    test_object: DataFrame
    block: DataFrame
    arch: DataFrame
    conf: DataFrame
    test_group: DataFrame
    test_object_run: DataFrame
    job_run: DataFrame
    job_cmd: DataFrame


def _newest(time: str, tie: str):
    return [F.desc_nulls_first(time), F.asc(tie)]


# ---------------------------------------------------------------------------- runs


def status_map(wh: Warehouse) -> DataFrame:
    return wh.test_status.select(
        F.col("test_status_name").alias("name"), F.col("test_status_id").alias("id")
    )


def run_dims(wh: Warehouse, regression_run_id: int | None = None) -> DataFrame:
    """Project and regression of each run; an unknown run gives no row."""
    runs = wh.regression_run
    if regression_run_id is not None:
        runs = runs.where(F.col("regression_run_id") == regression_run_id)
    return (
        runs.join(wh.project, runs.project_ref == wh.project.project_id)
        .join(wh.regression, runs.regression_ref == wh.regression.regression_id)
        .select("regression_run_id", "project_name", "regression_name")
    )


def _runs(wh: Warehouse) -> DataFrame:
    r = wh.regression_run
    s = wh.regression_status
    return (
        r.join(wh.project, r.project_ref == wh.project.project_id)
        .join(wh.regression, r.regression_ref == wh.regression.regression_id)
        .join(s, r.regression_status == s.regression_status_id)
        .withColumn("status", F.col("regression_status_name"))
    )


def run_header(wh: Warehouse, regression_run_id: int | None = None) -> DataFrame:
    runs = _runs(wh)
    if regression_run_id is not None:
        runs = runs.where(F.col("regression_run_id") == regression_run_id)
    return runs.select(*RUN_COLUMNS, "username", "client", "log_directory")


def _sorted_runs(runs: DataFrame, limit: int | None) -> DataFrame:
    runs = runs.select(*RUN_COLUMNS).orderBy(*_newest("start_time", "regression_run_id"))
    return runs if limit is None else runs.limit(limit)


def list_runs(wh: Warehouse, project_name: str | None = None, limit: int | None = None):
    runs = _runs(wh)
    if project_name is not None:
        runs = runs.where(F.col("project_name") == project_name)
    return _sorted_runs(runs, limit)


def runs_of_regression(wh: Warehouse, regression_id: int, limit: int | None = None):
    return _sorted_runs(_runs(wh).where(F.col("regression_ref") == regression_id), limit)


def runs_by_regression(wh: Warehouse, limit: int | None = None) -> DataFrame:
    """Runs of every regression, newest first, at most ``limit`` per regression."""
    runs = _runs(wh).select("regression_ref", *RUN_COLUMNS)
    if limit is not None:
        rank = F.row_number().over(
            Window.partitionBy("regression_ref").orderBy(*_newest("start_time", "regression_run_id"))
        )
        runs = runs.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    return runs.orderBy("regression_ref", *_newest("start_time", "regression_run_id"))


def latest_runs(wh: Warehouse) -> DataFrame:
    """The latest run of every project and regression."""
    rank = F.row_number().over(
        Window.partitionBy("project_name", "regression_name").orderBy(
            *_newest("start_time", "regression_run_id")
        )
    )
    return (
        _runs(wh).select("project_name", "regression_name", "regression_run_id", "start_time")
        .withColumn("rank", rank).where(F.col("rank") == 1)
        .select("project_name", "regression_name", "regression_run_id")
    )


def _resolve(wh, tests, regression_run_id, project_name, regression_name) -> DataFrame:
    """Keep the tests of one run, or of the latest run of a project and regression."""
    if regression_run_id is not None:
        return tests.where(F.col("regression_run_id") == regression_run_id)
    if project_name is not None and regression_name is not None:
        run = latest_runs(wh).where(
            (F.col("project_name") == project_name)
            & (F.col("regression_name") == regression_name)
        )
        return tests.join(run.select("regression_run_id"), "regression_run_id", "left_semi")
    return tests


# --------------------------------------------------------------------------- tests


def _named_tests(wh: Warehouse) -> DataFrame:
    """Facts with their names. Lookups are staged: one that is derived from a large table would be
    taken for large, and all facts shuffled by one of a few values."""
    f = wh.test_object_run
    o, t, b, s = wh.test_object, wh.test, staged(wh.block), staged(wh.test_status)
    return (
        f.join(s, f.test_status_ref == s.test_status_id)
        .join(o, f.test_object_ref == o.test_object_id)
        .join(t, o.test_ref == t.test_id)
        .join(b, o.block_ref == b.block_id)
        .withColumn("status", F.col("test_status_name"))
        .withColumn("regression_run_id", F.col("regression_run_ref"))
    )


def _full_tests(wh: Warehouse) -> DataFrame:
    a, c, g = staged(wh.arch), staged(wh.conf), staged(wh.test_group)
    n = _named_tests(wh)
    return (
        n.join(a, n.arch_ref == a.arch_id)
        .join(c, n.conf_ref == c.conf_id)
        .join(g, n.test_group_ref == g.test_group_id)
        .withColumn("arch", F.col("arch_name"))
        .withColumn("conf", F.col("conf_name"))
        .withColumn("test_group", F.col("test_group_name"))
    )


def failed_rows(
    wh: Warehouse,
    regression_run_id: int | None = None,
    project_name: str | None = None,
    regression_name: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Failed tests, unsorted; ``limit`` keeps the newest of each run."""
    tests = _full_tests(wh).where(F.col("status") == "failed").select(*TEST_COLUMNS)
    tests = _resolve(wh, tests, regression_run_id, project_name, regression_name)
    if limit is None:
        return tests
    rank = F.row_number().over(
        Window.partitionBy("regression_run_id").orderBy(*_newest("end_time", "test_object_run_id"))
    )
    return tests.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def failed_tests(wh: Warehouse, **which) -> DataFrame:
    """Failed tests by run, newest first. Arguments as in ``failed_rows``."""
    return failed_rows(wh, **which).orderBy(
        "regression_run_id", *_newest("end_time", "test_object_run_id")
    )


def test_details(
    wh: Warehouse,
    test_name: str | None = None,
    regression_run_id: int | None = None,
    project_name: str | None = None,
    regression_name: str | None = None,
) -> DataFrame:
    """One row per run and test name: the newest, ties by id.

    With a test name and no run, the newest run that has the test answers.
    """
    tests = _full_tests(wh).select(*TEST_COLUMNS, "sim_time")
    if test_name is not None:
        tests = tests.where(F.col("test_name") == test_name)
        if regression_run_id is None and not (project_name and regression_name):
            found = latest_run_with_test(wh).where(F.col("test_name") == test_name)
            tests = tests.join(found.select("regression_run_id"), "regression_run_id", "left_semi")
    tests = _resolve(wh, tests, regression_run_id, project_name, regression_name)
    rank = F.row_number().over(
        Window.partitionBy("regression_run_id", "test_name").orderBy(
            *_newest("end_time", "test_object_run_id")
        )
    )
    return tests.withColumn("rank", rank).where(F.col("rank") == 1).drop("rank")


test_details.__test__ = False  # not a pytest case


def with_log_path(wh: Warehouse, tests: DataFrame) -> DataFrame:
    """Tests with log_file: the log of the newest command of their failed job.

    A job's id counts within its run. The newest command decides even if its path is
    missing. Commands of jobs that no given test refers to are dropped before they are
    ranked, and those of other runs are not read where the table is laid out by run.
    """
    run = "regression_run_id" if "regression_run_id" in tests.columns else "regression_run_ref"
    key = [run, "failed_job_run_ref"]
    wanted = tests.select(*key).where(F.col("failed_job_run_ref").isNotNull())
    cmds = wh.job_cmd.select(
        F.col("regression_run_ref").alias(run), F.col("job_run_ref").alias("failed_job_run_ref"),
        "job_cmd_id", "log_file",
    ).join(wanted, key, "left_semi")
    newest = _newest_command(cmds, key).select(
        *key, F.nullif(F.col("log_file"), F.lit("")).alias("log_file"))
    return left_lookup(tests, newest, key, F.col("test_object_run_id"))


def _newest_command(cmds: DataFrame, job: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*job).orderBy(F.desc("job_cmd_id")))
    return cmds.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def log_paths(wh: Warehouse, tests: DataFrame | None = None) -> DataFrame:
    """test_object_run_id, log_file of the given tests, or of all."""
    rows = with_log_path(wh, wh.test_object_run if tests is None else tests)
    return rows.select("test_object_run_id", "log_file")


def status_counts(wh: Warehouse) -> DataFrame:
    f, s = wh.test_object_run, wh.test_status
    return (
        f.groupBy("regression_run_ref", "test_status_ref").agg(F.count(F.lit(1)).alias("n"))
        .join(s, F.col("test_status_ref") == s.test_status_id)
        .groupBy(F.col("regression_run_ref").alias("regression_run_id"),
                 F.col("test_status_name").alias("status"))
        .agg(F.sum("n").alias("n_tests"))
    )


def regression_summary(wh: Warehouse, regression_run_id: int | None = None) -> DataFrame:
    """Header and test statistics of each run; a run without tests counts zero."""
    from ..functions.text import one_decimal

    counts = status_counts(wh)
    if regression_run_id is not None:
        counts = counts.where(F.col("regression_run_id") == regression_run_id)
    of = lambda s: F.sum(F.when(F.col("status") == s, F.col("n_tests")).otherwise(0))
    stats = counts.groupBy("regression_run_id").agg(
        F.sum("n_tests").alias("total_tests"),
        of("passed").alias("passed"),
        of("failed").alias("failed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n_tests"))))
        .alias("by_status"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rate = F.when(F.col("total_tests") > 0, F.col("passed") / F.col("total_tests") * 100)
    return (
        run_header(wh, regression_run_id).join(stats, "regression_run_id", "left")
        .select(
            *RUN_COLUMNS, "username", "client", "log_directory",
            zero("total_tests"), zero("passed"), zero("failed"), "by_status",
            F.coalesce(rate, F.lit(0.0)).alias("pass_rate"),
        )
        .withColumn("pass_rate_text", F.concat(one_decimal("pass_rate"), F.lit("%")))
    )


def _matching(wh: Warehouse, keyword: str, status: str | None, names: Index | None) -> DataFrame:
    if names is None:
        tests = _named_tests(wh).where(F.col("test_name").ilike(f"%{keyword}%"))
    else:  # only the names found are joined to the facts
        tests = _named_tests(replace(wh, test=tests_named(names, wh.test, keyword)))
    if status is not None:
        tests = tests.where(F.col("status") == status)
    return tests.select(*SEARCH_COLUMNS)


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def search_tests(
    wh: Warehouse,
    keyword: str,
    regression_run_id: int | None = None,
    status: str | None = None,
    limit: int | None = 10,
    names: Index | None = None,
) -> DataFrame:
    """Tests whose name holds the keyword (% and _ are wildcards), newest first per run.

    ``limit`` None gives all. ``names`` is an index of test names (``index.name_tokens``);
    with it only names that hold all three-letter parts of the keyword are read.
    """
    tests = _matching(wh, keyword, status, names)
    if regression_run_id is not None:
        mine = tests.where(F.col("regression_run_id") == regression_run_id)
        return _first(mine.orderBy(*_newest("end_time", "test_object_run_id")), limit)
    rank = F.row_number().over(
        Window.partitionBy("regression_run_id").orderBy(*_newest("end_time", "test_object_run_id"))
    )
    ranked = tests.withColumn("rank", rank)
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def _newest_runs(wh: Warehouse, runs: int | None) -> DataFrame:
    known = run_dims(wh).select("regression_run_id").join(
        wh.regression_run.select("regression_run_id", "start_time"), "regression_run_id")
    return known if runs is None else known.orderBy(*_newest("start_time", "regression_run_id")).limit(runs)


def search_tests_recent(
    wh: Warehouse, keyword: str, status: str | None = None, limit: int | None = 10, runs: int | None = 5,
    names: Index | None = None,
) -> DataFrame:
    """The same over the newest runs together; one filter and one top-k. None: all of them."""
    tests = _matching(wh, keyword, status, names)
    if runs is not None:
        recent = list_runs(wh, limit=runs).select("regression_run_id")
        tests = tests.join(recent, "regression_run_id", "left_semi")
    return _first(tests.orderBy(*_newest("end_time", "test_object_run_id")), limit)


def latest_run_with_test(wh: Warehouse, runs: int | None = 100) -> DataFrame:
    """For every test name, the newest of the newest ``runs`` runs that holds it; None: of all
    runs. The newest is found by a grouped maximum, so a frequent test is no single task."""
    recent = _newest_runs(wh, runs)
    f, o, t = wh.test_object_run, wh.test_object, wh.test
    seen = (
        f.select(F.col("regression_run_ref").alias("regression_run_id"), "test_object_ref")
        .distinct()
        .join(recent, "regression_run_id")
        .join(o, F.col("test_object_ref") == o.test_object_id)
        .join(t, o.test_ref == t.test_id)
        .select("test_name", "regression_run_id", "start_time")
    )
    # Missing times are newest; of equal times the smaller id counts.
    newest = F.max(F.struct(
        F.col("start_time").isNull().alias("open"), "start_time", (-F.col("regression_run_id")).alias("cost")))
    return seen.groupBy("test_name").agg(newest.alias("r")).select(
        "test_name", (-F.col("r.cost")).alias("regression_run_id"))


def job_details(
    wh: Warehouse, regression_run_id: int | None = None, job_run_id: int | None = None
) -> DataFrame:
    """Jobs with their newest command as a nested record, null if there is none.

    A job is known by its run and its id.
    """
    jobs, cmds = wh.job_run, wh.job_cmd
    if regression_run_id is not None:
        jobs = jobs.where(F.col("regression_run_id") == regression_run_id)
        cmds = cmds.where(F.col("regression_run_ref") == regression_run_id)
    if job_run_id is not None:
        jobs = jobs.where(F.col("job_run_id") == job_run_id)
        cmds = cmds.where(F.col("job_run_ref") == job_run_id)
    fields = F.struct(
        F.col("job_cmd_id").alias("cmd_id"), "cmd", "log_file", "exit_code",
        "start_time", "end_time", "host",
    )
    key = ["regression_run_ref", "job_run_ref"]
    newest = _newest_command(cmds, key).select(*key, fields.alias("command"))
    same = (jobs.regression_run_id == newest.regression_run_ref) & (jobs.job_run_id == newest.job_run_ref)
    return jobs.join(newest, same, "left").drop(*key)
