"""Jobs keyed by run, whole logs, searches, links, threads, staging."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from faultline.operators import issues as I
from faultline.operators import logscan as L
from faultline.operators import matching as M
from faultline.operators import warehouse as W
from faultline.operators.stage import release, stage_folder, staged, staging
from faultline.plans import registry, triage
from faultline.plans.fixtures import Inputs
from faultline.sources.logs import lines_of_text

SF = "/root/testdata/sf0.001"


def test_job_ids_count_within_a_run(spark):
    wh = Inputs(spark, SF).warehouse
    cmds = spark.createDataFrame(
        [(1, 1, 7, "log/a"), (1, 2, 7, "log/b"), (2, 2, 7, "log/c"), (3, 3, 7, "")],
        "job_cmd_id long, regression_run_ref long, job_run_ref long, log_file string",
    )
    wh = type(wh)(**{**vars(wh), "job_cmd": cmds})
    tests = spark.createDataFrame(
        [(10, 1, 7), (20, 2, 7), (30, 3, 7), (40, 1, None), (50, 1, 8)],
        "test_object_run_id long, regression_run_id long, failed_job_run_ref long",
    )
    got = {r.test_object_run_id: r.log_file for r in W.log_paths(wh, tests).collect()}
    assert got == {10: "log/a", 20: "log/c", 30: None, 40: None, 50: None}


def test_details_of_a_job_need_its_run(spark):
    wh = Inputs(spark, SF).warehouse
    ids = wh.job_run.groupBy("job_run_id").count().where("count > 1")
    assert ids.count() > 0  # ids repeat across runs
    run = wh.job_run.where("job_run_id = 1").first().regression_run_id
    rows = W.job_details(wh, run, 1).collect()
    assert len(rows) == 1 and rows[0].regression_run_id == run


def test_run_filter_reaches_a_partitioned_table(spark, tmp_path):
    wh = Inputs(spark, SF).warehouse
    path = str(tmp_path / "job_cmd")
    wh.job_cmd.where("regression_run_ref < 20").write.partitionBy("regression_run_ref").parquet(path)
    wh = type(wh)(**{**vars(wh), "job_cmd": spark.read.parquet(path)})
    plan = W.job_details(wh, 7, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(regression_run_ref" in plan


def test_lines_beyond_the_first_count(spark):
    logs = spark.createDataFrame([("a", "all is well\nERROR: second line broke"), ("b", "all is well")],
                                 "log_file string, content string")
    got = {r.log_file: r.signature for r in L.analyze_logs(lines_of_text(logs)).collect()}
    assert got == {"a": "ERROR: second line broke", "b": "unknown"}


def test_only_wanted_logs_are_analysed(spark):
    lines = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "log_file string, line_no int, line string")
    tests = spark.createDataFrame([("a",), (None,), ("a",)], "log_file string")
    assert [r.log_file for r in triage.wanted_lines(lines, tests).collect()] == ["a"]
    x = Inputs(spark, SF)
    with staging(spark):
        plan = triage.failed_tests_with_errors(x.warehouse, x.log_lines)._jdf.queryExecution()
        assert "LeftSemi" in plan.optimizedPlan().toString()


def issue_rows(spark):
    return spark.createDataFrame(
        [("A-1", "IO at start", "disk io error at boot", "Open", ["x"]), ("A-2", "other", "io only", "Closed", ["at"]),
         ("A-3", "none", "nothing of it", "Open", [])],
        "issue_key string, summary string, description string, status string, labels array<string>",
    ).withColumn("updated", F.lit(1))


def test_search_takes_short_words_and_needs_one(spark):
    keys = lambda text, **k: {r.issue_key for r in I.search_text(issue_rows(spark), text, **k).collect()}
    assert keys("IO at") == {"A-1", "A-2"} and keys("io AT boot") == {"A-1"}
    assert keys("") == keys("?! -") == set() and keys("io at", status="resolved") == {"A-2"}
    assert keys("i") == set()  # a word, not a part of one


def test_links_have_a_direction_and_may_lead_outside(spark):
    links = spark.createDataFrame(
        [("A-1", "A-2", "outward", "blocks", "is blocked by"), ("A-1", "Z-9", "inward", "blocks", "is blocked by"),
         ("A-2", "A-3", "inward", None, None)],
        "src_key string, dst_key string, direction string, outward string, inward string")
    got = {(r.issue_key, r.key): (r.summary, r.status, r.relation)
           for r in I.related_issues(issue_rows(spark), links, "u").collect()}
    assert got == {("A-1", "A-2"): ("other", "Closed", "blocks"), ("A-1", "Z-9"): ("", "Unknown", "is blocked by"),
                   ("A-2", "A-3"): ("none", "Open", "relates to")}


def test_comments_without_a_number_stay(spark):
    rows = spark.createDataFrame([("A", 1, "x"), ("A", None, "y"), (None, 2, "z")], "issue_key string, seq long, body string")
    assert sorted(r.body for r in I.issue_comments(rows).collect()) == ["x", "y", "z"]


def test_sentences_are_whole(spark):
    long = "fixed by " + "x" * 500
    issues = issue_rows(spark).limit(1).withColumn("description", F.lit(f"{long}. Other"))
    none = spark.createDataFrame([], "issue_key string, seq long, body string")
    assert [r.sentence for r in I.solution_sentences(issues, none).collect()] == [long]


def test_letter_bound_is_never_below_the_measure(spark):
    from faultline.functions import similarity as S

    pairs = spark.createDataFrame(
        [("Error in Module é", "error at modul"), ("abc", ""), ("aaaa", "bbbb"), ("x_1 y", "Y 1_x"), ("ÄÖ", "öä")],
        "a string, b string")
    total = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    rows = pairs.withColumns({"la": M.letter_counts("a"), "lb": M.letter_counts("b")}).select(
        S.edit_similarity("a", "b").alias("ratio"), total(F.zip_with("la", "lb", lambda x, y: F.least(x, y))).alias("shared"),
        total("la").alias("n"), total("lb").alias("m")).collect()
    assert all(r.ratio <= 2 * r.shared / max(1, r.n + r.m) + 1e-12 for r in rows)


def test_matching_scores_each_pair_once(spark):
    x = Inputs(spark, SF)
    with staging(spark):
        errors = L.analyze_logs(x.log_lines).select(F.col("log_file").alias("id"), "signature", "error_keywords")
        plan = M.match_issues(errors, I.with_comments(x.issues, x.comments), with_comments=True)
        assert "ArrowEvalPython" not in plan._jdf.queryExecution().toString()  # done and written down


def test_earlier_failures(spark):
    rows = spark.createDataFrame(
        [("disk full on node", 1), ("disk full on node", 5), ("disk full on host", 3), ("disk full on rack", None),
         ("network card lost link", 2)], "signature string, t int").withColumn(
        "end_time", F.timestamp_seconds("t"))
    with staging(spark):
        got = {(r.signature, r.earlier_signature) for r in triage.similar_failures(rows, 0.1).collect()}
    node, host, rack = "disk full on node", "disk full on host", "disk full on rack"
    assert {(node, node), (node, host), (host, node), (rack, node), (rack, host)} <= got
    assert (host, host) not in got and (host, rack) not in got and (rack, rack) not in got


def test_nothing_stays_behind(spark, tmp_path):
    folder = stage_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with staging(spark):
        registry.queries()["match_issues"](spark, SF).count()
        assert len(os.listdir(folder)) > len(before)
    assert set(os.listdir(folder)) == before
    staged(spark.range(3))
    assert release(spark) >= 1


def test_frequent_keys_are_spread_by_measure(spark):
    from faultline.operators.skew import salted_join

    many = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 50), (None, 51), ("none", 52)], "k string, i long")
    few = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "c")], "k string, v string")
    with staging(spark):
        for args in ({}, {"task_rows": 7}, {"salts": 3}):
            rows = salted_join(many, few, ["k"], F.xxhash64("i"), how="left", **args).collect()
            got = sorted((r.i, r.v or "") for r in rows)
            assert got == sorted([(i, v) for i in range(50) for v in "ab"] + [(50, "c"), (51, ""), (52, "")])


def test_staging_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, *default):
            return super().get(key, *default)

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("C", (), {"master": master, "getCheckpointDir": lambda _: None})()

    at = lambda master, **conf: stage_folder(Session(master, **{k.replace("_", "."): v for k, v in conf.items()}))
    assert at("local[4]", spark_sql_warehouse_dir="file:/w") == "file:/w/_staged"
    assert at("yarn", spark_sql_warehouse_dir="hdfs://n/w/") == "hdfs://n/w/_staged"
    assert at("spark://h:1", spark_sql_warehouse_dir="file:/w", spark_checkpoint_dir="file:/shared/") == "file:/shared"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(ValueError):
            at("spark://h:1", spark_sql_warehouse_dir=warehouse)


def test_entry_without_a_library_of_the_corpus_part():
    code = (
        "import sys, warnings; sys.modules['xxhash'] = None\n"
        "with warnings.catch_warnings(record=True) as seen:\n"
        "    warnings.simplefilter('always'); import __spark_entry__ as e\n"
        "assert 'find_solutions' in e.queries() and set(e.oracle_sql()) <= set(e.queries())\n"
        "assert not any(k.startswith('op') for k in e.queries())\n"
        "assert any('corpus' in str(w.message) for w in seen)\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def _moves_of_lines(df):
    """The exchanges by hash in the plan of a table."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_numbering_moves_rows_once(spark):
    from faultline.operators.skew import number_rows

    rows = [("a", 1, 2, "x"), ("a", 1, 1, "y"), ("a", None, 1, "z"), (None, 1, 1, "u"), (None, 1, 2, "v"), ("b", 3, 1, "w")]
    df = spark.createDataFrame(rows, "log string, day int, place int, text string")
    got = {r.text: r.n for r in number_rows(df, "log", ["place"], "day", "n").collect()}
    assert got == {"z": 1, "y": 2, "x": 3, "u": 1, "v": 2, "w": 1}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = number_rows(df, "log", ["place"], "day", "n")
        # counts per slice, their order per key, the shifts and the rows themselves
        assert len(_moves_of_lines(plan)) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_staging_leaves_no_shuffles(spark):
    from faultline.operators import stage

    before = spark.conf.get(stage.SHUFFLES_REMOVED, None)
    table = stage.staged(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    assert table.count() == 7 and spark.conf.get(stage.SHUFFLES_REMOVED, None) == before
    seen = []
    with stage._shuffles_removed(spark):
        seen.append(spark.conf.get(stage.SHUFFLES_REMOVED))
    assert seen == ["true"]
    stage.drop(table)
    assert not os.path.exists(table._staged_at.removeprefix("file:"))


def test_log_report_moves_tests_once(spark, monkeypatch):
    """Analysis and tail of a log meet before the tests do, so tests are joined to logs once."""
    from faultline.operators import warehouse

    lines = spark.createDataFrame(
        [("a", 1, "ERROR: one"), ("a", 2, "info two"), ("b", 1, "info x")], "log_file string, line_no int, line string")
    tests = spark.createDataFrame(
        [(1, i, f"t{i}", "blk", None if i == 3 else i, f) for i, f in enumerate(["a", "a", "b", None, "gone"])],
        "regression_run_id int, test_object_run_id int, test_name string, block_name string, failed_job_run_ref int, log_file string")
    monkeypatch.setattr(warehouse, "test_details", lambda wh, **which: tests.withColumn("more", F.lit("x" * 50)))
    monkeypatch.setattr(warehouse, "with_log_path", lambda wh, t: t.join(tests.select("test_object_run_id", "log_file"), "test_object_run_id"))
    joins, salted = [], triage.salted_join
    monkeypatch.setattr(triage, "salted_join", lambda many, few, *a, **k: joins.append((set(many.columns), set(few.columns))) or salted(many, few, *a, **k))
    got = {r.test_object_run_id: (r.error, r.log_tail, r.analysis and r.analysis.signature) for r in triage.test_log_report(None, lines).collect()}
    assert got == {0: (None, "ERROR: one\ninfo two", "ERROR: one"), 1: (None, "ERROR: one\ninfo two", "ERROR: one"),
                   2: (None, "info x", "unknown"), 3: ("Log file path not found in database", None, None),
                   4: ("Log file not accessible", None, None)}
    [(many, few)] = joins
    assert "log_tail" in few and "more" not in many and "error" not in many
