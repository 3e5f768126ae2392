"""Log and table sources."""

import gzip
import random

from pyspark.sql import functions as F

from faultline.operators import warehouse as W
from faultline.operators.skew import number_rows, salted_join
from faultline.plans.fixtures import Inputs
from faultline.sources import logs, tables


def test_staged_logs(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    rnd = random.Random(1)
    big = [f"{i} " + "x" * rnd.randrange(200) for i in range(3000)]
    (folder / "big.log").write_text("\n".join(big) + "\n")
    (folder / "mixed.log").write_bytes(b"one\r\ntwo\rthree\nbad \xff\xfe byte \xc3\xa9")
    with gzip.open(folder / "packed.log.gz", "wt") as f:
        f.write("a\n\nc\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        logs.stage_lines(spark, str(folder), str(tmp_path / "staged"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in logs.staged_log_lines(spark, str(tmp_path / "staged")).orderBy("log_file", "line_no").collect():
        got.setdefault(r.log_file.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    assert got["big.log"] == list(enumerate(big, 1))
    assert got["mixed.log"] == [(1, "one"), (2, "two"), (3, "three"), (4, "bad  byte é")]
    assert got["packed.log.gz"] == [(1, "a"), (2, ""), (3, "c")]


def test_lines_of_text(spark):
    df = spark.createDataFrame([("m", "a\r\nb\n")], "log_file STRING, content STRING")
    got = [(r.line_no, r.line) for r in logs.lines_of_text(df).orderBy("line_no").collect()]
    assert got == [(1, "a\r"), (2, "b"), (3, "")]


def test_number_rows_and_salted_join(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"),
        "id", F.floor(F.col("id") / 40).alias("part"))
    rows = number_rows(df, "k", ["id"], "part", "n").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r.id):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.n == seen[r.k]
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("total"))
    joined = salted_join(df, facts, ["k"], F.col("id"), salts=4)
    assert joined.count() == 500 and joined.where("total < 1").count() == 0


def test_facts_are_pruned_by_folder(spark, tmp_path):
    wh = Inputs(spark, "/root/testdata/sf0.001").warehouse
    path = str(tmp_path / "facts")
    tables.write_facts(wh.test_object_run, W.run_dims(wh), path)
    every = tables.read_facts(spark, path)
    assert every.count() == wh.test_object_run.count()
    one = every.select("project_name", "regression_name").first()
    part = tables.read_facts(spark, path, *one)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_name" in plan
    assert 0 < part.count() < every.count()


def test_issue_export_and_json(spark, tmp_path):
    row = [("K-1", "P", "s", "d", "Open", None, None, None, None, None, None, ["a"], [], [])]
    df = spark.createDataFrame(row, __import__("faultline.sources.schemas", fromlist=["x"]).ISSUE)
    tables.write_result(df, str(tmp_path / "i"), "json")
    back = tables.read_issues(spark, str(tmp_path / "i"), "json")
    assert back.select("issue_key", "labels").first() == ("K-1", ["a"])
    assert '"resolution":null' in tables.as_json(back).first()[0]


def test_warehouse_arguments(spark):
    wh = Inputs(spark, "/root/testdata/sf0.001").warehouse
    failed = W.failed_rows(wh).toPandas()
    run = int(failed.regression_run_id.value_counts().index[0])
    mine = failed[failed.regression_run_id == run]
    assert W.failed_tests(wh, regression_run_id=run).count() == len(mine)
    assert W.failed_tests(wh, regression_run_id=run, limit=2).count() == min(2, len(mine))
    name = mine.test_name.iloc[0]
    assert W.test_details(wh, name, run).count() == 1
    assert W.test_details(wh, name).count() == 1
    latest = W.latest_runs(wh).first()
    by_name = W.failed_tests(wh, project_name=latest.project_name, regression_name=latest.regression_name)
    assert {r.regression_run_id for r in by_name.collect()} <= {latest.regression_run_id}
    assert W.run_dims(wh, -1).count() == 0
    assert W.regression_summary(wh, run).first().failed >= len(mine)
    job = W.job_details(wh, int(mine.failed_job_run_ref.dropna().iloc[0])).first()
    assert job is not None
    starts = [r.start_time for r in W.list_runs(wh, limit=9).collect()]
    rest = [s for s in starts if s is not None]
    assert starts == [None] * (len(starts) - len(rest)) + sorted(rest, reverse=True)
    assert W.search_tests(wh, "r_ng", regression_run_id=run).count() <= 10


def facts_of(spark, rows):
    return spark.createDataFrame(rows, "test_object_run_id LONG, regression_run_ref LONG, num_error INT")


def test_facts_replace_their_own_folders_only(spark, tmp_path):
    dims = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "q", None)],
                                 "regression_run_id LONG, project_name STRING, regression_name STRING")
    path = str(tmp_path / "facts")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # would merge parts as small as these
    spark.conf.set(merge, "false")
    try:
        tables.write_facts(facts_of(spark, [(i, 1 + i % 3, 0) for i in range(30)]), dims, path, file_rows=2)
        tables.write_facts(facts_of(spark, [(100, 2, 9), (101, 2, 9)]), dims, path, file_rows=2)
    finally:
        spark.conf.unset(merge)
    rows = spark.read.parquet(path)
    assert rows.where("regression_name = 'a'").count() == 10 and rows.where("regression_name is null").count() == 10
    assert sorted(r.test_object_run_id for r in rows.where("regression_name = 'b'").collect()) == [100, 101]
    # a large folder is written by several tasks, a small one by one
    files = {p.parent.name: len(list(p.parent.glob("*.parquet"))) for p in (tmp_path / "facts").rglob("*.parquet")}
    assert files["regression_name=a"] > 1 and files["regression_name=b"] == 1


def test_runs_prune_a_join(spark, tmp_path):
    path = str(tmp_path / "jobs")
    tables.write_by_run(facts_of(spark, [(i, i % 12, i) for i in range(120)]), path)
    runs = spark.createDataFrame([(i, "hot" if i == 5 else "cold") for i in range(12)], "run LONG, kind STRING")
    runs.write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs")).where("kind = 'hot'")
    joined = spark.read.parquet(path).join(runs, F.col("regression_run_ref") == F.col("run"))
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 10
    tables.write_by_run(facts_of(spark, [(999, 5, 1)]), path)
    assert spark.read.parquet(path).count() == 111


def test_ends_of_logs(spark, tmp_path):
    from faultline.operators import logscan
    from faultline.sources.ends import read_log_ends

    rnd = random.Random(4)
    folder = tmp_path / "logs" / "more"
    folder.mkdir(parents=True)
    texts = {"empty": "", "one": "x", "feed": "\n", "two": "a\nb", "long": "y" * 300 + "\nz\n" + "w" * 200}
    for i in range(12):
        lines = ["é" * rnd.randrange(0, 40) for _ in range(rnd.randrange(1, 30))]
        texts[f"r{i}"] = "\n".join(lines) + ("\n" if i % 2 else "")
    for name, text in texts.items():
        if name.endswith("5"):
            with gzip.open(folder / f"{name}.gz", "wt") as f:
                f.write(text)
        else:
            (folder / name).write_text(text)
    named = [(n, k, line) for n, t in texts.items()
             for k, line in enumerate((t[:-1] if t.endswith("\n") else t).split("\n") if t else [], 1)]
    lines = spark.createDataFrame(named, "log_file STRING, line_no INT, line STRING")
    for ends in (0, 1, 7, 50, 10_000):
        want = sorted((r.log_file, r.byte_start, r.file_size, r.line)
                      for r in logscan.head_tail_lines(lines, ends).collect())
        got = sorted((r.log_file.rsplit("/", 1)[1].removesuffix(".gz"), r.byte_start, r.file_size, r.line)
                     for r in read_log_ends(spark, str(tmp_path / "logs"), ends, files=3).collect())
        assert got == want


def test_ends_read_no_middle(spark, tmp_path):
    from faultline.sources.ends import LogEndsReader

    class Counted:
        def __init__(self, size):
            self.n, self.read = size, 0

        def size(self):
            return self.n

        def read_at(self, n, at):
            self.read += n
            return b"0123456\n" * (n // 8) + b"0123456\n"[: n % 8] if at % 8 == 0 else (b"0123456\n" * (n // 8 + 2))[at % 8:at % 8 + n]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    file = Counted(8 << 40)
    rows = list(LogEndsReader({"path": "x", "ends": "80"}).ranged("x", file))
    assert file.read < 4 << 20 and len(rows) == 11 + 10 and rows[-1][1] == (8 << 40) - 8


def test_derived_lookups_do_not_shuffle_the_facts(spark):
    """Status and architecture come from the table of facts; their few values would make a few tasks."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")  # below the size of the orders
    try:
        plan = W.test_details(Inputs(spark, "/root/testdata/sf0.001").warehouse)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for ref in ("test_status_ref", "arch_ref", "conf_ref", "test_group_ref", "block_ref"):
        assert f"BroadcastHashJoin [{ref}" in plan and f"hashpartitioning({ref}" not in plan
