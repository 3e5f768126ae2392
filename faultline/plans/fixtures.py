"""Triage inputs derived from the driver's tables, as DataFrames.

``FIXTURE_SQL`` in ``oracles.py`` states the same inputs as SQL. Nothing is cached or
written here; every query derives what it needs and Spark prunes the rest.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.skew import number_rows
from ..operators.warehouse import Warehouse
from ..sources.logs import lines_of_text

TRACKER = "https://tracker.example.org/"

DRIVER_TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,"
                " c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,"
            " p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING,"
              " o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
                " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
                " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,"
              " value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def headline(text="text"):
    """First line of a document."""
    return F.substring_index(F.col(text), "\n", 1)


class Inputs:
    """All inputs of a triage job over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(DRIVER_TABLES[name]).parquet(f"{self.dir}/{name}.parquet")

    def _rows(self, name: str) -> int:
        return self.table(name).count()  # answered from the file footers

    # ---------------------------------------------------------------- warehouse

    @cached_property
    def warehouse(self) -> Warehouse:
        part = self.table("part")
        names = part.select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("test_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
                     F.lower("p_type")).alias("name"),
            "p_brand", "p_type", "p_size",
        )
        named = lambda t, c, key, label: t.select(
            F.col(c).alias(key), F.col(c).alias(label)
        ).distinct()
        status = self.table("orders").select(_status().alias("s"))
        runs = self.table("customer")
        return Warehouse(
            project=self.table("region").select(
                F.col("r_regionkey").alias("project_id"), F.col("r_name").alias("project_name")),
            regression=self.table("nation").select(
                F.col("n_nationkey").alias("regression_id"),
                F.col("n_name").alias("regression_name")),
            regression_status=named(runs, "c_mktsegment", "regression_status_id",
                                    "regression_status_name"),
            test_status=named(status, "s", "test_status_id", "test_status_name"),
            test=names.select(F.col("id").alias("test_id"), F.col("name").alias("test_name")),
            test_object=names.select(
                F.col("id").alias("test_object_id"), F.col("id").alias("test_ref"),
                F.col("p_brand").alias("block_ref")),
            block=named(part, "p_brand", "block_id", "block_name"),
            arch=named(self.table("orders"), "o_orderpriority", "arch_id", "arch_name"),
            conf=named(part, "p_type", "conf_id", "conf_name"),
            test_group=part.select(
                F.col("p_size").alias("test_group_id"),
                F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("test_group_name"),
            ).distinct(),
            regression_run=self._runs(),
            test_object_run=self._facts(),
            job_run=self._job_run(),
            job_cmd=self._job_cmd(),
        )

    def _runs(self) -> DataFrame:
        times = self.table("orders").groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("start_time"), F.max("o_orderdate").alias("end_time")
        )
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        c = self.table("customer")
        return (
            c.join(nation, c.c_nationkey == nation.n_nationkey)
            .join(times, c.c_custkey == times.o_custkey, "left")
            .select(
                F.col("c_custkey").alias("regression_run_id"),
                F.col("n_regionkey").alias("project_ref"),
                F.col("c_nationkey").alias("regression_ref"),
                F.col("c_mktsegment").alias("regression_status"),
                (F.col("c_custkey") * 10).alias("changelist"),
                (F.col("c_custkey") % 4).cast("int").alias("iteration"),
                "start_time", "end_time",
                F.col("c_name").alias("username"),
                F.concat(F.lit("client"), (F.col("c_custkey") % 8).cast("string")).alias("client"),
                F.concat(F.lit("/runs/"), F.col("c_custkey").cast("string")).alias("log_directory"),
            )
        )

    def _jobs(self) -> DataFrame:
        """Orders with the id of their job, which counts within the run."""
        order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        return self.table("orders").withColumn("job", F.row_number().over(order).cast("bigint"))

    def _facts(self) -> DataFrame:
        parts = self._rows("part")
        part = self.table("part").select("p_partkey", "p_type", "p_size")
        o = self._jobs().withColumn("p_partkey", F.col("o_orderkey") % parts)
        key = F.col("o_orderkey")
        failed = F.col("o_orderstatus") == "F"
        return o.join(part, "p_partkey").select(
            key.alias("test_object_run_id"),
            F.col("o_custkey").alias("regression_run_ref"),
            F.col("p_partkey").alias("test_object_ref"),
            _status().alias("test_status_ref"),
            F.col("o_orderpriority").alias("arch_ref"),
            F.col("p_type").alias("conf_ref"),
            F.col("p_size").alias("test_group_ref"),
            F.col("o_orderdate").alias("start_time"),
            F.when(key % 17 != 0, F.col("o_orderdate")).alias("end_time"),
            F.col("o_totalprice").alias("cpu_time"),
            (F.col("o_totalprice") / 1000).alias("sim_time"),
            (key % 7).cast("int").alias("num_error"),
            (key % 5).cast("int").alias("num_warning"),
            F.concat(F.lit("host"), (key % 64).cast("string")).alias("host"),
            (key * 7919 % 100003).alias("random_seed"),
            F.when(failed & (key % 13 != 0), F.col("job")).alias("failed_job_run_ref"),
            (F.col("o_totalprice") / 100).alias("mem_usage"),
            (key % 4 * 1024).cast("int").alias("lsf_req_mb"),
        )

    def _job_run(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self._jobs().select(
            F.col("job").alias("job_run_id"), F.col("o_custkey").alias("regression_run_id"),
            F.concat(F.lit("job_"), key.cast("string")).alias("job_run_name"),
            F.col("o_orderstatus").alias("status"),
            F.concat(F.lit("host"), (key % 64).cast("string")).alias("host"),
            F.col("o_orderdate").alias("start_time"),
            F.when(key % 17 != 0, F.col("o_orderdate")).alias("end_time"),
            F.col("o_totalprice").alias("cpu_time"),
            (key % 5).cast("int").alias("num_warning"), (key % 7).cast("int").alias("num_error"),
        )

    def _job_cmd(self) -> DataFrame:
        users = self._users
        order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
            "l_discount", "l_tax", "l_shipdate",
        )
        key = F.col("l_orderkey")
        jobs = self._jobs().select("o_orderkey", "o_custkey", "job")
        lines = self.table("lineitem")
        return lines.join(jobs, lines.l_orderkey == jobs.o_orderkey).select(
            F.row_number().over(order).cast("bigint").alias("job_cmd_id"),
            F.col("o_custkey").alias("regression_run_ref"), F.col("job").alias("job_run_ref"),
            F.concat(F.lit("run "), F.col("l_partkey").cast("string")).alias("cmd"),
            F.when(F.col("l_partkey") % 19 != 0,
                   F.concat(F.lit("log/"), (key % users).cast("string"))).alias("log_file"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("exit_code"),
            F.col("l_shipdate").alias("start_time"), F.col("l_shipdate").alias("end_time"),
            F.concat(F.lit("host"), (key % 64).cast("string")).alias("host"),
        )

    # --------------------------------------------------------------------- logs

    @cached_property
    def _users(self) -> int:
        return self.table("events").agg(F.max("user_id")).first()[0] + 1

    @cached_property
    def text_lines(self) -> DataFrame:
        """Every line of every document, as a log of its own."""
        name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
        return lines_of_text(self.table("documents").select(
            "doc_id", name.alias("log_file"), F.col("text").alias("content")))

    @cached_property
    def log_lines(self) -> DataFrame:
        """Whole documents, one after the other, make the logs; some lines get a marker."""
        pieces = lines_of_text(self.table("documents"), "doc_id", "text").select(
            F.col("log_file").alias("doc_id"), F.col("line_no").alias("place"), F.col("line").alias("text"))
        named = pieces.withColumn(
            "log_file", F.concat(F.lit("log/"), (F.col("doc_id") % self._users).cast("string")))
        e = number_rows(named, "log_file", ["place"], "doc_id", "line_no")
        num, text = F.col("doc_id") * 7 + F.col("place"), F.col("text")
        nr, kind = num.cast("string"), num % 16
        line = (
            F.when(kind == 0, F.concat(F.lit("UVM_ERROR @ "), nr, F.lit(": "), text))
            .when(kind == 1, F.lit("UVM_ERROR : 0"))
            .when(kind == 2, F.concat(F.lit("ASSERTION FAILED "), text))
            .when(kind == 3, F.lit("x error_count 7"))
            .when(kind == 4, F.concat(F.lit("ERROR: "), text))
            .when(kind == 5, F.concat(F.lit("dv: ... running tool tool"), (num % 7).cast("string")))
            .when((kind == 6) & (num % 5 == 1), F.lit("cc1plus: warnings being treated as errors"))
            .when((kind == 7) & (num % 6 == 1),
                  F.concat(F.lit("# action: gc(a)::suite"), (num % 3).cast("string"),
                           F.lit("/case"), (num % 11).cast("string"), F.lit(".tool9")))
            .when(kind < 8, F.concat(F.lit("warning: "), text))
            .otherwise(F.concat(F.lit("info "), text))
        )
        return e.select(
            "log_file", "line_no",
            # a generator output, so that tests on the line are not rewritten into
            # hundreds of copies of the expression that builds it
            F.explode(F.array(line)).alias("line"),
        )

    # ------------------------------------------------------------------ tracker

    @cached_property
    def issues(self) -> DataFrame:
        d = self.table("documents")
        labels = self.table("labels").select("doc_id", "quality")
        num = F.col("doc_id")
        quality = F.col("quality")
        return d.join(labels, "doc_id", "left").select(
            F.concat(F.lit("DOC-"), num.cast("string")).alias("issue_key"),
            F.col("source").alias("project"),
            headline().alias("summary"),
            F.when(num % 4 == 0, F.concat("text", F.lit(". A workaround is to restart. End")))
            .otherwise(F.col("text")).alias("description"),
            F.when(quality == 1, "Resolved").when(quality == 0, "Open").otherwise("Closed")
            .alias("status"),
            F.when(quality == 1, F.lit("Fixed")).alias("resolution"),
            F.array("lang", "source").alias("labels"),
            (F.lit(1704067200) + num * 3600).alias("created_s"),
            (F.lit(1704067200) + num * 3600 + F.col("n_chars") * 60).alias("updated_s"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        turn = F.col("turn")
        return self.table("conversations").select(
            F.concat(F.lit("DOC-"), F.col("conv_id").cast("string")).alias("issue_key"),
            turn.alias("seq"), F.col("role").alias("author"),
            F.concat("text", F.lit(". Fix applied in turn "), turn.cast("string"),
                     F.lit(". End")).alias("body"),
            F.lit(None).cast("string").alias("created"),
        )

    @cached_property
    def issue_links(self) -> DataFrame:
        num = F.col("doc_id")
        key = lambda n: F.concat(F.lit("DOC-"), n.cast("string"))
        return self.table("documents").where(num % 5 != 0).select(
            key(num).alias("src_key"),
            # some targets are outside the table
            F.when(num % 11 == 0, F.concat(F.lit("GONE-"), num.cast("string")))
            .otherwise(key(num - num % 5)).alias("dst_key"),
            F.when(num % 2 == 0, "outward").otherwise("inward").alias("direction"),
            F.when(num % 3 != 0, F.lit("duplicates")).alias("outward"),
            F.when(num % 3 != 0, F.lit("is duplicated by")).alias("inward"),
        )

    @cached_property
    def tracker_projects(self) -> DataFrame:
        lead = self.table("supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("lead"))
        n = self.table("nation")
        r = self.table("region")
        return (
            n.join(r, n.n_regionkey == r.r_regionkey)
            .join(lead, n.n_nationkey == lead.s_nationkey, "left")
            .select(F.col("n_name").alias("key"), F.initcap("n_name").alias("name"),
                    F.col("r_name").alias("description"), "lead")
        )


def _status():
    return (
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "P", "passed")
        .otherwise("running")
    )
