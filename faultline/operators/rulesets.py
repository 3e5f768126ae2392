"""Log rules held in a table: each project has its own ordered rules, one job serves them all."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules as R
from ..functions.text import strip
from .logscan import _unless_ignored

SCHEMA = "project STRING, place INT, regex STRING, needed STRING, needed_lower STRING, level INT, pos STRING"


def rule_rows(project: str, rules: Iterable[R.Rule]) -> list[tuple]:
    """A rule list as rows of the table."""
    return [
        (project, i, r.java_regex(), r.needed_text(), r.stem_lower, r.level, r.pos) for i, r in enumerate(rules, 1)
    ]


def rule_table(spark: SparkSession, rules: dict[str, Iterable[R.Rule]]) -> DataFrame:
    rows = [row for project, of in rules.items() for row in rule_rows(project, of)]
    return spark.createDataFrame(rows, SCHEMA)


def classified_by_project(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """log_file, line_no, line, level, pos of lines ``(project, log_file, line_no, line)`` that a
    rule of their project matches: the first by place decides. Ignored and blank lines are
    left out; a project without rules matches nothing.

    A rule names text that its matches must hold; that is tested before its regex, in the
    join with the project's rules. Only lines that a regex matches are grouped, with one
    small record per rule found, so the text of a line is never shuffled for rules that miss.
    """
    line = F.col("line")
    low = F.lower(line)
    may = (F.col("needed").isNull() | line.contains(F.col("needed"))) & (
        F.col("needed_lower").isNull() | low.contains(F.col("needed_lower")))
    hits = lines.where(strip("line") != "").join(rules, "project").where(may).where(
        F.expr("regexp_like(line, regex)"))
    first = hits.groupBy("log_file", "line_no").agg(
        F.min(F.struct("place", "level", "pos")).alias("rule"), F.any_value("line").alias("line"))
    kept = first.withColumn("kept", _unless_ignored(lambda t: F.lit(True))).where("kept")
    return kept.select("log_file", "line_no", "line", "rule.level", "rule.pos")
