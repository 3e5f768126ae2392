"""Log files as ``log_lines(log_file, line_no, line)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .schemas import LOG_LINES

REPLACEMENT = "�"


def _without_bad_bytes(line):
    """Drop bytes that are not UTF-8; lines that are clean pass unchanged."""
    repaired = F.replace(F.make_valid_utf8(line), F.lit(REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(line), line).otherwise(repaired)


def stage_lines(spark: SparkSession, paths: str | list[str], out: str) -> None:
    """Read plain and gzip logs line by line into a staging table at ``out``.

    Rows carry the file, the start of the split they came from and a number that grows
    along the split. Large plain files are read by many tasks; a gzip file streams
    through one task and is never held as a whole.
    """
    (
        spark.read.text(paths)
        .select(
            F.col("_metadata.file_path").alias("log_file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row_id"),
            _without_bad_bytes(F.col("value")).alias("line"),
        )
        .write.mode("overwrite")
        .parquet(out)
    )


def staged_log_lines(spark: SparkSession, staged: str) -> DataFrame:
    """Numbered lines of a staging table.

    Row numbers of a split have no gaps, so a line number is its distance from the first
    row of the split plus the rows of the splits before it. Only one row per split is
    sorted within a file.
    """
    rows = spark.read.schema(
        "log_file STRING, split_start BIGINT, row_id BIGINT, line STRING"
    ).parquet(staged)
    splits = rows.groupBy("log_file", "split_start").agg(
        F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("log_file").orderBy("split_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = splits.select(
        "log_file", "split_start",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_id") + 1).alias("shift"),
    )
    return rows.join(shifts, ["log_file", "split_start"]).select(
        "log_file", (F.col("row_id") + F.col("shift")).cast("int").alias("line_no"), "line"
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A log_lines table written earlier."""
    return spark.read.schema(LOG_LINES).parquet(path)


def lines_of_text(logs: DataFrame, key: str = "log_file", text: str = "content") -> DataFrame:
    """Lines of logs held in a text column; only line feeds end a line."""
    return logs.select(
        F.col(key).alias("log_file"), F.posexplode(F.split(F.col(text), "\n"))
    ).select("log_file", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def existing_logs(lines: DataFrame) -> DataFrame:
    """log_file and n_lines of every log that has lines; reads no line text."""
    return lines.groupBy("log_file").agg(F.max("line_no").alias("n_lines"))
