"""Reading and writing warehouse and tracker tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import schemas

#: Rows of a file of facts.
FILE_ROWS = 2_000_000


def read_facts(
    spark: SparkSession, path: str, project: str | None = None, regression: str | None = None
) -> DataFrame:
    """Test results written by ``write_facts``; the arguments prune folders."""
    facts = spark.read.schema(
        schemas.TEST_OBJECT_RUN + ", project_name STRING, regression_name STRING"
    ).parquet(path)
    if project is not None:
        facts = facts.where(F.col("project_name") == project)
    if regression is not None:
        facts = facts.where(F.col("regression_name") == regression)
    return facts


def write_facts(facts: DataFrame, run_dims: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write test results in one folder per project and regression.

    One table replaces the table per project and regression; a partition filter replaces
    the table name. Rows of a folder are spread by run and id over one file per
    ``file_rows`` rows, counted first: a large regression is written by many tasks, a small
    one by a single task. Folders that ``facts`` has rows for are replaced; all others stay.
    """
    named = facts.join(
        run_dims, facts.regression_run_ref == run_dims.regression_run_id
    ).drop("regression_run_id")
    write_folders(named, path, ["project_name", "regression_name"],
                  F.xxhash64("regression_run_ref", "test_object_run_id"), file_rows)


def write_by_run(rows: DataFrame, path: str, run: str = "regression_run_ref", file_rows: int = FILE_ROWS) -> None:
    """Write a table with a folder per run, so that a join with some runs reads only theirs and
    a run that is loaded again replaces its own folder alone."""
    others = [c for c in rows.columns if c != run]
    write_folders(rows, path, [run], F.xxhash64(*others), file_rows)


def write_folders(rows: DataFrame, path: str, folders: list[str], spread: Column, file_rows: int) -> None:
    """Replace the folders that ``rows`` has, each in files of about ``file_rows`` rows."""
    sizes = rows.groupBy(*folders).agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("_files"))
    # A missing name is a folder as well.
    placed = rows.join(sizes.select(*[F.col(c).alias(f"_{c}") for c in folders], "_files"),
                       [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in folders])
    placed = placed.withColumn("_file", F.pmod(spread, F.col("_files"))).drop("_files", *[f"_{c}" for c in folders])
    (
        placed.repartition(*folders, "_file").drop("_file")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
    partitions: int, **options: str,
) -> DataFrame:
    """A database table read by ``partitions`` tasks over ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower,
                 upperBound=upper, numPartitions=partitions, **options)
        .load()
    )


def read_issues(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An issue export (parquet or json lines) with the fixed schema."""
    return spark.read.format(fmt).schema(schemas.ISSUE).load(path)


def read_comments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.COMMENT).load(path)


def write_result(result: DataFrame, path: str, fmt: str = "parquet") -> None:
    result.write.mode("overwrite").format(fmt).save(path)


def as_json(result: DataFrame) -> DataFrame:
    """One JSON text per row, with missing values kept as nulls."""
    return result.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")
    )
