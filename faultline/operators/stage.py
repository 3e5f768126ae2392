"""Writing an intermediate result down where several branches of a job read it."""

from __future__ import annotations

import contextlib
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders written by this process, by Spark application, until they are released.
_written: dict[str, list[str]] = defaultdict(list)


def stage_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir, shared by all executors.

    A session without that setting uses a folder of its own warehouse, which executors
    share as well; on a cluster that warehouse must not be a local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = warehouse.startswith("file:") or "://" not in warehouse
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; "
                         f"the warehouse {warehouse} is a local one")
    return f"{warehouse}/_staged"


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """The same rows as a table in that folder, written now.

    It cuts the lineage and survives lost executors; readers get pruned columns, and
    Spark sees the true size when it chooses a join. ``by`` names a number of which each
    value gets a folder, so that reading one leaves the others alone.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/faultline-{uuid.uuid4().hex}"
    _written[spark.sparkContext.applicationId].append(path)
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").partitionBy(*([by] if by else [])).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of what runs inside go once it is written, as only its table is read again.

    Else they stay until the driver's memory is collected, and the disk holds those of every
    step at once.
    """
    before = spark.conf.get(SHUFFLES_REMOVED, None)
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_REMOVED)
        else:
            spark.conf.set(SHUFFLES_REMOVED, before)


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for table in tables:
        _delete(table.sparkSession, table._staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(spark: SparkSession, since: int = 0) -> int:
    """Remove the tables staged after the first ``since``; returns how many.

    Call it once the results that read them are written.
    """
    paths = _written[spark.sparkContext.applicationId]
    for path in paths[since:]:
        _delete(spark, path)
    gone = len(paths) - since
    del paths[since:]
    return gone


@contextlib.contextmanager
def staging(spark: SparkSession):
    """Removes at its end what was staged inside it."""
    since = len(_written[spark.sparkContext.applicationId])
    try:
        yield
    finally:
        release(spark, since)
