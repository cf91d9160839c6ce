"""Small helpers around the Spark session: shared folders and partition balance."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TASKS_PER_CORE = 8
_ROWS_PER_BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a session without other machines (tests) may leave it out.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir names no shared folder for {master or 'the cluster'}")
    return f"{tempfile.gettempdir()}/foliant-shared"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before.

    What is written there belongs to the caller, who may remove it once no
    DataFrame reads it any more; nothing else does.
    """
    return f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy row-wise work enough partitions.

    Input of fewer scan splits than cores is spread by a key that is unique per
    row.  Spark cuts files so that each core has a split, as long as splits do
    not get smaller than the cost of opening a file; so input with that many
    bytes per core comes in enough splits by itself and is not shuffled.  The
    size is the planner's estimate; nothing is run for it.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    if size >= cores * split or _is_spread(df, cores):
        return df
    return df.repartition(cores, *keys)


def _is_spread(df: DataFrame, cores: int) -> bool:
    """True if the last shuffle of the plan already made one partition per core."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1:
        if node.getClass().getSimpleName() == "RepartitionByExpression":
            return True
        node = node.children().head()
    return False


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in small Arrow batches, from now on in this session.

    A worker holds the batch it works on and the next one; with Spark's 10,000 rows these grow
    with the size of the input splits.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= _ROWS_PER_BATCH:
        spark.conf.set(key, str(_ROWS_PER_BATCH))


def gathered(df: DataFrame) -> DataFrame:
    """Give a scan of very many small files fewer tasks, without a shuffle.

    Spark counts each file as if it had some megabytes more, so a partition holds few of
    them.  There are as many tasks as the bytes need, by the planner's estimate, and some per
    core; a scan of fewer partitions stays as it is.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(tasks_for(df.sparkSession, size))


def tasks_for(spark: SparkSession, size: int) -> int:
    """Some tasks per core, or as many as that many bytes of input files need."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(_TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-size // most))


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written below the shared folder and read back.

    Cuts the lineage where a loop goes on with its own results, and survives lost
    executors.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder or file through the file system that Spark reads it by."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly below a folder; none if it does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(at))
