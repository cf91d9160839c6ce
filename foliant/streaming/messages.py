"""Question-and-answer logs by batch, with totals that grow with each batch.

Beside its messages a batch writes the partial totals of its sessions.  A replayed batch
overwrites both, and totals are merged from the partial ones, so they are right after any
restart without a recount of the messages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import IngestConfig
from foliant.streaming.ingest import session_totals

_PARTIAL = (
    "session string, n_messages bigint, first_asked timestamp, last_asked timestamp, "
    "run string, batch_id bigint"
)


def add_messages(messages: DataFrame, batch_id: int, root: str, *, run: str = "manual") -> None:
    """Store one batch of messages (session, timestamp, and whatever else) and its totals.

    The totals come from the written rows, so they describe what is stored.
    """
    spark = messages.sparkSession
    labels = {"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")}
    _overwrite(messages.withColumns(labels), f"{root}/messages")
    stored = spark.read.schema(
        "session string, timestamp timestamp, run string, batch_id bigint"
    ).parquet(f"{root}/messages").filter((F.col("run") == run) & (F.col("batch_id") == batch_id))
    partial = stored.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("timestamp").alias("first_asked"),
        F.max("timestamp").alias("last_asked"))
    _overwrite(partial.withColumns(labels).hint("rebalance"), f"{root}/message_totals")


def _overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("run", "batch_id").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def message_totals(spark: SparkSession, root: str) -> DataFrame:
    """Messages per session, with the first and the last time, from the partial totals."""
    try:
        partial = spark.read.schema(_PARTIAL).parquet(f"{root}/message_totals")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        partial = spark.createDataFrame([], _PARTIAL)
    return partial.groupBy("session").agg(
        F.sum("n_messages").alias("n_messages"), F.min("first_asked").alias("first_asked"),
        F.max("last_asked").alias("last_asked"))


def corpus_totals(
    spark: SparkSession, root: str, config: IngestConfig = IngestConfig()
) -> DataFrame:
    """Documents, chunks, tokens and messages per session, neither chunks nor messages read (A1)."""
    documents = session_totals(spark, root, config)
    both = documents.join(message_totals(spark, root), "session", "full")
    counts = ("n_documents", "n_chunks", "n_embedded", "n_tokens", "n_messages")
    return both.na.fill(0, list(counts)).select("session", *counts, "first_asked", "last_asked")
