"""Document files, saved JSON documents and script input as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import schema
from foliant.config import ChunkingConfig
from foliant.functions import text as tx
from foliant.runtime import gathered
from foliant.sources.files import hold_more_than, local_folders, read_files

_LISTED_BY_DRIVER = 10_000


def _as_documents(files: DataFrame, config: ChunkingConfig) -> DataFrame:
    small = files.filter(F.col("length") <= config.max_file_bytes)
    return small.select(
        F.col("path").alias("source_file"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        tx.detect_file_type("path").alias("file_type"),
    )


def read_documents(
    spark: SparkSession, path: str | list[str], config: ChunkingConfig = ChunkingConfig(), *,
    recursive: bool = True,
) -> DataFrame:
    """Whole files as documents (S1); the size limit is pushed into the scan.

    Bytes that are no UTF-8 become replacement characters.  Spark lists no
    empty files, which would give no chunks anyway.

    Spark's driver holds the status of every file it scans.  So where local folders (that all
    machines see) hold very many files, tasks list and read them (``files``), with the same rows.
    """
    if recursive:
        folders = local_folders(spark, [path] if isinstance(path, str) else path)
        if folders and hold_more_than(folders, _LISTED_BY_DRIVER):
            return _as_documents(read_files(spark, folders, config.max_file_bytes), config)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    return gathered(_as_documents(files, config))


def stream_documents(
    spark: SparkSession, path: str, config: ChunkingConfig = ChunkingConfig(), *,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Files of a folder as a stream, a bounded number per batch (ST1)."""
    files = (
        spark.readStream.format("binaryFile").schema(schema.FILES)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return _as_documents(files, config)


def _with_session(document: T.StructType) -> T.StructType:
    """The session of the files' folders, a string whatever it looks like; NULL where there is none."""
    return T.StructType([*document.fields, T.StructField("session", T.StringType())])


def read_chunk_documents(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Chunks of saved ``{"chunks": […]}`` documents.

    One document per line reads in parallel; ``multi_line`` takes files that
    hold one pretty-printed document.
    """
    documents = spark.read.schema(_with_session(schema.CHUNK_DOCUMENT)).json(
        path, multiLine=multi_line)
    return documents.select("session", F.inline("chunks"))


def read_chat_documents(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Messages of saved ``{"messages": […]}`` documents."""
    documents = spark.read.schema(_with_session(schema.CHAT_DOCUMENT)).json(
        path, multiLine=multi_line)
    return documents.select("session", F.inline("messages")).withColumn(
        "timestamp", F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss")
    )


def read_metadata_documents(
    spark: SparkSession, path: str, *, multi_line: bool = False
) -> DataFrame:
    """Session metadata documents (S10); long document lists come in several parts."""
    return spark.read.schema(_with_session(schema.METADATA_DOCUMENT)).json(
        path, multiLine=multi_line)


def parse_chunk_input(values: DataFrame, value: str = "value") -> DataFrame:
    """``(id, content, metadata)`` of JSON lists; a missing metadata is '' (S12).

    Input that is no such list fails the query.
    """
    parsed = values.select(
        F.inline(F.from_json(value, schema.CHUNK_INPUT, {"mode": "FAILFAST"}))
    )
    return parsed.withColumn("metadata", F.coalesce("metadata", F.lit("")))
