"""StructTypes of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of Spark's binary file source.
FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

# One element of the "chunks" list of a chunk document.
CHUNK_ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("start_position", T.LongType()),
    T.StructField("end_position", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
CHUNK_DOCUMENT = T.StructType([T.StructField("chunks", T.ArrayType(CHUNK_ENTRY))])

# One element of the "messages" list of a chat document.
CHAT_ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("source_chunks", T.ArrayType(T.StringType())),
])
CHAT_DOCUMENT = T.StructType([T.StructField("messages", T.ArrayType(CHAT_ENTRY))])

# A session metadata document.
METADATA_DOCUMENT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("total_chunks", T.LongType()),
    T.StructField("total_messages", T.LongType()),
    T.StructField("documents", T.ArrayType(T.StringType())),
])

# Input of the offline embedding script.
CHUNK_INPUT = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", T.StringType()),
]))
