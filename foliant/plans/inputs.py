"""Inputs of the named queries, derived from the given tables.

The raw texts hold none of the artefacts the cleaners and detectors look for,
so they are put in by plain string expressions.  Those expressions are valid
in Spark SQL and in DuckDB and are shared by both sides; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions.embedding import HashedWords, embed
from foliant.operators import corpus
from foliant.operators.extraction import document_chunks, text_chunks
from foliant.runtime import fresh_path, spread

EMBED_DIM = 64

SOURCE_FILE = (
    "concat('docs/', source, '/doc', doc_id, '.', CASE doc_id % 9 WHEN 0 THEN 'txt' "
    "WHEN 1 THEN 'md' WHEN 2 THEN 'PDF' WHEN 3 THEN 'csv' WHEN 4 THEN 'json' "
    "WHEN 5 THEN 'xml' WHEN 6 THEN 'htm' WHEN 7 THEN 'text' ELSE 'bin' END)"
)
NOISY_TEXT = (
    "concat('  ', replace(text, ' ', '  '), chr(13), chr(10), chr(13), chr(10), chr(10), "
    "chr(10), chr(10), replace(text, '. ', concat('.', chr(10), chr(13), chr(10), chr(13), "
    "chr(10), chr(9))), ' ', chr(10))"
)
PDF_TEXT = (
    "concat(chr(7), replace(replace(replace(text, 'e ', concat('e-', chr(10), '  ')), '. ', "
    "concat('.', chr(10), '  17 ', chr(10))), ', ', concat('.', chr(10), ' ')), chr(12), '   ')"
)
SENTENCE_TEXT = (
    "concat(replace(replace(text, ' the ', ' Dr. '), ', ', concat('?', chr(9))), "
    "' USA. e.g. x? Yes! No.', chr(10))"
)
PAGE_PART = (
    "concat(CASE WHEN i % 3 = 0 THEN concat(chr(10), i + 1, '. Heading of part ', i, chr(10)) "
    "ELSE '' END, substr(text, i * 500 + 1, 500), chr(10), chr(10), '--- Page ', i + 1, ' ---', "
    "chr(10), chr(10))"
)
PDF_INFO = (
    "concat('Title: report ', doc_id, chr(10), 'Subject: none', chr(10), "
    "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('Pages:   ', doc_id % 50, chr(10)) END, "
    "'  Author: indented', chr(10), 'Creator: ', source, chr(10), 'Encrypted: no')"
)
CHAT_EPOCH = "(1704067200 + conv_id * 3600 + turn * 60)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, content: str = "text") -> DataFrame:
    """Documents with path, session and content; ``content`` is an expression over ``text``."""
    return _labelled(table(spark, sf_dir, "documents"), content)


def heavy_documents(spark: SparkSession, sf_dir: str, content: str = "text") -> DataFrame:
    """``documents`` for costly row-wise work: small files are spread over the cores."""
    return _labelled(spread(table(spark, sf_dir, "documents"), "doc_id"), content)


def _labelled(rows: DataFrame, content: str) -> DataFrame:
    return rows.select(
        "doc_id", F.col("source").alias("session"),
        F.expr(SOURCE_FILE).alias("source_file"), F.expr(content).alias("content"),
    )


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page marker every 500 characters and numbered headings."""
    return heavy_documents(
        spark, sf_dir,
        "array_join(transform(sequence(0, cast((length(text) - 1) div 500 as int)), "
        f"i -> {PAGE_PART}), '')",
    )


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, treated as text."""
    return text_chunks(documents(spark, sf_dir), keep=("doc_id", "session"))


def routed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, each cleaned by its type."""
    return document_chunks(documents(spark, sf_dir), keep=("doc_id", "session"))


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_chunks(spark, sf_dir).withColumn(
        "embedding", embed("content", HashedWords(EMBED_DIM))
    )


def stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks as a written table, for work that passes over them repeatedly."""
    path = fresh_path(spark, "embedded-chunks")
    embedded_chunks(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as embedded queries."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text",
        embed("text", HashedWords(EMBED_DIM)).alias("embedding"),
    )


def label_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector with the smallest id of each label."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.min("vec_id").alias("head_id"), F.min_by("embedding", "vec_id").alias("head"),
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-and-answer log of the conversations.

    Each answer cites the first two chunks of the document with the number
    of its conversation.
    """
    pairs = corpus.pair_messages(table(spark, sf_dir, "conversations"))
    paths = documents(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), "source_file")
    moment = F.timestamp_seconds(F.expr(CHAT_EPOCH))
    return pairs.join(paths, "conv_id").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("session"),
        tx.message_id(moment, F.col("turn")).alias("id"),
        "question", "answer", moment.alias("timestamp"),
        F.array(
            tx.chunk_id("source_file", F.lit(0)), tx.chunk_id("source_file", F.lit(1))
        ).alias("source_chunks"),
        (F.col("conv_id") * 100000 + F.col("turn")).alias("seq"), "conv_id", "turn",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows: totals and a description that needs escaping."""
    totals = corpus.session_totals(routed_chunks(spark, sf_dir), chat(spark, sf_dir))
    return totals.withColumn(
        "description",
        F.when(F.col("total_messages") > 0, F.concat(
            F.lit('notes of "'), F.col("session"), F.lit('"'))).otherwise(F.lit("")),
    )


def session_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directory per user and day of the events, named like a saved session."""
    return table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        F.date_trunc("day", "ts").alias("day"),
    ).agg(F.min("ts").alias("ts")).select(
        tx.new_session_id(F.col("user"), F.col("ts")).alias("directory")
    )
