"""Query on sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.llm.registry import query
from foliant.llm.shared import table
from foliant.llm.uniform_shards import uniform_shards

SHARDS = 40


@query("op10_uniform_shards")
def op10_uniform_shards(spark, sf_dir):
    """All documents, whole, in shards whose row counts differ by one at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return uniform_shards(docs, SHARDS).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
