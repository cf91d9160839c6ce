"""Query on benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.llm.decontamination import contaminations
from foliant.llm.registry import query
from foliant.llm.shared import table


@query("op8_simhash_windows")
def op8_simhash_windows(spark, sf_dir):
    """Documents with a passage like a benchmark item, one row per document and item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminations(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("contaminations").alias("found")).select(
        "doc_id", F.col("found.item").alias("item_id"), F.col("found.start").alias("start_word"),
        F.col("found.n_words").alias("n_words"), F.col("found.similarity").alias("similarity"),
    )
