"""Query on near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.llm.near_duplicates import near_components
from foliant.llm.registry import query
from foliant.llm.shared import table


@query("op6_simhash_trie")
def op6_simhash_trie(spark, sf_dir):
    """Components of near copies among the whole texts of all documents."""
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = F.hex(F.col("prints")[0])
    return found.select("doc_id", F.lower(F.lpad(number, 16, "0")).alias("fingerprint"),
                        "component_id")
