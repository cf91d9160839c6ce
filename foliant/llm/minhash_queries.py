"""Query on near duplicates by MinHash signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.llm.minhash_join import minhash_components
from foliant.llm.registry import query
from foliant.llm.shared import table


@query("op13_minhash_join")
def op13_minhash_join(spark, sf_dir):
    """Components of near copies (two words, 0.8) among the whole texts of all documents."""
    found = minhash_components(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
