"""Query on the class-based language model."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.llm.brown_classes import scores, train
from foliant.llm.registry import query
from foliant.llm.shared import table


@query("op3_brown_classes")
def op3_brown_classes(spark, sf_dir):
    """Scores of all whole documents; a seventh of the ids is held out of the training."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    texts = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"
    ).withColumn("training", ~F.col("held_out"))
    return scores(train(texts, "training"), "doc_id", "held_out")
