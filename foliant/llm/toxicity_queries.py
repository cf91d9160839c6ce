"""Query on toxicity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.llm.registry import query
from foliant.llm.shared import table
from foliant.llm.toxicity import toxicity, train

THRESHOLD = 0.7


def third() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


@query("op5_toxicity_instances")
def op5_toxicity_instances(spark, sf_dir):
    """Scores of all whole documents; a third of the ids is held out of the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), training=third() != 1)
    score = F.col("toxicity.score")
    return toxicity(docs, model).select(
        "doc_id", (third() == 1).alias("held_out"), score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
    )
