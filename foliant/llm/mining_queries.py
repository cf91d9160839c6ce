"""Query on hard negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.llm.hard_negatives import hard_negatives, is_usable
from foliant.llm.registry import query
from foliant.llm.shared import table


@query("op11_threshold_negatives", """
WITH r AS (
  SELECT row_number() OVER () AS num, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.num AS a, a.vec_id AS anchor_id, b.num AS b, b.vec_id AS id, a.label = b.label AS same,
  list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.num <> b.num),
p AS (SELECT a, anchor_id, b, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.id AS negative_id,
  positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
""")
def op11_threshold_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector, with whole components and some labels moved on."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    usable = rows.filter(is_usable(F.col("embedding"))).select(
        "vec_id", moved.alias("label"), whole.alias("embedding"))
    return hard_negatives(usable, F.col("vec_id") % 100 == 0)
