"""Queries on vectors and retrieval (V, J5, F5, F6)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from foliant.config import RetrievalConfig
from foliant.functions import vectors as vec
from foliant.operators import cells, retrieval
from foliant.plans import inputs as I
from foliant.plans import sql as S
from foliant.plans.registry import ORACLES, query
from foliant.runtime import fresh_path

CONFIG = RetrievalConfig()
MOST_BROADCAST = 10_000

_HEADS = (
    "heads AS (SELECT label, min(vec_id) AS head_id, arg_min(embedding, vec_id) AS head "
    "FROM embeddings GROUP BY label)"
)
_TO_HEAD = f"WITH {_HEADS} SELECT vec_id, {{}} FROM embeddings JOIN heads USING (label)"


def _with_head(spark, sf_dir):
    """Each vector with the head of its label."""
    heads = I.label_heads(spark, sf_dir)
    # A row per label; labels are few, but that is checked.
    few = heads.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return I.table(spark, sf_dir, "embeddings").join(F.broadcast(heads) if few else heads, "label")


@query("v1_truncate", (
    "SELECT vec_id, pos::INTEGER AS pos, round(cut[pos + 1], 6) AS component, "
    "round((cut[pos + 1] / sqrt(list_sum(list_transform(cut, lambda x: x * x))))::FLOAT::DOUBLE, 5) "
    "AS unit_component FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS cut, "
    "unnest(range(0, 16)) AS pos FROM embeddings)"
))
def v1_truncate(spark, sf_dir):
    pairs = I.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(
        vec.truncate(F.col("embedding"), 16).alias("cut"),
        vec.truncate(F.col("embedding"), 16, renormalise=True).alias("unit"),
    )).alias("pos", "pair"))
    return pairs.select(
        "vec_id", "pos", F.round(F.col("pair.cut").cast("double"), 6).alias("component"),
        F.round(F.col("pair.unit").cast("double"), 5).alias("unit_component"),
    )


@query("v2_inner_product", _TO_HEAD.format(
    "round(list_inner_product(embedding::DOUBLE[], head::DOUBLE[]), 6) AS score"
))
def v2_inner_product(spark, sf_dir):
    score = vec.inner_product(F.col("embedding"), F.col("head"))
    return _with_head(spark, sf_dir).select("vec_id", F.round(score, 6).alias("score"))


@query("v3_l2_distance", _TO_HEAD.format(
    "round(list_distance(embedding::DOUBLE[], head::DOUBLE[]), 6) AS distance, "
    "round(pow(list_distance(embedding::DOUBLE[], head::DOUBLE[]), 2), 6) AS squared"
))
def v3_l2_distance(spark, sf_dir):
    a, b = F.col("embedding"), F.col("head")
    return _with_head(spark, sf_dir).select(
        "vec_id", F.round(vec.l2_distance(a, b), 6).alias("distance"),
        F.round(vec.l2_squared(a, b), 6).alias("squared"),
    )


@query("v6_norm_and_cosine", _TO_HEAD.format(
    "round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, "
    "round(list_cosine_similarity(embedding::DOUBLE[], head::DOUBLE[]), 6) AS cosine"
))
def v6_norm_and_cosine(spark, sf_dir):
    a, b = F.col("embedding"), F.col("head")
    return _with_head(spark, sf_dir).select(
        "vec_id", F.round(vec.l2_norm(a), 6).alias("norm"),
        F.round(vec.cosine_similarity(a, b), 6).alias("cosine"),
    )


_VECTORS = [*S.chunks(), *S.embedded("v", "chunks", "id", "content")]


@query("v7_embed_chunks", S.with_ctes(_VECTORS, (
    "SELECT id, bucket::INTEGER AS bucket, round(weight::DOUBLE * 1000000)::BIGINT AS weight FROM v"
)))
def v7_embed_chunks(spark, sf_dir):
    parts = I.embedded_chunks(spark, sf_dir).select(
        "id", F.posexplode("embedding").alias("bucket", "weight")
    )
    return parts.filter(F.col("weight") != 0).select(
        "id", "bucket",
        F.round(F.col("weight").cast("double") * 1000000).cast("bigint").alias("weight"),
    )


@query("f6_embedded_only", S.with_ctes(_VECTORS, (
    "SELECT source_file, count(*) AS n_embedded FROM chunks WHERE id IN (SELECT id FROM v) "
    "GROUP BY source_file"
)))
def f6_embedded_only(spark, sf_dir):
    kept = I.embedded_chunks(spark, sf_dir).filter(vec.is_embedded(F.col("embedding")))
    return kept.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_embedded"))


_SCORES = [
    *_VECTORS, *S.embedded("q", "benchmark", "item_id", "text"),
    "scores AS (SELECT item_id AS query_id, id, round(sum(q.weight::DOUBLE * v.weight::DOUBLE), 6) "
    "AS score FROM q JOIN v ON q.bucket = v.bucket GROUP BY 1, 2)",
    "ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"
    "::INTEGER AS rank FROM scores)",
]


MOST_SIMILAR = 100


@query("j5_similar_pairs", S.with_ctes(
    _SCORES, "SELECT query_id, id, score FROM ranks "
    f"WHERE score >= {CONFIG.similarity_threshold} AND rank <= {MOST_SIMILAR}"
))
def j5_similar_pairs(spark, sf_dir):
    """The most similar chunks of each query, a bounded number, above the threshold."""
    return retrieval.top_k(
        I.questions(spark, sf_dir), I.embedded_chunks(spark, sf_dir), k=MOST_SIMILAR,
        threshold=CONFIG.similarity_threshold,
    ).select("query_id", "id", "score")


@query("j5_all_pairs", S.with_ctes(
    _SCORES, f"SELECT query_id, id, score FROM ranks WHERE score >= {CONFIG.similarity_threshold}"
))
def j5_all_pairs(spark, sf_dir):
    """All chunks above the threshold of each query, read from the cells that can hold one."""
    return cells.pairs_above(
        I.questions(spark, sf_dir), _bounded_cells(spark, sf_dir), CONFIG.similarity_threshold)


@query("v4_flat_top_k", S.with_ctes(
    _SCORES, "SELECT query_id, id, score, rank FROM ranks WHERE rank <= 5"
))
def v4_flat_top_k(spark, sf_dir):
    return retrieval.top_k(I.questions(spark, sf_dir), I.embedded_chunks(spark, sf_dir))


@query("f5_similarity_threshold", S.with_ctes(
    _SCORES, "SELECT query_id, id, score, rank FROM ranks WHERE rank <= 5 "
    f"AND score >= {CONFIG.similarity_threshold}"
))
def f5_similarity_threshold(spark, sf_dir):
    return retrieval.top_k(
        I.questions(spark, sf_dir), I.embedded_chunks(spark, sf_dir),
        threshold=CONFIG.similarity_threshold,
    )


_HEAD_SCORES = (
    f"WITH {_HEADS} SELECT * FROM (SELECT label AS query_id, vec_id AS id, "
    "{0} AS score, row_number() OVER (PARTITION BY label ORDER BY {0}{1}, vec_id)::INTEGER AS rank "
    "FROM heads CROSS JOIN (SELECT vec_id, embedding FROM embeddings)) WHERE rank <= 5"
)


@query("v4_flat_top_k_vectors", _HEAD_SCORES.format(
    "round(list_inner_product(embedding::DOUBLE[], head::DOUBLE[]), 6)", " DESC"
))
def v4_flat_top_k_vectors(spark, sf_dir):
    return _vector_search(spark, sf_dir, CONFIG)


@query("v4_flat_top_k_l2", _HEAD_SCORES.format(
    "round(list_sum(list_transform(list_zip(embedding::DOUBLE[], head::DOUBLE[]), "
    "lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)", ""
))
def v4_flat_top_k_l2(spark, sf_dir):
    return _vector_search(spark, sf_dir, replace(CONFIG, metric="l2"))


def _vector_search(spark, sf_dir, config):
    heads = I.label_heads(spark, sf_dir).select(
        F.col("label").alias("query_id"), F.col("head").alias("embedding")
    )
    vectors = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.top_k(heads, vectors, config=config)


def _bounded_cells(spark, sf_dir):
    path = fresh_path(spark, "bounded-cells")
    cells.write_bounded_cells(I.stored_embeddings(spark, sf_dir), path)
    return path


@query("v5_exact_cells", ORACLES["v4_flat_top_k"])
def v5_exact_cells(spark, sf_dir):
    """Cells with bounds at the default settings: rows equal the flat search, parts are left unread."""
    return cells.exact_cell_top_k(I.questions(spark, sf_dir), _bounded_cells(spark, sf_dir))


@query("v5_exact_cells_threshold", ORACLES["f5_similarity_threshold"])
def v5_exact_cells_threshold(spark, sf_dir):
    return cells.exact_cell_top_k(
        I.questions(spark, sf_dir), _bounded_cells(spark, sf_dir),
        threshold=CONFIG.similarity_threshold)


@query("v5_exact_cells_l2", ORACLES["v4_flat_top_k_l2"])
def v5_exact_cells_l2(spark, sf_dir):
    """The same by distances, over the given vectors."""
    config, path = replace(CONFIG, metric="l2"), fresh_path(spark, "bounded-cells")
    heads = I.label_heads(spark, sf_dir).select(
        F.col("label").alias("query_id"), F.col("head").alias("embedding"))
    vectors = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    cells.write_bounded_cells(vectors, path, config=config)
    return cells.exact_cell_top_k(heads, path, config=config)


def _stored_cells(spark, sf_dir):
    path = fresh_path(spark, "cells")
    retrieval.write_cells(I.stored_embeddings(spark, sf_dir), path)
    return path


@query("v5_cell_top_k", ORACLES["v4_flat_top_k"])
def v5_cell_top_k(spark, sf_dir):
    """k-means cells as a stored table; probing all of them equals the flat search."""
    return retrieval.search_cells(
        I.questions(spark, sf_dir), _stored_cells(spark, sf_dir),
        config=replace(CONFIG, nprobe=CONFIG.nlist),
    )


@query("v5_cell_recall", "SELECT count(*) AS n_queries, true AS enough FROM benchmark")
def v5_cell_recall(spark, sf_dir):
    """Whether half of the cells hold four fifths of the exact results."""
    chunks, asked = I.stored_embeddings(spark, sf_dir), I.questions(spark, sf_dir)
    path = fresh_path(spark, "cells")
    retrieval.write_cells(chunks, path)
    near = retrieval.search_cells(asked, path, config=replace(CONFIG, nprobe=CONFIG.nlist // 2))
    exact = retrieval.top_k(asked, chunks)
    found = exact.join(near.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return found.agg(
        F.countDistinct("query_id").alias("n_queries"),
        (F.count("hit") >= 0.8 * F.count(F.lit(1))).alias("enough"),
    )


@query("v5_default_recall", "SELECT count(*) AS n_queries, true AS enough FROM benchmark")
def v5_default_recall(spark, sf_dir):
    """Whether the cells probed by default hold nine tenths of the exact results."""
    chunks, asked = I.stored_embeddings(spark, sf_dir), I.questions(spark, sf_dir)
    path = fresh_path(spark, "cells")
    retrieval.write_cells(chunks, path)
    near = retrieval.search_cells(asked, path).select("query_id", "id", F.lit(1).alias("hit"))
    found = retrieval.top_k(asked, chunks).join(near, ["query_id", "id"], "left")
    return found.agg(
        F.countDistinct("query_id").alias("n_queries"),
        (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"),
    )


_CELLS = [
    "c AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER ("
    "ORDER BY md5(vec_id::VARCHAR)) - 1 AS cell FROM embeddings "
    "QUALIFY row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) <= 16)",
    _HEADS,
    "placed AS (SELECT v.vec_id AS id, v.embedding::DOUBLE[] AS e, arg_min(c.cell, "
    "-round(list_inner_product(v.embedding::DOUBLE[], c.e), 6) * 1000000 * 1000 + c.cell) AS cell "
    "FROM embeddings v CROSS JOIN c GROUP BY ALL)",
    "probed AS (SELECT label AS query_id, head::DOUBLE[] AS h, cell FROM heads CROSS JOIN "
    "(SELECT e, cell FROM c) QUALIFY row_number() OVER (PARTITION BY label ORDER BY "
    "round(list_inner_product(head::DOUBLE[], e), 6) DESC, cell) <= 4)",
    "hits AS (SELECT query_id, id, round(list_inner_product(h, e), 6) AS score "
    "FROM probed JOIN placed ON probed.cell = placed.cell)",
]


@query("v5_cell_top_k_sampled", S.with_ctes(_CELLS, (
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank "
    "FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5"
)))
def v5_cell_top_k_sampled(spark, sf_dir):
    """Cells around stored vectors, which SQL can follow exactly."""
    heads = I.label_heads(spark, sf_dir).select(
        F.col("label").alias("query_id"), F.col("head").alias("embedding")
    )
    vectors = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.cell_top_k(
        heads, vectors, centroids=retrieval.sampled_centroids(vectors, 16),
        config=replace(CONFIG, nprobe=4),
    )


@query("v8_retrieval_context", S.with_ctes([
    *_SCORES,
    "used AS (SELECT r.query_id, r.rank, r.id, c.source_file, c.content, c.token_count, "
    "sum(c.token_count) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS used "
    "FROM ranks r JOIN chunks c ON c.id = r.id WHERE r.rank <= 5)",
], (
    "SELECT query_id, string_agg(concat('[', rank, '] ', source_file, chr(10), content), "
    "concat(chr(10), chr(10)) ORDER BY rank) AS context, "
    "string_agg(id, ',' ORDER BY rank) AS source_chunks, sum(token_count)::BIGINT AS n_tokens, "
    "count(*) AS n_chunks FROM used WHERE used <= 700 GROUP BY query_id"
)))
def v8_retrieval_context(spark, sf_dir):
    chunks = I.stored_embeddings(spark, sf_dir)
    found = retrieval.top_k(I.questions(spark, sf_dir), chunks)
    return retrieval.contexts(found, chunks, replace(CONFIG, max_tokens=700))
