"""Search paths against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.config import RetrievalConfig
from foliant.functions import vectors as vec
from foliant.functions.embedding import HashedWords, embed
from foliant.operators import retrieval

DIM = 12
RNG = np.random.default_rng(3)
CORPUS = RNG.normal(size=(400, DIM)).astype(np.float32)
CORPUS[100:250] = CORPUS[7]              # many equal vectors: ties and a hot cell
QUERIES = RNG.normal(size=(30, DIM)).astype(np.float32)
QUERIES[3] = CORPUS[7]


@pytest.fixture(scope="module")
def tables(spark):
    corpus = spark.createDataFrame(
        [(f"c{i:03d}", v.tolist()) for i, v in enumerate(CORPUS)], "id string, embedding array<float>"
    ).repartition(5)
    extra = spark.createDataFrame([("none", None), ("void", [])], corpus.schema)
    queries = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(QUERIES)], "query_id bigint, embedding array<float>"
    )
    return queries, corpus.unionByName(extra)


def brute(metric, k=None, threshold=None):
    a, b = QUERIES.astype(float), CORPUS.astype(float)
    if metric == "inner_product":
        scores = np.round(a @ b.T, 6)
    else:
        scores = np.round(((a[:, None] - b[None]) ** 2).sum(2), 6)
    sign = -1 if metric == "inner_product" else 1
    out = set()
    for q in range(len(a)):
        order = sorted(range(len(b)), key=lambda c: (sign * scores[q, c], c))
        for rank, c in enumerate(order[:k], start=1):
            if threshold is None or sign * scores[q, c] <= sign * threshold:
                out.add((q, f"c{c:03d}", float(scores[q, c]), rank))
    return out


def got(df):
    return {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
@pytest.mark.parametrize("room", [64 * 1024 * 1024, 8 * DIM * 9])
def test_v4_flat_equals_brute_force(tables, metric, room):
    config = RetrievalConfig(metric=metric, broadcast_bytes=room)
    assert got(retrieval.top_k(*tables, k=7, config=config)) == brute(metric, 7)


def test_f5_threshold_cuts_the_top_k(tables):
    found = retrieval.top_k(*tables, k=7, threshold=4.0)
    assert got(found) == brute("inner_product", 7, 4.0) and found.count() > 0


@pytest.mark.parametrize("room", [64 * 1024 * 1024, 8 * DIM * 9])
def test_j5_all_pairs_above_a_threshold(tables, room):
    found = retrieval.matches(*tables, threshold=4.0, config=RetrievalConfig(broadcast_bytes=room))
    expected = {(q, c, s) for q, c, s, _ in brute("inner_product", None, 4.0)}
    rows = [(r.query_id, r.id, round(r.score, 6)) for r in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected


@pytest.mark.parametrize("room", [64 * 1024 * 1024, 8 * DIM * 9])
def test_v5_all_cells_equal_the_flat_search(tables, room):
    queries, corpus = tables
    centroids = retrieval.sampled_centroids(corpus, 6)
    config = RetrievalConfig(nprobe=6, broadcast_bytes=room)
    found = retrieval.cell_top_k(queries, corpus, centroids=centroids, config=config, k=7)
    assert got(found) == brute("inner_product", 7)


def test_v5_broadcast_and_grid_agree_on_some_cells(tables):
    queries, corpus = tables
    centroids = retrieval.sampled_centroids(corpus, 6)
    small, large = (
        got(retrieval.cell_top_k(
            queries, corpus, centroids=centroids, k=5,
            config=RetrievalConfig(nprobe=2, broadcast_bytes=room)))
        for room in (8 * DIM * 9, 64 * 1024 * 1024)
    )
    assert small == large and len(large) > 0


def test_v5_kmeans_recall(tables):
    queries, corpus = tables
    config = RetrievalConfig(nlist=8, nprobe=4)
    found = retrieval.cell_top_k(queries, corpus, config=config, k=5)
    hits = {(q, c) for q, c, _, _ in got(found)} & {(q, c) for q, c, _, _ in brute("inner_product", 5)}
    assert len(hits) >= 0.6 * 30 * 5


def test_same_ids_are_skipped(tables):
    _, corpus = tables
    found = retrieval.top_k(
        corpus.withColumnRenamed("id", "query_id"), corpus, k=1, skip_same_id=True)
    rows = found.collect()
    assert len(rows) == 400 and all(r.query_id != r.id for r in rows)


def test_mixed_dimensions_fail(spark, tables):
    queries, corpus = tables
    odd = spark.createDataFrame([("odd", [1.0])], corpus.schema)
    with pytest.raises(Exception, match="components"):
        retrieval.top_k(queries, corpus.unionByName(odd)).collect()


def test_no_queries_give_no_rows(tables):
    queries, corpus = tables
    assert retrieval.top_k(queries.filter("false"), corpus).count() == 0


def test_vector_functions(spark):
    df = spark.sql("SELECT array(3f, 4f) AS a, array(1f, 2f) AS b, array(0f, 0f) AS z")
    row = df.select(
        vec.inner_product(F.col("a"), F.col("b")).alias("ip"),
        vec.l2_squared(F.col("a"), F.col("b")).alias("sq"),
        vec.l2_norm(F.col("a")).alias("norm"),
        vec.cosine_similarity(F.col("a"), F.col("z")).alias("cz"),
        vec.truncate(F.col("a"), 1, renormalise=True).alias("t"),
        vec.truncate(F.col("z"), 1, renormalise=True).alias("tz"),
        vec.is_embedded(F.lit(None).cast("array<float>")).alias("e"),
    ).first()
    assert tuple(row) == (11.0, 8.0, 5.0, None, [1.0], [0.0], False)


def test_v7_batches_and_truncation(spark):
    df = spark.createDataFrame([(i, f"word{i} x\ty\nx") for i in range(50)], "i int, t string")
    whole = df.select("i", embed("t", HashedWords(32)).alias("v")).collect()
    parts = {r.i: r.v for r in df.select(
        "i", embed("t", HashedWords(32), truncate_dim=8, batch_size=16).alias("v")).collect()}
    for row in whole:
        assert len(row.v) == 32 and abs(sum(x * x for x in row.v) - 1) < 1e-6
        assert parts[row.i] == row.v[:8]


def test_v9_a_failing_model_fails_the_query(spark):
    class Failing:
        def open(self):
            pass

        def encode(self, texts):
            raise RuntimeError("model is gone")

    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="model is gone"):
        df.select(embed("t", Failing())).collect()


def test_v8_context_keeps_the_budget(spark):
    found = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "c", 1)], "query_id int, id string, rank int")
    chunks = spark.createDataFrame(
        [(i, f"text {i}", "f", 40) for i in "abc"],
        "id string, content string, source_file string, token_count bigint")
    rows = {r.query_id: r for r in retrieval.contexts(
        found, chunks, RetrievalConfig(max_tokens=100)).collect()}
    assert rows[1].source_chunks == "a,b" and rows[1].n_tokens == 80
    assert rows[1].context == "[1] f\ntext a\n\n[2] f\ntext b"
    assert rows[2].source_chunks == "c"
