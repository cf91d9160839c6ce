"""Exact search over stored cells: a query reads on until no unread part can hold a better row.

A corpus is stored by k-means cell and, within a cell, by the angle to the centroid
(its ring).  For each such part the table of bounds keeps the ranges of the two components of
its vectors: along the centroid's direction and across it.  From these follows the best
score that any row of the part can have with a query, as the triangle inequality
would tell for the angles alone.

A search takes the parts of each query in the order of that bound, some more in every round,
and stops where the bound falls behind the worst of the ``k`` rows found so far.  A
threshold closes parts in the same way, so all pairs above one take a single round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.config import RetrievalConfig
from foliant.functions.vectors import is_embedded
from foliant.operators.retrieval import _matrix, _scores, kmeans_centroids, matches, top_k
from foliant.runtime import written

RING_DEGREES = 7.5
#: More than the rings there can be; the last one holds vectors that have no angle.
_RINGS = 100
#: Scores are rounded to six decimals before they are compared.
_SLACK = 1e-6


def _directions(centroids: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(centroids, axis=1, keepdims=True)
    return np.divide(centroids, norms, out=np.zeros_like(centroids), where=norms > 0)


def _split(rows: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of each row along a direction of its own, and the length of the rest."""
    along = np.einsum("ij,ij->i", rows, directions)
    return along, np.sqrt(np.maximum(np.einsum("ij,ij->i", rows, rows) - along * along, 0.0))


def place(vector: Column, centroids: np.ndarray, metric: str) -> Column:
    """``struct<cell, ring, along, across>`` of each vector."""
    dim, directions = centroids.shape[1], _directions(centroids)
    sign = -1.0 if metric == "inner_product" else 1.0
    kind = pa.struct([("cell", pa.int32()), ("ring", pa.int32()), ("along", pa.float64()),
                      ("across", pa.float64())])

    @F.arrow_udf("struct<cell:int,ring:int,along:double,across:double>")
    def placed(vectors: pa.Array) -> pa.Array:
        rows = _matrix(vectors, dim)
        cell = np.argmin(sign * _scores(rows, centroids, metric), axis=1).astype(np.int32)
        along, across = _split(rows, directions[cell])
        odd = ~(np.isfinite(along) & np.isfinite(across))
        along[odd], across[odd] = 0.0, np.inf
        angle = np.degrees(np.arctan2(across, along)) / RING_DEGREES
        ring = np.where(odd, _RINGS - 1, angle).astype(np.int32)
        return pa.StructArray.from_arrays(
            [pa.array(cell), pa.array(ring), pa.array(along), pa.array(across)], fields=list(kind))

    return placed(vector)


def write_bounded_cells(
    corpus: DataFrame, path: str, *, centroids: np.ndarray | None = None,
    config: RetrievalConfig = RetrievalConfig(), vector: str = "embedding",
) -> None:
    """Store a corpus by cell and ring, with centroids and bounds beside it (V5).

    Large parts are written by several tasks, small ones together.  The corpus is read once
    for the centroids' every pass and once for the write, so it should be a table.
    """
    if centroids is None:
        centroids = kmeans_centroids(corpus, config.nlist, vector=vector)
    usable = corpus.filter(is_embedded(F.col(vector)))
    cells = usable.withColumn("_place", place(F.col(vector), centroids, config.metric)).select(
        *corpus.columns, "_place.*")
    cells.hint("rebalance", "cell", "ring").write.partitionBy("cell", "ring").parquet(f"{path}/cells")
    spark = corpus.sparkSession
    spark.read.parquet(f"{path}/cells").groupBy("cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("along").alias("along_min"),
        F.max("along").alias("along_max"), F.min("across").alias("across_min"),
        F.max("across").alias("across_max"),
    ).coalesce(1).write.parquet(f"{path}/bounds")  # nlist rows for each ring
    spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(centroids)],
        "cell int, centroid array<double>",
    ).coalesce(1).write.parquet(f"{path}/centroids")


def best_keys(
    queries: np.ndarray, directions: np.ndarray, cells: np.ndarray, ranges: list[np.ndarray],
    metric: str,
) -> np.ndarray:
    """The smallest key that a row of each part can have, queries by parts.

    A key is a score, negative if larger scores are better.  ``ranges`` are the least and the
    largest components along and across the direction of a part's cell.
    """
    least, most, near, far = ranges
    along = (queries @ directions.T)[:, cells]
    squares = np.einsum("ij,ij->i", queries, queries)[:, None]
    across = np.sqrt(np.maximum(squares - along * along, 0.0))
    with np.errstate(invalid="ignore"):
        if metric == "inner_product":
            keys = -(np.maximum(along * least, along * most) + across * far)
            keys[np.isnan(keys)] = -np.inf
        else:
            gap = np.maximum(0.0, np.maximum(least - along, along - most))
            aside = np.maximum(0.0, np.maximum(across - far, near - across))
            keys = gap * gap + aside * aside
            keys[np.isnan(keys)] = 0.0
    return keys - _SLACK - 1e-9 * np.where(np.isfinite(keys), np.abs(keys), 0.0)


class Bounds:
    """What the rows of each stored part can score, and the parts as a corpus."""

    def __init__(self, spark: SparkSession, path: str, metric: str) -> None:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
        centroids = _matrix(rows["centroid"], len(rows["centroid"][0]))
        parts = spark.read.parquet(f"{path}/bounds").orderBy("cell", "ring").toPandas()
        self.metric, self.directions = metric, _directions(centroids)
        self.cells = parts["cell"].to_numpy()
        self.parts = (parts["cell"] * _RINGS + parts["ring"]).to_numpy().astype(np.int32)
        self.ranges = [parts[c].to_numpy() for c in (
            "along_min", "along_max", "across_min", "across_max")]
        self.corpus = spark.read.parquet(f"{path}/cells").withColumn(
            "cell", F.expr(f"cell * {_RINGS} + ring")).drop("ring", "along", "across")

    def probes(self, vector: Column, worst: Column, skip: int, count: int | None) -> Column:
        """Parts that may hold a row with a key of at most ``worst``, best first, from ``skip`` on."""
        parts, end = self.parts, None if count is None else skip + count
        known = (self.directions, self.cells, self.ranges, self.metric)

        @F.arrow_udf("array<int>")
        def open_parts(vectors: pa.Array, keys: pa.Array) -> pa.Array:
            best = best_keys(_matrix(vectors, known[0].shape[1]), *known)
            order = np.argsort(best, axis=1, kind="stable")[:, skip:end]
            able = np.take_along_axis(best, order, axis=1) <= keys.to_numpy()[:, None]
            return pa.array([parts[o[a]] for o, a in zip(order, able)], pa.list_(pa.int32()))

        return open_parts(vector, worst)


def exact_cell_top_k(
    queries: DataFrame, path: str, *, k: int | None = None, threshold: float | None = None,
    config: RetrievalConfig = RetrievalConfig(), query_id: str = "query_id",
    vector: str = "embedding", corpus_id: str = "id",
) -> DataFrame:
    """Best ``k`` stored rows per query, ranked, the same as a search over all of them (V5).

    Rounds take ``nprobe`` parts of each query, then twice as many more, and so on, as long as
    a part is open: one whose bound does not fall behind the query's worst row.  Each
    round reads the open parts only.  Ties go to the smaller id, so a part whose bound
    equals the worst score is open, too.
    """
    k = k or config.max_context_chunks
    sign = -1.0 if config.metric == "inner_product" else 1.0
    spark = queries.sparkSession
    bounds = Bounds(spark, path, config.metric)
    start = F.lit(float("inf") if threshold is None else sign * threshold)
    asked = written(
        queries.filter(is_embedded(F.col(vector))).select(
            F.col(query_id).alias("query_id"), F.col(vector).alias("embedding")), "asked")
    best_first = F.desc("score") if sign < 0 else F.asc("score")
    in_order = Window.partitionBy("query_id").orderBy(best_first, "id")
    best, waiting, skip, count = None, asked.withColumn("worst", start), 0, config.nprobe
    while True:
        probed = written(
            waiting.withColumn("probes", bounds.probes(F.col("embedding"), F.col("worst"), skip, count))
            .filter(F.size("probes") > 0).select("query_id", "embedding", "probes"), "probes")
        if best is not None and probed.isEmpty():
            return best
        found = top_k(probed, bounds.corpus.withColumnsRenamed({corpus_id: "id", vector: "embedding"}),
                      k=k, threshold=threshold, config=config).drop("rank")
        both = found if best is None else found.unionByName(best.drop("rank"))
        best = written(
            both.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k),
            "best-rows")
        # A query with fewer rows than asked for goes on with the bound it began with.
        last = best.filter(F.col("rank") == k).select("query_id", (sign * F.col("score")).alias("key"))
        waiting = asked.join(last, "query_id", "left").select(
            "query_id", "embedding", F.coalesce("key", start).alias("worst"))
        skip, count = skip + count, 2 * count


def pairs_above(
    queries: DataFrame, path: str, threshold: float, *,
    config: RetrievalConfig = RetrievalConfig(), query_id: str = "query_id",
    vector: str = "embedding", corpus_id: str = "id",
) -> DataFrame:
    """All (query, row) pairs at or above a threshold, without a bound on their number.

    Only parts whose bound reaches the threshold are read, and a query meets no other part.
    Matches leave a task batch by batch; their total is the caller's choice of a threshold.
    """
    sign = -1.0 if config.metric == "inner_product" else 1.0
    bounds = Bounds(queries.sparkSession, path, config.metric)
    usable = queries.filter(is_embedded(F.col(vector)))
    probed = usable.withColumn(
        "probes", bounds.probes(F.col(vector), F.lit(sign * threshold), 0, None))
    return matches(
        probed, bounds.corpus, query_id=query_id, corpus_id=corpus_id, vector=vector,
        threshold=threshold, config=config)
