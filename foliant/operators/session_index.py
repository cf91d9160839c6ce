"""The vector index of a session as a table, saved with its other tables (K7).

One row per embedded chunk: its cell, its distance to the cell's centre, the vector,
and whether it is the centre itself.  Centres are stored vectors of the session, those whose
ids come first by hash, so the index of a session depends on its chunks alone.  The
table is sorted by cell within a session.

A search in the index bounds what the rows of a cell can score by the query's score with the
centre and the cell's radius, and reads on until no further cell can hold a better row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.config import RetrievalConfig
from foliant.functions.vectors import inner_product, is_embedded, l2_distance, l2_norm
from foliant.operators.retrieval import DIGITS, _matrix, _scores
from foliant.runtime import written

ROWS_PER_GROUP = 16_384
INDEX = (
    "session string, cell int, id string, distance double, centre boolean, embedding array<float>"
)


def session_index(
    chunks: DataFrame, config: RetrievalConfig = RetrievalConfig(), *, id: str = "id",
    vector: str = "embedding", rows_per_group: int = ROWS_PER_GROUP,
) -> DataFrame:
    """The index rows of all sessions of ``chunks`` (session, id and vector).

    A session has ``nlist`` cells, or as many as it has embedded chunks.  Large sessions are
    dealt out to groups of bounded size, each of which gets the centres.  ``chunks`` are read
    for the sizes, the centres and the rows, so they should be a table; the assigned
    rows are written, as two passes follow.
    """
    rows = chunks.filter(is_embedded(F.col(vector))).select(
        "session", F.col(id).alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    first = Window.partitionBy("session").orderBy(F.md5(F.col("id").cast("string")), "id")
    centres = rows.withColumn("cell", F.row_number().over(first) - 1).filter(
        F.col("cell") < config.nlist).withColumnRenamed("id", "centre_id")
    sizes = rows.groupBy("session").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_group).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = rows.join(sizes, "session").withColumn("part", part).drop("parts")
    right = centres.join(sizes, "session").withColumn("part", every).drop("parts")
    right = right.toDF(*right.columns)  # columns of its own, for the cogroup
    sign = -1.0 if config.metric == "inner_product" else 1.0

    def assign(own: pa.Table, centre: pa.Table) -> pa.Table:
        centre = centre.sort_by("cell")
        dim = len(centre["embedding"][0]) if centre.num_rows else 0
        points, places = _matrix(own["embedding"], dim), _matrix(centre["embedding"], dim)
        cell = np.argmin(sign * _scores(points, places, config.metric), axis=1).astype(np.int32)
        distance = np.sqrt(np.square(points - places[cell]).sum(axis=1))
        names, ids = centre["centre_id"].to_pylist(), own["id"].to_pylist()
        return pa.table({
            "session": own["session"], "cell": pa.array(cell), "id": own["id"],
            "distance": pa.array(distance),
            "centre": pa.array([names[c] == i for c, i in zip(cell, ids)], pa.bool_()),
            "embedding": own["embedding"]})

    keys = ("session", "part")
    found = written(
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(assign, INDEX), "assigned")
    # A centre that lies nearer to another one is kept as the centre of its own cell.
    astray = found.filter("NOT centre").select("session", "id", F.lit(True).alias("astray")).join(
        centres.select("session", F.col("centre_id").alias("id"), F.col("cell").alias("own_cell")),
        ["session", "id"])
    return found.join(astray, ["session", "id"], "left").select(
        "session", F.coalesce("own_cell", "cell").alias("cell"), "id",
        F.when(F.col("astray"), 0.0).otherwise(F.col("distance")).alias("distance"),
        (F.col("centre") | F.coalesce("astray", F.lit(False))).alias("centre"), "embedding",
    ).hint("rebalance", "session")


def index_cells(index: DataFrame) -> DataFrame:
    """(session, cell, n, radius, centre): the cells of an index, as many as ``nlist`` per session."""
    return index.groupBy("session", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"),
        F.max_by("embedding", F.col("centre").cast("int")).alias("centre"))


def index_top_k(
    queries: DataFrame, index: DataFrame, *, k: int | None = None,
    config: RetrievalConfig = RetrievalConfig(),
) -> DataFrame:
    """Best ``k`` chunks of each query's session (query_id, id, score, rank), exact.

    ``queries``: query_id, session, embedding.  A row of a cell scores at most the centre's
    score plus the query's length times the radius (or lies no nearer than the centre's
    distance less the radius).  The ``nprobe`` cells with the best bounds come first, then those
    whose bound reaches the worst row found.  Rounded scores, ties to the smaller id.
    """
    k = k or config.max_context_chunks
    inner = config.metric == "inner_product"
    asked = written(
        queries.filter(is_embedded(F.col("embedding"))).select(
            "query_id", "session", F.col("embedding").alias("query")), "asked")
    cells = index_cells(index)
    towards = inner_product(F.col("query"), F.col("centre"))
    gap = F.greatest(F.lit(0.0), l2_distance(F.col("query"), F.col("centre")) - F.col("radius"))
    # Keys: smaller is better, like distances.
    bound = (-(towards + l2_norm(F.col("query")) * F.col("radius")) if inner else gap * gap) - 1e-6
    best_bound = Window.partitionBy("query_id").orderBy("bound", "cell")
    plan = written(
        asked.join(cells, "session").withColumn("bound", bound).withColumn(
            "place", F.row_number().over(best_bound)).select(
            "query_id", "session", "query", "cell", "bound", "place"), "cell-plan")
    rows = index.select("session", "cell", "id", "embedding")
    product = inner_product(F.col("query"), F.col("embedding"))
    apart = l2_distance(F.col("query"), F.col("embedding"))
    score = F.round(product if inner else apart * apart, DIGITS)
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score") if inner else F.asc("score"), "id")

    def best(probes: DataFrame, more: DataFrame | None = None) -> DataFrame:
        found = probes.join(rows, ["session", "cell"]).select("query_id", "id", score.alias("score"))
        found = found if more is None else found.unionByName(more.drop("rank"))
        return found.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)

    near = written(best(plan.filter(F.col("place") <= config.nprobe)), "near-rows")
    worst = near.filter(F.col("rank") == k).select(
        "query_id", (-F.col("score") if inner else F.col("score")).alias("worst"))
    open_cells = plan.filter(F.col("place") > config.nprobe).join(worst, "query_id", "left").filter(
        F.col("worst").isNull() | (F.col("bound") <= F.col("worst")))
    return best(open_cells.drop("worst"), near)
