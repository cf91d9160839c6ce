"""Similarity search over embedded chunks: flat and cell-pruned, exact top-k merge.

Scores come from one matrix product per Arrow batch, inside the tasks that
hold the vectors.  Each task keeps the best ``k`` rows per query and emits
only those, so the pairs are never materialised.  Query vectors travel to the
workers while they fit ``broadcast_bytes``; larger query sets meet the corpus
on a grid of bounded blocks.

Scores are rounded to six decimals before they are compared, so that ranks do
not depend on how rows fell into batches; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.config import RetrievalConfig
from foliant.functions.embedding import strings
from foliant.functions.vectors import is_embedded

DIGITS = 6
_BLOCK_CELLS = 500_000          # scores computed at once in a worker


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column to a row matrix; every row must have ``dim`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    if len(flat) != len(column) * dim:
        raise ValueError(f"embeddings do not all have {dim} components")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _ids(column: pa.Array) -> list:
    return strings(column) if pa.types.is_string(column.type) else column.to_pylist()


def _scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    product = queries @ vectors.T
    if metric == "inner_product":
        return np.round(product, DIGITS)
    squares = (queries * queries).sum(1)[:, None] + (vectors * vectors).sum(1)[None, :]
    return np.round(np.maximum(squares - 2 * product, 0.0), DIGITS)


class _Best:
    """The ``k`` smallest (key, id) pairs per query seen so far in this task."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(n_queries)]
        self.worst = np.full(n_queries, np.inf)

    def offer(self, which: np.ndarray, keys: np.ndarray, ids: list) -> None:
        allowed = keys < np.inf
        candidates = allowed & (keys <= self.worst[which][:, None])
        for row in np.flatnonzero(candidates.any(axis=1)):
            columns = np.flatnonzero(candidates[row])
            row_keys = keys[row, columns]
            if len(columns) > self.k:
                cut = np.partition(row_keys, self.k - 1)[self.k - 1]
                columns, row_keys = columns[row_keys <= cut], row_keys[row_keys <= cut]
            query = which[row]
            merged = self.rows[query] + [(key, ids[c]) for key, c in zip(row_keys, columns)]
            merged.sort()
            self.rows[query] = merged[:self.k]
            if len(merged) >= self.k:
                self.worst[query] = self.rows[query][-1][0]


def _search(
    batches: Iterator[tuple[list, np.ndarray, np.ndarray | None]],
    query_ids: list,
    queries: np.ndarray,
    probes: dict[int, np.ndarray] | None,
    metric: str,
    k: int | None,
    threshold: float | None,
    skip_same_id: bool,
) -> Iterator[tuple[list, list, list]]:
    """Matches of (ids, vectors, cells) batches as (query ids, ids, scores) columns.

    With ``k`` they come at the end, otherwise batch by batch.
    """
    best = _Best(len(query_ids), k) if k else None
    sign = -1.0 if metric == "inner_product" else 1.0
    everyone = np.arange(len(query_ids))
    number_of = {q: i for i, q in enumerate(query_ids)} if skip_same_id else {}
    for ids, vectors, cells in batches:
        for chosen, which in _work(len(ids), cells, probes, everyone):
            step = max(1, _BLOCK_CELLS // max(len(which), 1))
            for begin in range(0, len(chosen), step):
                block = chosen[begin:begin + step]
                scores = _scores(queries[which], vectors[block], metric)
                keys = sign * scores
                if threshold is not None:
                    keys[keys > sign * threshold] = np.inf
                if skip_same_id:
                    for column, at in enumerate(block):
                        own = number_of.get(ids[at])
                        if own is not None:
                            keys[which == own, column] = np.inf
                block_ids = [ids[at] for at in block]
                if best:
                    best.offer(which, keys, block_ids)
                    continue
                rows, columns = np.nonzero(keys < np.inf)
                if len(rows):
                    yield (
                        [query_ids[which[r]] for r in rows],
                        [block_ids[c] for c in columns],
                        scores[rows, columns].tolist(),
                    )
    if best:
        for query, found in enumerate(best.rows):
            if found:
                yield (
                    [query_ids[query]] * len(found),
                    [one for _, one in found],
                    [float(sign * key) for key, _ in found],
                )


def _work(count, cells, probes, everyone):
    """Pairs of (row numbers, query numbers) that have to be scored."""
    if probes is None:
        if count and len(everyone):
            yield np.arange(count), everyone
        return
    for cell in np.unique(cells):
        which = probes.get(int(cell))
        if which is not None:
            yield np.flatnonzero(cells == cell), which


def _result_type(queries: DataFrame, query_id: str, corpus: DataFrame, corpus_id: str):
    return T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType),
        T.StructField("id", corpus.schema[corpus_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _to_batches(rows: Iterator[tuple[list, list, list]], schema: pa.Schema):
    ids, others, scores = [], [], []
    for a, b, c in rows:
        ids += a
        others += b
        scores += c
        if len(ids) >= 10_000:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip((ids, others, scores), schema)], schema=schema
            )
            ids, others, scores = [], [], []
    if ids:
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip((ids, others, scores), schema)], schema=schema
        )


def _arrow_schema(result: T.StructType) -> pa.Schema:
    types = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
             T.DoubleType: pa.float64()}
    return pa.schema([(f.name, types[type(f.dataType)]) for f in result.fields])


def matches(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    query_id: str = "query_id",
    corpus_id: str = "id",
    vector: str = "embedding",
    k: int | None = None,
    threshold: float | None = None,
    skip_same_id: bool = False,
    config: RetrievalConfig = RetrievalConfig(),
) -> DataFrame:
    """Scored (query, chunk) matches: all above a threshold (J5) or the best ``k`` per task.

    All matches above a threshold may be as many as queries times chunks; give
    ``k`` too, or use ``top_k`` with a threshold, to bound them per query.

    If both sides have a ``cell`` column (an array of cells to probe on the
    query side) only pairs in the same cell are scored (V5).
    """
    if k is None and threshold is None:
        raise ValueError("matches needs k or a threshold")
    celled = "cell" in corpus.columns and "probes" in queries.columns
    asked = queries.filter(is_embedded(F.col(vector))).select(
        F.col(query_id).alias("query_id"), F.col(vector).alias("vector"),
        *(["probes"] if celled else []),
    )
    stored = corpus.filter(is_embedded(F.col(vector))).select(
        F.col(corpus_id).alias("id"), F.col(vector).alias("vector"), *(["cell"] if celled else [])
    )
    result = _result_type(queries, query_id, corpus, corpus_id)
    probe = asked.select(F.size("vector").alias("n")).first()
    if probe is None:
        return corpus.sparkSession.createDataFrame([], result)
    dim = probe["n"]
    room = max(1, config.broadcast_bytes // (8 * dim))
    collected = asked.limit(room + 1).toArrow()
    settings = (config.metric, k, threshold, skip_same_id)
    if collected.num_rows <= room:
        return _broadcast_matches(stored, collected, dim, celled, result, settings)
    return _grid_matches(stored, asked, dim, room, celled, result, settings)


def _broadcast_matches(stored, collected, dim, celled, result, settings) -> DataFrame:
    query_ids = collected["query_id"].to_pylist()
    probes = None
    if celled:
        members: dict[int, list[int]] = {}
        for number, cells in enumerate(collected["probes"].to_pylist()):
            for cell in cells:
                members.setdefault(cell, []).append(number)
        probes = {cell: np.array(m) for cell, m in members.items()}
        stored = stored.filter(F.col("cell").isin(*members))
    shipped = stored.sparkSession.sparkContext.broadcast(
        (query_ids, _matrix(collected["vector"], dim), probes)
    )
    schema = _arrow_schema(result)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, probed = shipped.value
        parts = (
            (
                _ids(b.column("id")),
                _matrix(b.column("vector"), dim),
                b.column("cell").to_numpy() if celled else None,
            )
            for b in batches if b.num_rows
        )
        yield from _to_batches(_search(parts, ids, matrix, probed, *settings), schema)

    return stored.mapInArrow(search, result)


def _grid_matches(stored, asked, dim, room, celled, result, settings) -> DataFrame:
    """Block by block: no side of a block exceeds the room of a broadcast.

    Rows of a cell go to blocks by a hash of their id, each block of the
    corpus meets each block of queries of the same cell once.  A cell that
    holds most of the rows just has more blocks.  Only the number of blocks
    per cell is collected.
    """
    if celled:
        asked = asked.withColumn("cell", F.explode("probes")).drop("probes")
    else:
        asked, stored = (df.withColumn("cell", F.lit(0)) for df in (asked, stored))

    def blocks(df: DataFrame) -> dict[int, int]:
        # Half-filled on average, so that uneven hashing stays within the room.
        counts = df.groupBy("cell").count().collect()
        return {c["cell"]: -(-2 * c["count"] // room) for c in counts}

    def blocks_of(counts: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("cell")]

    rows, columns = blocks(stored), blocks(asked)
    shared = rows.keys() & columns.keys()
    if not shared:
        return stored.sparkSession.createDataFrame([], result)
    in_both = F.col("cell").isin(*shared)

    def placed(df: DataFrame, key: str, own: str, own_counts, other: str, other_counts):
        every = F.sequence(F.lit(0), (blocks_of(other_counts) - 1).cast("int"))
        return df.filter(in_both).withColumns({
            own: F.pmod(F.xxhash64(key), blocks_of(own_counts)).cast("int"),
            other: F.explode(every),
        })

    left = placed(stored, "id", "row", rows, "column", columns)
    right = placed(asked, "query_id", "column", columns, "row", rows)
    schema = _arrow_schema(result)

    def search(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        part = [(_ids(chunks["id"]), _matrix(chunks["vector"], dim), None)]
        found = _search(
            part if chunks.num_rows else [], queries["query_id"].to_pylist(),
            _matrix(queries["vector"], dim), None, *settings,
        )
        return pa.Table.from_batches(list(_to_batches(found, schema)), schema=schema)

    keys = ("cell", "row", "column")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, result)


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    k: int | None = None,
    threshold: float | None = None,
    config: RetrievalConfig = RetrievalConfig(),
    **columns,
) -> DataFrame:
    """Best ``k`` chunks per query, ranked, at or above the threshold.

    Exact for a flat corpus; with cells it is exact within the probed cells.
    """
    k = k or config.max_context_chunks
    found = matches(queries, corpus, k=k, threshold=threshold, config=config, **columns)
    best_first = F.desc("score") if config.metric == "inner_product" else F.asc("score")
    window = Window.partitionBy("query_id").orderBy(best_first, F.asc("id"))
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


# -- cells (V5) --------------------------------------------------------------

def sampled_centroids(corpus: DataFrame, nlist: int, *, corpus_id: str = "id",
                      vector: str = "embedding") -> np.ndarray:
    """``nlist`` stored vectors picked by the order of a hash of their id."""
    rows = (
        corpus.filter(is_embedded(F.col(vector)))
        .orderBy(F.md5(F.col(corpus_id).cast("string"))).limit(nlist)
        .select(vector).toArrow()
    )
    column = rows[vector]
    return _matrix(column, len(column[0]))


def kmeans_centroids(
    corpus: DataFrame, nlist: int, *, vector: str = "embedding", max_iterations: int = 10,
    seed: int = 7,
) -> np.ndarray:
    """Centroids of k-means over every embedded row; MLlib passes over them in parallel.

    ``corpus`` should be a stored table, since each iteration reads it.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = corpus.filter(is_embedded(F.col(vector)))
    training = usable.select(array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(
        k=nlist, seed=seed, maxIter=max_iterations, initMode="k-means||"
    ).fit(training)
    return np.array(model.clusterCenters())


def nearest_cells(vector: Column, centroids: np.ndarray, count: int, metric: str) -> Column:
    """Numbers of the ``count`` nearest centroids, nearest first."""
    dim = centroids.shape[1]
    sign = -1.0 if metric == "inner_product" else 1.0

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        keys = sign * _scores(_matrix(vectors, dim), centroids, metric)
        order = np.argsort(keys, axis=1, kind="stable")[:, :count].astype(np.int32)
        return pa.array(list(order), pa.list_(pa.int32()))

    return cells(vector)


def assign_cells(corpus: DataFrame, centroids: np.ndarray, *, vector: str = "embedding",
                 metric: str = "inner_product") -> DataFrame:
    """Add the cell of each vector; partition the stored table by it."""
    usable = corpus.filter(is_embedded(F.col(vector)))
    return usable.withColumn(
        "cell", F.element_at(nearest_cells(F.col(vector), centroids, 1, metric), 1)
    )


def with_probes(queries: DataFrame, centroids: np.ndarray, nprobe: int, *,
                vector: str = "embedding", metric: str = "inner_product") -> DataFrame:
    """Add the cells each query looks into."""
    usable = queries.filter(is_embedded(F.col(vector)))
    return usable.withColumn("probes", nearest_cells(F.col(vector), centroids, nprobe, metric))


def cell_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    centroids: np.ndarray | None = None,
    config: RetrievalConfig = RetrievalConfig(),
    vector: str = "embedding",
    corpus_id: str = "id",
    **columns,
) -> DataFrame:
    """Approximate top-k: score only the ``nprobe`` cells nearest to a query (V5)."""
    if centroids is None:
        centroids = kmeans_centroids(corpus, config.nlist, vector=vector)
    return top_k(
        with_probes(queries, centroids, config.nprobe, vector=vector, metric=config.metric),
        assign_cells(corpus, centroids, vector=vector, metric=config.metric),
        config=config, vector=vector, corpus_id=corpus_id, **columns,
    )


def write_cells(
    corpus: DataFrame, path: str, *, centroids: np.ndarray | None = None,
    config: RetrievalConfig = RetrievalConfig(), vector: str = "embedding",
) -> None:
    """Store a corpus by cell, with the centroids beside it (V5).

    Large cells are written by several tasks, small ones together.
    """
    if centroids is None:
        centroids = kmeans_centroids(corpus, config.nlist, vector=vector)
    cells = assign_cells(corpus, centroids, vector=vector, metric=config.metric)
    cells.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
    corpus.sparkSession.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(centroids)],
        "cell int, centroid array<double>",
    ).coalesce(1).write.parquet(f"{path}/centroids")  # nlist rows


def search_cells(
    queries: DataFrame, path: str, *, config: RetrievalConfig = RetrievalConfig(),
    vector: str = "embedding", **columns,
) -> DataFrame:
    """Best chunks per query among the ``nprobe`` nearest stored cells; others are not read (V5)."""
    spark = queries.sparkSession
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    centroids = _matrix(rows["centroid"], len(rows["centroid"][0]))
    return top_k(
        with_probes(queries, centroids, config.nprobe, vector=vector, metric=config.metric),
        spark.read.parquet(f"{path}/cells"), config=config, vector=vector, **columns,
    )


# -- contexts (V8) -----------------------------------------------------------

def contexts(found: DataFrame, chunks: DataFrame,
             config: RetrievalConfig = RetrievalConfig(),
             render: Callable[[], Column] | None = None) -> DataFrame:
    """Prompt context per query from its ranked chunks within the token budget (V8).

    At most ``max_context_chunks`` rows per query reach a group.
    """
    joined = found.join(
        chunks.select("id", "content", "source_file", "token_count"), "id"
    )
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    budgeted = joined.withColumn("_used", F.sum("token_count").over(running)).filter(
        F.col("_used") <= config.max_tokens
    )
    part = render() if render else F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source_file"),
        F.lit("\n"), F.col("content"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"), "id")))
    return budgeted.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda o: o["part"]), "\n\n").alias("context"),
        F.array_join(F.transform(ordered, lambda o: o["id"]), ",").alias("source_chunks"),
        F.sum("token_count").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
