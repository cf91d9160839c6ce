"""Incremental ingest of documents into a stored corpus (ST1–ST3, U3, V9).

Each micro-batch is checked against the stored paths, chunked, embedded and
written below its own ``run`` and ``batch_id`` folder.  A replayed batch
overwrites just that folder, so a restart after a failure adds nothing twice.
The run is the id of the streaming query, which lives in its checkpoint: a
stream with another checkpoint counts its batches anew, but in other folders.

A changed document comes again as a newer version.  Its chunks are added like
any others, and the version they replace is listed beside them; readers leave
out what is listed, and ``vacuum_chunks`` rewrites the batches that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.config import ChunkingConfig, IngestConfig
from foliant.functions.embedding import Embedder, embed, embed_or_reason
from foliant.functions.vectors import is_embedded
from foliant.operators.corpus import (
    DOCUMENT, first_by_path, new_documents, newer_documents, newest_by_path,
)
from foliant.operators.extraction import document_chunks
from foliant.runtime import names_below, remove, written
from foliant.streaming.catalog import DocumentCatalog, newest

_CHUNKS = (
    "id string, content string, source_file string, chunk_index int, start_position bigint, "
    "end_position bigint, token_count bigint, overlap_previous bigint, file_type string, "
    "session string, modified timestamp, embedding array<float>, run string, batch_id bigint"
)
_REPLACED = (
    "source_file string, session string, old_run string, old_batch bigint, "
    "run string, batch_id bigint"
)
_REJECTED = (
    "source_file string, session string, modified timestamp, content string, reason string, "
    "n_failed bigint, run string, batch_id bigint"
)


def ingested_documents(
    spark: SparkSession, root: str, config: IngestConfig = IngestConfig()
) -> DataFrame:
    """Stored paths, one row per document, with the totals of its newest version."""
    return DocumentCatalog(spark, root, config).documents().drop("bucket")


def ingested_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Stored chunks of the newest versions."""
    chunks = _read(spark, f"{root}/chunks", _CHUNKS)
    if not names_below(spark, f"{root}/replaced"):
        return chunks
    gone = _replaced(spark, root)
    return chunks.join(gone, _is_replaced(chunks, gone), "left_anti")


def _replaced(spark: SparkSession, root: str) -> DataFrame:
    """Versions that a later one has taken the place of."""
    return _read(spark, f"{root}/replaced", _REPLACED).selectExpr(
        "session AS _session", "source_file AS _file", "old_run AS _run", "old_batch AS _batch")


def _is_replaced(chunks: DataFrame, gone: DataFrame):
    return (
        (chunks.source_file == gone["_file"]) & chunks.session.eqNullSafe(gone["_session"])
        & (chunks.run == gone["_run"]) & (chunks.batch_id == gone["_batch"])
    )


def rejected_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents that the model refused, with the reason and the batch that tried (V9)."""
    return _read(spark, f"{root}/rejected", _REJECTED)


def session_totals(
    spark: SparkSession, root: str, config: IngestConfig = IngestConfig()
) -> DataFrame:
    """Documents, chunks, embedded chunks and tokens per session (A1, A3).

    Every batch lists the totals of its documents beside their paths, so these are
    sums over the document list; no chunk is read.  A replayed batch lists the same rows in
    the same place, and of a changed document the newest version counts.
    """
    return ingested_documents(spark, root, config).groupBy("session").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_chunks").alias("n_chunks"),
        F.sum("n_embedded").alias("n_embedded"), F.sum("n_tokens").alias("n_tokens"),
    ).withColumn("complete", F.col("n_embedded") == F.col("n_chunks"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _overwrite_batch(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("run", "batch_id").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def ingest_batch(
    documents: DataFrame,
    batch_id: int,
    root: str,
    *,
    run: str = "manual",
    embedder: Embedder | None = None,
    config: ChunkingConfig = ChunkingConfig(),
    order: str | None = None,
    version: str | None = None,
    reject_failures: bool = False,
    ingest: IngestConfig = IngestConfig(),
) -> None:
    """Add one batch of ``(source_file, content, session)`` rows to the corpus (ST2, ST3).

    The path check comes before cleaning and chunking, and looks up the buckets of
    the batch's paths only.  The chunks are written first; the document list, taken from
    the written chunks, is what later batches are checked against.  A document without
    chunks is not listed, so it may come again.  A document is known by session
    and path; of rows of one batch that share both, one is kept, the first by ``order``.

    ``version`` names a timestamp column (U3): a known document with a later one is taken in again
    and replaces its chunks, and of one batch the latest is kept.  The result is
    that of the newest versions, in whatever order they come.

    With ``reject_failures`` a text that the model refuses rejects its document instead of
    the batch (V9).  Rejected documents go to a table of their own, with reason and
    content, and are not listed; ``retry_rejected`` takes them in again.
    """
    spark = documents.sparkSession
    catalog = DocumentCatalog(spark, root, ingest)
    if catalog.has_merged(run, batch_id):
        return  # complete, and its list is already part of the merged one
    catalog.compact(run, batch_id)
    this_batch = (F.col("run") == run) & (F.col("batch_id") == batch_id)
    known = catalog.entries(catalog.buckets_of(documents)).filter(~this_batch)
    if version:
        typed = documents.withColumn("modified", F.col(version).cast("timestamp"))
        fresh = newer_documents(newest_by_path(typed, "modified"), known, "modified")
    else:
        plain = documents.withColumn("modified", F.lit(None).cast("timestamp"))
        fresh = new_documents(first_by_path(plain, order), known)
    keep = ("session", "modified")
    chunks = document_chunks(fresh, config, keep=keep)
    label = {"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")}
    if embedder and reject_failures:
        tried = written(
            chunks.withColumn("_found", embed_or_reason("content", embedder)).select(
                *chunks.columns, "_found.*"), "tried")
        failed = tried.filter("reason IS NOT NULL").groupBy(*DOCUMENT).agg(
            F.min_by("reason", "chunk_index").alias("reason"), F.count(F.lit(1)).alias("n_failed"))
        bad = failed.withColumnsRenamed({"session": "_session", "source_file": "_file"})

        def is_bad(rows: DataFrame):
            return (rows.source_file == bad["_file"]) & rows.session.eqNullSafe(bad["_session"])

        tries = fresh.select(*DOCUMENT, "modified", "content")
        rejected = tries.join(bad, is_bad(tries)).drop("_session", "_file")
        _overwrite_batch(rejected.withColumns(label), f"{root}/rejected")
        labelled = tried.drop("reason").join(bad, is_bad(tried), "left_anti").withColumns(label)
    else:
        vector = embed("content", embedder) if embedder else F.lit(None).cast("array<float>")
        labelled = chunks.withColumns({"embedding": vector, **label})
    _overwrite_batch(labelled, f"{root}/chunks")
    stored = _read(spark, f"{root}/chunks", _CHUNKS).filter(this_batch)
    listed = stored.groupBy(*DOCUMENT).agg(
        F.max("modified").alias("modified"), F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(is_embedded(F.col("embedding"))).alias("n_embedded"),
        F.sum("token_count").alias("n_tokens"),
    )
    if version:
        own, old = listed.select(*DOCUMENT), newest(known)
        replaced = old.join(
            own, (old.source_file == own.source_file) & old.session.eqNullSafe(own.session),
            "left_semi")
        _overwrite_batch(replaced.select(
            *DOCUMENT, F.col("run").alias("old_run"), F.col("batch_id").alias("old_batch")
        ).withColumns(label), f"{root}/replaced")
    catalog.add(listed, run, batch_id)


def retry_rejected(
    spark: SparkSession, root: str, batch_id: int, *, run: str = "retry", **options
) -> None:
    """Take rejected documents in again, those that meanwhile came otherwise left out (V9).

    The newest content of each is tried.  What is rejected once more is listed as such under
    this run; what is taken in is a document like any other.
    """
    options.setdefault("reject_failures", True)
    tried = newest_by_path(
        rejected_documents(spark, root).select(*DOCUMENT, "modified", "content"), "modified")
    if options.get("version"):
        options["version"] = "modified"
    ingest_batch(tried, batch_id, root, run=run, **options)


def vacuum_chunks(spark: SparkSession, root: str) -> int:
    """Rewrite the batches that hold replaced chunks without them; the number of batches.

    A batch is rewritten whole, in place of its folder, by one dynamic overwrite, which
    takes effect when all of its files are complete.  The list of replaced versions stays, and
    is as right afterwards as before.  A batch that holds nothing else is removed.
    Call it while no reader is at work, as overwritten files go.
    """
    chunks, gone = _read(spark, f"{root}/chunks", _CHUNKS), _replaced(spark, root)
    dead = chunks.join(gone, _is_replaced(chunks, gone), "left_semi")
    touched = written(dead.select("run", "batch_id").distinct(), "touched-batches")
    within = chunks.join(F.broadcast(touched) if touched.count() <= 10_000 else touched,
                         ["run", "batch_id"], "left_semi")
    kept = written(within.join(gone, _is_replaced(within, gone), "left_anti"), "kept-chunks")
    fields = [f.name for f in chunks.schema]
    _overwrite_batch(kept.select(*fields).hint("rebalance", "run", "batch_id"), f"{root}/chunks")
    empty = touched.join(kept.select("run", "batch_id").distinct(), ["run", "batch_id"], "left_anti")
    for run, batch in empty.collect():
        remove(spark, f"{root}/chunks/run={run}/batch_id={batch}")
    return touched.count()


def batch_writer(root: str, checkpoint: str, **options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function around ``ingest_batch``."""
    fallback = hashlib.md5(checkpoint.encode()).hexdigest()

    def write(documents: DataFrame, batch_id: int) -> None:
        context = documents.sparkSession.sparkContext
        run = context.getLocalProperty("sql.streaming.queryId") or fallback
        ingest_batch(documents, batch_id, root, run=run, **options)

    return write


def start_ingest(
    documents: DataFrame, root: str, checkpoint: str, *,
    available_now: bool = True, interval: str = "5 minutes", **options,
) -> StreamingQuery:
    """Start a streaming ingest: all there is now, or one batch per interval (ST1, ST2)."""
    writer = documents.writeStream.foreachBatch(batch_writer(root, checkpoint, **options)).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
