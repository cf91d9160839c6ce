"""Relational operators on chunk, chat and session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.config import SessionConfig
from foliant.functions import text as tx
from foliant.functions.vectors import is_embedded
from foliant.operators.ordered import ROWS_PER_RANGE, with_next, with_position

#: A document is known by its session and path; two sessions may hold one path.
DOCUMENT = ("session", "source_file")



# -- documents ---------------------------------------------------------------

def first_by_path(
    incoming: DataFrame, order: str | None = None, keys: tuple[str, ...] = DOCUMENT
) -> DataFrame:
    """One row per document, the first by ``order``.

    Rows with equal orders, or all where none is given, go by a hash of their
    columns, so one row is kept in any case.  Each task keeps one row per
    document before the shuffle.
    """
    columns = incoming.columns
    rank = F.struct(*([F.col(order)] if order else []), F.xxhash64(*columns))
    return incoming.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), rank).alias("_first")
    ).select("_first.*")


def new_documents(
    incoming: DataFrame, existing: DataFrame, keys: tuple[str, ...] = DOCUMENT
) -> DataFrame:
    """Documents that are not in the corpus yet, by session and path.

    The stored keys are cut down to those of the incoming documents first.
    A batch of keys is small and can be broadcast, so the large stored side
    is only scanned, and the contents meet a list no longer than the batch.
    """
    asked = incoming.select(*keys)
    stored = existing.select(*(F.col(key).alias(f"_{key}") for key in keys))
    known = stored.join(asked, _pairs(stored, asked, keys), "left_semi")
    return incoming.join(known, _pairs(known, incoming, keys), "left_anti")


def _pairs(marked: DataFrame, plain: DataFrame, keys: tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & marked[f"_{key}"].eqNullSafe(plain[key])
    return condition


def changed_documents(
    incoming: DataFrame, existing: DataFrame, keys: tuple[str, ...] = DOCUMENT
) -> DataFrame:
    """Documents that are new or have another modification time."""
    keys = (*keys, "modified")
    stored = existing.select(*(F.col(key).alias(f"_{key}") for key in keys))
    return incoming.join(stored, _pairs(stored, incoming, keys), "left_anti")


def newest_by_path(
    incoming: DataFrame, version: str, keys: tuple[str, ...] = DOCUMENT
) -> DataFrame:
    """One row per document, that with the largest ``version`` (U3); of equal ones any."""
    columns = incoming.columns
    rank = F.struct(F.col(version), F.xxhash64(*columns))
    return incoming.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), rank).alias("_newest")
    ).select("_newest.*")


def newer_documents(
    incoming: DataFrame, existing: DataFrame, version: str, keys: tuple[str, ...] = DOCUMENT
) -> DataFrame:
    """Documents that are new or have a larger version than all of the stored ones.

    The stored rows are cut down to the keys of the incoming documents first, like in
    ``new_documents``.  A missing version is less than any other.
    """
    asked = incoming.select(*keys)
    stored = existing.select(
        *(F.col(key).alias(f"_{key}") for key in keys), F.col(version).alias("_version"))
    known = stored.join(asked, _pairs(stored, asked, keys), "left_semi").groupBy(
        *(f"_{key}" for key in keys)).agg(F.max("_version").alias("_version"))
    no_newer = F.coalesce(incoming[version] <= known["_version"], incoming[version].isNull())
    return incoming.join(known, _pairs(known, incoming, keys) & no_newer, "left_anti")


def distinct_documents(chunks: DataFrame) -> DataFrame:
    """Paths as a set."""
    return chunks.select("session", "source_file").distinct()


def document_list(
    documents: DataFrame, order: str, *, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Ordered list of the documents of each session, one row per entry (A4)."""
    return with_position(documents, "session", order, rows_per_range=rows_per_range)


def append(corpus: DataFrame, added: DataFrame) -> DataFrame:
    """Corpus plus new chunks."""
    return corpus.unionByName(added, allowMissingColumns=True)


def without_session(table: DataFrame, name: str) -> DataFrame:
    """Everything but one session (U2); prunes partitions of a table by session."""
    return table.filter(F.col("session") != name)


# -- chunks ------------------------------------------------------------------

def stored_columns(chunks: DataFrame) -> DataFrame:
    """The six columns of a stored chunk."""
    return chunks.select(
        "id", "content", "source_file", "chunk_index", "start_position", "end_position"
    )


def attach_embeddings(chunks: DataFrame, embeddings: DataFrame, order: str) -> DataFrame:
    """Left join on id; the last duplicate by ``order`` wins.

    Duplicates are reduced before the join, with map-side combining, so one
    id repeated very often does not reach the join as a hot key.
    """
    latest = embeddings.groupBy("id").agg(F.max_by("embedding", order).alias("embedding"))
    return chunks.join(latest, "id", "left")


def embedding_coverage(chunks: DataFrame) -> DataFrame:
    """Embedded and all chunks per session (A3)."""
    counted = chunks.groupBy("session").agg(
        F.count_if(is_embedded(F.col("embedding"))).alias("n_embedded"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    return counted.withColumn("complete", F.col("n_embedded") == F.col("n_chunks"))


def incomplete_documents(chunks: DataFrame) -> DataFrame:
    """Documents with at least one chunk that got no embedding (V9)."""
    missing = chunks.filter(~is_embedded(F.col("embedding")))
    return missing.select(*DOCUMENT).distinct()


def fully_embedded(chunks: DataFrame) -> DataFrame:
    """Chunks of the documents that are embedded throughout (V9).

    For models that answer NULL instead of failing: one missing embedding
    rejects its whole document.  One pass; a window holds one document.
    """
    document = Window.partitionBy(*DOCUMENT)
    missing = F.max(~is_embedded(F.col("embedding"))).over(document)
    return chunks.withColumn("_missing", missing).filter(~F.col("_missing")).drop("_missing")


def embedding_batches(chunks: DataFrame, batch_size: int = 16) -> DataFrame:
    """Chunks of each document in request batches (A5).

    The chunk index already numbers them, so no window is needed.
    """
    return chunks.groupBy(
        *DOCUMENT, F.floor(F.col("chunk_index") / batch_size).alias("batch")
    ).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("token_count").alias("n_tokens"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda c: c["id"]
            ),
            ",",
        ).alias("ids"),
    )


# -- chat --------------------------------------------------------------------

def pair_messages(
    turns: DataFrame, *, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Questions with the answer in the next turn of their conversation."""
    paired = with_next(
        turns, "conv_id", "turn",
        {"next_role": F.col("role"), "answer": F.col("text")},
        rows_per_range=rows_per_range,
    )
    return paired.filter(
        (F.col("role") == "user") & (F.col("next_role") == "assistant")
    ).withColumnRenamed("text", "question").drop("role", "next_role")


def last_message(chat: DataFrame, order: list[str]) -> DataFrame:
    """Latest message of each session."""
    fields = ["id", "question", "answer", "timestamp"]
    latest = F.max_by(F.struct(*fields), F.struct(*order))
    return chat.groupBy("session").agg(latest.alias("m")).select("session", "m.*")


def message_counts(chat: DataFrame) -> DataFrame:
    """Messages per session."""
    return chat.groupBy("session").agg(F.count(F.lit(1)).alias("n_messages"))


def answer_sources(chat: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cited chunks of each answer, in citation order."""
    cited = chat.select(
        "session", F.col("id").alias("message_id"),
        F.posexplode("source_chunks").alias("ordinal", "chunk_id"),
    )
    return cited.join(chunks.withColumnRenamed("id", "chunk_id").drop("session"), "chunk_id")


def cited_ids(chat: DataFrame) -> DataFrame:
    """Every chunk id cited at least once."""
    return chat.select(F.explode("source_chunks").alias("id")).distinct()


def cited_chunks(chat: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks some answer refers to (J6, semi join)."""
    return chunks.join(cited_ids(chat), "id", "left_semi")


def uncited_chunks(chat: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks no answer refers to (J6, anti join)."""
    return chunks.join(cited_ids(chat), "id", "left_anti")


# -- sessions ----------------------------------------------------------------

def session_totals(chunks: DataFrame, chat: DataFrame) -> DataFrame:
    """Documents, chunks, messages and first and last activity per session (A1).

    Both tables are reduced to one row per session before they meet.
    """
    stored = chunks.groupBy("session").agg(
        F.countDistinct("source_file").alias("n_documents"),
        F.count(F.lit(1)).alias("total_chunks"),
    )
    talked = chat.groupBy("session").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.min("timestamp").alias("created_at"),
        F.max("timestamp").alias("last_modified"),
    )
    both = stored.unionByName(talked, allowMissingColumns=True)
    return both.groupBy("session").agg(
        F.coalesce(F.max("n_documents"), F.lit(0)).alias("n_documents"),
        F.coalesce(F.max("total_chunks"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.max("total_messages"), F.lit(0)).alias("total_messages"),
        F.min("created_at").alias("created_at"),
        F.max("last_modified").alias("last_modified"),
    )


def session_catalog(directories: DataFrame) -> DataFrame:
    """Session names of a directory listing."""
    return directories.withColumn("name", tx.session_name("directory"))


def latest_directory(directories: DataFrame) -> DataFrame:
    """Last directory by name of each session."""
    return session_catalog(directories).groupBy("name").agg(
        F.max("directory").alias("directory")
    )


def session_ids(requested: DataFrame, directories: DataFrame) -> DataFrame:
    """Id of each requested ``(name, created_at)``: the existing one or a new one."""
    existing = latest_directory(directories.filter(F.instr("directory", "_") > 0))
    return requested.join(existing, "name", "left").select(
        *requested.columns,
        F.coalesce(
            "directory", tx.new_session_id(F.col("name"), F.col("created_at"))
        ).alias("session_id"),
        F.col("directory").isNotNull().alias("existed"),
    )


def session_listing(sessions: DataFrame, active: str | None = None) -> DataFrame:
    """Sessions by name, the active one marked."""
    is_active = F.col("name").eqNullSafe(F.lit(active))
    return sessions.select(
        "name", is_active.alias("active"),
        F.concat("name", F.when(is_active, F.lit(" (active)")).otherwise(F.lit(""))).alias("label"),
    ).orderBy("name")


def retained_sessions(
    sessions: DataFrame, as_of: Column, config: SessionConfig = SessionConfig()
) -> DataFrame:
    """The most recent sessions that are not too old.

    A top-n by a limit on a sort, so each task keeps only ``max_sessions`` rows.
    """
    days = F.expr(f"INTERVAL '{config.max_session_age_days}' DAY")
    young = sessions.filter(F.col("last_modified") >= as_of - days)
    return young.orderBy(F.desc("last_modified"), "name").limit(config.max_sessions)


def ranked(df: DataFrame, group: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group (W5); Spark limits groups before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
