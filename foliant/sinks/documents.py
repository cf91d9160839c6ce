"""Saved layouts as rows: JSON documents (K1–K3), text and markdown exports (K4, K5).

A session may hold most of a corpus, so no document collects a whole session.
JSON documents hold a bounded number of entries each and a session has as
many as it needs; exports are rows with sort keys, written in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.config import ExportConfig
from foliant.functions import text as tx
from foliant.operators.ordered import ROWS_PER_RANGE, with_position

ENTRIES_PER_DOCUMENT = 1000


def _entries(order: str, fields: list[Column]) -> Column:
    """Ordered list of structs of one group."""
    entry = F.struct(*fields).alias("entry")
    return F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), entry))),
        lambda e: e["entry"],
    )


def chunk_documents_json(chunks: DataFrame, entries: int = ENTRIES_PER_DOCUMENT) -> DataFrame:
    """``{"chunks": […]}`` documents, one or more per source file (K1)."""
    fields = [F.col(c) for c in (
        "id", "content", "source_file", "chunk_index", "start_position", "end_position",
    )]
    fields.append(
        F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding")
    )
    part = F.floor(F.col("chunk_index") / entries).cast("int").alias("part")
    grouped = chunks.groupBy("session", "source_file", part).agg(
        _entries("chunk_index", fields).alias("chunks"),
        F.count(F.lit(1)).alias("n_entries"),
    )
    return grouped.select(
        "session", "source_file", "part", "n_entries",
        F.to_json(F.struct("chunks")).alias("value"),
    )


def chat_documents_json(
    chat: DataFrame, order: str, entries: int = ENTRIES_PER_DOCUMENT, *,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``{"messages": […]}`` documents of a session's log, in order (K3)."""
    placed = with_position(chat, "session", order, rows_per_range=rows_per_range)
    fields = [
        F.col("id"), F.col("question"), F.col("answer"),
        tx.format_timestamp("timestamp").alias("timestamp"), F.col("source_chunks"),
    ]
    part = F.floor(F.col("position") / entries).cast("int").alias("part")
    grouped = placed.groupBy("session", part).agg(
        _entries("position", fields).alias("messages"),
        F.count(F.lit(1)).alias("n_entries"),
    )
    return grouped.select(
        "session", "part", "n_entries", F.to_json(F.struct("messages")).alias("value")
    )


def metadata_documents_json(
    sessions: DataFrame, documents: DataFrame, order: str,
    entries: int = ENTRIES_PER_DOCUMENT, *, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Session metadata with its ordered document list (K2).

    ``sessions`` has one row per session with name, description, times and
    totals; lists longer than ``entries`` are split over several documents.
    """
    placed = with_position(
        documents.select("session", "source_file", order), "session", order,
        rows_per_range=rows_per_range,
    )
    part = F.floor(F.col("position") / entries).cast("int").alias("part")
    lists = placed.groupBy("session", part).agg(
        _entries("position", [F.col("source_file")]).alias("listed")
    )
    joined = sessions.join(lists, "session", "left")
    body = F.struct(
        F.col("session").alias("name"),
        tx.format_timestamp("created_at").alias("created_at"),
        tx.format_timestamp("last_modified").alias("last_modified"),
        F.col("description"), F.col("total_chunks"), F.col("total_messages"),
        F.coalesce(
            F.transform("listed", lambda e: e["source_file"]), F.array().cast("array<string>")
        ).alias("documents"),
    )
    return joined.select(
        "session", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(body).alias("value")
    )


def _line(section: int, key: Column | int, place: int, text: Column) -> Column:
    key = F.lit(key) if isinstance(key, int) else key
    return F.struct(
        F.lit(section).alias("section"), key.cast("bigint").alias("key"),
        F.lit(place).alias("place"), text.alias("line"),
    )


def _lines(df: DataFrame, lines: list[Column]) -> DataFrame:
    """One row per line whose text is not NULL."""
    return df.select("session", F.inline(F.array(*lines))).filter(F.col("line").isNotNull())


def text_export(
    sessions: DataFrame, documents: DataFrame, chat: DataFrame, *,
    document_order: str, chat_order: str, config: ExportConfig = ExportConfig(),
) -> DataFrame:
    """Lines of the text export of each session, with their sort keys (K4, K8).

    Header, document list and question-and-answer blocks of the named
    session; sorted by (session, section, key, place) they are the file.
    """
    empty = F.lit("")
    head = [_line(0, 0, 0, F.lit("=== SESSION EXPORT ===")), _line(0, 0, 1, empty)]
    if config.include_metadata:
        described = F.length("description") > 0
        head += [
            _line(0, 0, 2, F.concat(F.lit("Session: "), F.col("session"))),
            _line(0, 0, 3, F.concat(F.lit("Created: "), tx.format_timestamp("created_at"))),
            _line(0, 0, 4, F.concat(
                F.lit("Last Modified: "), tx.format_timestamp("last_modified"))),
            _line(0, 0, 5, F.when(
                described, F.concat(F.lit("Description: "), F.col("description")))),
        ]
    parts = []
    if config.include_sources:
        head += [
            _line(0, 0, 6, empty),
            _line(0, 0, 7, F.concat(
                F.lit("Documents ("), F.col("n_documents").cast("string"), F.lit("):"))),
        ]
        parts.append(_lines(documents, [
            _line(1, F.col(document_order), 0, F.concat(F.lit("  - "), F.col("source_file"))),
        ]))
    head += [
        _line(2, 0, 0, empty),
        _line(2, 0, 1, F.concat(
            F.lit("Chat History ("), F.col("total_messages").cast("string"),
            F.lit(" messages):"))),
        _line(2, 0, 2, empty),
    ]
    block = [
        _line(3, F.col(chat_order), 0, F.concat(F.lit("Q: "), F.col("question"))),
        _line(3, F.col(chat_order), 1, F.concat(F.lit("A: "), F.col("answer"))),
    ]
    if config.include_timestamps:
        block.append(_line(3, F.col(chat_order), 2, F.concat(
            F.lit("   ["), tx.format_timestamp("timestamp"), F.lit("]"))))
    block.append(_line(3, F.col(chat_order), 3, empty))
    exported = _lines(sessions, head).unionByName(_lines(chat, block))
    for part in parts:
        exported = exported.unionByName(part)
    return exported


def markdown_export(chat: DataFrame, *, chat_order: str,
                    config: ExportConfig = ExportConfig()) -> DataFrame:
    """Markdown lines of each session's log, with their sort keys (K5)."""
    block = [
        _line(0, F.col(chat_order), 0, F.concat(F.lit("## "), F.col("question"))),
        _line(0, F.col(chat_order), 1, F.lit("")),
        _line(0, F.col(chat_order), 2, F.col("answer")),
        _line(0, F.col(chat_order), 3, F.lit("")),
    ]
    if config.include_timestamps:
        block.append(_line(0, F.col(chat_order), 4, F.concat(
            F.lit("*"), tx.format_timestamp("timestamp"), F.lit("*"))))
        block.append(_line(0, F.col(chat_order), 5, F.lit("")))
    return _lines(chat, block)


def flat_export(chat: DataFrame, config: ExportConfig = ExportConfig()) -> DataFrame:
    """Rows for the csv and json exports, with the optional columns (K5, K8)."""
    columns = ["session", "id", "question", "answer"]
    out = chat.withColumns({
        "asked_at": tx.format_timestamp("timestamp"),
        "sources": F.array_join("source_chunks", ";"),
    })
    if config.include_timestamps:
        columns.append("asked_at")
    if config.include_sources:
        columns.append("sources")
    return out.select(*columns)
