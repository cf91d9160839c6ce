"""Chunk tables: spans, chunk cleaning, numbering, per-document summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.config import ChunkingConfig
from foliant.functions import text as tx
from foliant.functions import structure as st
from foliant.functions.spans import chunk_spans, drifting_positions
from foliant.runtime import small_batches, spread


def clean_pieces(pieces: Column, unit: str = "chars") -> Column:
    """Chunk cleaning over a span array; offsets follow what is cut off (T4).

    One pass per rule, which first moves the offset by what the rule before
    cut.  Blanks, marks and brackets are single bytes, so byte lengths, which
    cost nothing, give the number of characters cut.
    """
    size = F.octet_length if unit == "bytes" else F.length

    def state(start: Column, end: Column, old: Column, new: Column) -> Column:
        return F.struct(
            start.alias("start"), end.alias("end"), old.alias("old"), new.alias("new")
        )

    def cut(p: Column) -> Column:
        return F.octet_length(p["old"]) - F.octet_length(p["new"])

    def after_front(rule):
        return lambda p: state(p["start"] + cut(p), p["end"], p["new"], rule(p["new"]))

    def after_back(rule):
        return lambda p: state(p["start"], p["end"] - cut(p), p["new"], rule(p["new"]))

    pieces = F.transform(pieces, lambda p: state(
        p["start"], p["end"], p["content"], tx.trim_front(p["content"])
    ))
    pieces = F.transform(pieces, after_front(tx.trim_back))
    pieces = F.transform(pieces, after_back(tx.drop_leading_punctuation))
    pieces = F.transform(pieces, after_front(tx.drop_trailing_bracket))
    pieces = F.transform(pieces, lambda p: F.struct(
        p["start"].alias("start"), (p["end"] - cut(p)).alias("end"), p["new"].alias("text"),
        tx.first_fragment(p["new"]).alias("word"),
    ))
    return F.transform(pieces, lambda p: F.struct(
        (p["start"] + F.when(p["word"] != "", size(p["word"]) + 1).otherwise(F.lit(0))).alias(
            "start"),
        p["end"].alias("end"),
        tx.drop_fragment(p["text"], p["word"]).alias("content"),
    ))


def chunk_array(
    text: Column, config: ChunkingConfig = ChunkingConfig(), whole: Column | None = None
) -> Column:
    """Final chunks of one text as an array, empty ones dropped.

    A text that fits into one chunk stays as it is, even if it is empty.
    Texts flagged ``whole`` are never split.
    """
    size = F.octet_length if config.unit == "bytes" else F.length
    spans = chunk_spans(text, config)
    chunks = F.when(size(text) <= config.chunk_size, spans).otherwise(
        F.filter(clean_pieces(spans, config.unit), lambda p: p["content"] != "")
    )
    if whole is not None:
        one = F.array(F.struct(
            F.lit(0).cast("bigint").alias("start"),
            size(text).cast("bigint").alias("end"),
            text.alias("content"),
        ))
        chunks = F.when(whole, one).otherwise(chunks)
    if config.drop_empty:
        chunks = F.filter(chunks, lambda p: F.btrim(p["content"], F.lit(" \t\n\r")) != "")
    return chunks


def chunk_documents(
    documents: DataFrame,
    config: ChunkingConfig = ChunkingConfig(),
    *,
    text: str = "content",
    keep: tuple[str, ...] = (),
    whole: str | None = None,
    describe: Callable[[Column], dict[str, Column]] | None = None,
) -> DataFrame:
    """One row per chunk of documents with ``source_file`` and a text column.

    Row-local: spans, cleaning, numbering (W1) and the overlap with the chunk
    before (W8) come out of one array per document, without a shuffle.
    ``describe`` maps the array of chunks to arrays with a value for each of them, and may
    use columns of the document, which are then not repeated for every chunk.
    """
    small_batches(documents.sparkSession)
    kept = [c for c in keep if c != "source_file"]
    used = [c for c in documents.columns if c not in ("source_file", text)]
    if describe is None:
        used = [c for c in used if c in kept or c == whole]
    arrays = spread(documents.select("source_file", text, *used), "source_file").select(
        "source_file", *used,
        chunk_array(F.col(text), config, F.col(whole) if whole else None).alias("_chunks"),
    )
    more = describe(F.col("_chunks")) if describe else {}
    described = list(more)
    arrays = arrays.select("*", *[column.alias(f"_{name}") for name, column in more.items()])

    def finish(c: Column, i: Column) -> Column:
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["content"].alias("content"),
            F.when(i > 0, F.get(F.col("_chunks"), i - 1)["end"] - c["start"]).alias("overlap"),
            *[F.get(F.col(f"_{name}"), i).alias(name) for name in described],
        )

    with_overlap = F.transform(F.col("_chunks"), finish)
    rows = arrays.select(
        "source_file", *kept, F.posexplode(with_overlap).alias("chunk_index", "_chunk")
    )
    return rows.select(
        tx.chunk_id(F.col("source_file"), F.col("chunk_index")).alias("id"),
        F.col("_chunk.content").alias("content"),
        "source_file",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("_chunk.start").alias("start_position"),
        F.col("_chunk.end").alias("end_position"),
        tx.estimate_tokens(F.col("_chunk.content")).alias("token_count"),
        F.col("_chunk.overlap").alias("overlap_previous"),
        *[F.col(f"_chunk.{name}").alias(name) for name in described],
        *kept,
    )


def spans_table(
    documents: DataFrame, config: ChunkingConfig = ChunkingConfig(), *, text: str = "content"
) -> DataFrame:
    """Raw spans, before chunk cleaning (G1)."""
    small_batches(documents.sparkSession)
    spans = spread(documents.select("source_file", text), "source_file").select(
        "source_file", chunk_spans(text, config).alias("_spans")
    )
    return spans.select("source_file", F.posexplode("_spans").alias("span_index", "_span")).select(
        "source_file", "span_index",
        F.col("_span.start").alias("span_start"), F.col("_span.end").alias("span_end"),
    )


def with_drifting_positions(
    documents: DataFrame, config: ChunkingConfig = ChunkingConfig(), *, text: str = "content"
) -> DataFrame:
    """Chunks with the positions a forward search from the last chunk's end finds."""
    small_batches(documents.sparkSession)
    arrays = spread(documents.select("source_file", text), "source_file").select(
        "source_file", text, chunk_array(F.col(text), config).alias("_chunks")
    )
    contents = F.transform("_chunks", lambda c: c["content"])
    found = arrays.select(
        "source_file", F.col("_chunks"), drifting_positions(F.col(text), contents).alias("_found")
    )
    rows = found.select(
        "source_file", F.posexplode(F.arrays_zip("_chunks", "_found")).alias("chunk_index", "_row")
    )
    return rows.select(
        "source_file", "chunk_index",
        F.col("_row._chunks.content").alias("content"),
        F.col("_row._chunks.start").alias("true_position"),
        F.col("_row._found").alias("start_position"),
        (F.col("_row._found") + F.length("_row._chunks.content")).alias("end_position"),
    )


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Chunks, characters and tokens per source file (A2)."""
    length = F.length("content")
    return chunks.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(length).alias("n_chars"),
        F.sum("token_count").alias("n_tokens"),
        F.min(length).alias("min_chars"),
        F.max(length).alias("max_chars"),
        F.round(F.avg(length), 6).alias("avg_chars"),
    )


def located_chunks(
    documents: DataFrame, config: ChunkingConfig = ChunkingConfig(), *, text: str = "content"
) -> DataFrame:
    """Chunks with the section and page they start in and their locator.

    Row-local, in time linear in the document: each chunk start is searched in the
    ascending marks.
    """
    marked = spread(documents.select("source_file", text), "source_file").select(
        "source_file", text,
        st.sections(F.col(text)).alias("_sections"), st.page_breaks(F.col(text)).alias("_breaks"),
    )
    def located(chunks: Column) -> dict[str, Column]:
        starts = F.transform(chunks, lambda c: c["start"])
        return {"section": st.sections_at(F.col("_sections"), starts),
                "page": st.pages_at(F.col("_breaks"), starts)}

    chunks = chunk_documents(marked, config, text=text, describe=located)
    return chunks.withColumn("locator", st.locator(F.col("section"), F.col("page")))


def asof_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """As-of join of stored chunks and stored section starts of the same files.

    ``sections`` has ``(source_file, start_position, title)``.  A window runs
    over one file, whose size is limited.
    """
    marks = sections.select(
        "source_file", F.col("start_position").alias("_at"), F.lit(0).alias("_kind"), "title",
    )
    both = marks.unionByName(
        chunks.withColumns({"_at": F.col("start_position"), "_kind": F.lit(1)}),
        allowMissingColumns=True,
    )
    before = Window.partitionBy("source_file").orderBy("_at", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = both.withColumn("section", F.last("title", ignorenulls=True).over(before))
    return found.filter(F.col("_kind") == 1).select(
        *chunks.columns, F.coalesce("section", F.lit("Unknown")).alias("section")
    )
