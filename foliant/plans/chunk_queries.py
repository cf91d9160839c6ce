"""Queries on chunks: spans, chunk tables, positions, sections (G, W, J3, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.config import MARKDOWN_SEPARATORS, ChunkingConfig
from foliant.functions import structure as st
from foliant.functions import text as tx
from foliant.operators import chunking, corpus
from foliant.operators.extraction import text_chunks
from foliant.plans import inputs as I
from foliant.plans import sql as S
from foliant.plans.registry import query
from foliant.plans.text_queries import BREAKS_SQL, SECTIONS_SQL

_SPANS_BODY = (
    "SELECT d.source_file, s AS span_start, e AS span_end, "
    "CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY s) - 1 AS INTEGER) AS span_index "
    "FROM pieces p JOIN docs d ON p.doc_id = d.doc_id"
)
_CHUNK_COLUMNS = (
    "id", "content", "source_file", "chunk_index", "start_position", "end_position", "token_count",
)
_CHUNK_BODY = f"SELECT {', '.join(_CHUNK_COLUMNS)} FROM chunks"
_SUMMARY_BODY = (
    "SELECT source_file, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars, "
    "sum(token_count)::BIGINT AS n_tokens, min(length(content))::INTEGER AS min_chars, "
    "max(length(content))::INTEGER AS max_chars, round(avg(length(content)), 6) AS avg_chars "
    "FROM chunks GROUP BY source_file"
)


def _cleaned(spark, sf_dir):
    return I.heavy_documents(spark, sf_dir).withColumn("content", tx.clean_text("content"))


@query("g1_chunk_spans", S.with_ctes(
    [f"docs AS ({S.PLAIN})", *S.spans(), S.pieces()], _SPANS_BODY
))
def g1_chunk_spans(spark, sf_dir):
    return chunking.spans_table(_cleaned(spark, sf_dir))


@query("g1_chunk_spans_markdown", S.with_ctes(
    [f"docs AS ({S.PLAIN})", *S.spans(MARKDOWN_SEPARATORS), S.pieces()], _SPANS_BODY
))
def g1_chunk_spans_markdown(spark, sf_dir):
    return chunking.spans_table(
        _cleaned(spark, sf_dir), ChunkingConfig(separators=MARKDOWN_SEPARATORS)
    )


#: Every byte of the UTF-8 text as the character of its number, so that SQL counts bytes.
_BYTES = (
    "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), "
    "lambda h: chr(('0x' || h)::INTEGER)), '') AS text FROM (" + S.PLAIN + ")"
)


@query("g1_chunk_spans_bytes", S.with_ctes(
    [f"paths AS ({S.documents()})", f"bytes AS ({_BYTES})",
     "docs AS (SELECT b.doc_id, p.source_file, b.text FROM bytes b JOIN paths p USING (doc_id))",
     *S.spans(size=400, overlap=90), S.pieces(400)], _SPANS_BODY
))
def g1_chunk_spans_bytes(spark, sf_dir):
    """Sizes and offsets in bytes, also where characters have several."""
    config = ChunkingConfig(chunk_size=400, chunk_overlap=90, unit="bytes")
    return chunking.spans_table(_cleaned(spark, sf_dir), config)


@query("g2_chunk_text", S.with_ctes(S.chunks(), _CHUNK_BODY))
def g2_chunk_text(spark, sf_dir):
    return I.plain_chunks(spark, sf_dir).select(*_CHUNK_COLUMNS)


@query("g2_chunk_text_small", S.with_ctes(S.chunks(size=300, overlap=60), _CHUNK_BODY))
def g2_chunk_text_small(spark, sf_dir):
    config = ChunkingConfig(chunk_size=300, chunk_overlap=60)
    return text_chunks(I.documents(spark, sf_dir), config).select(*_CHUNK_COLUMNS)


@query("g2_chunk_text_markdown", S.with_ctes(S.chunks(separators=MARKDOWN_SEPARATORS), _CHUNK_BODY))
def g2_chunk_text_markdown(spark, sf_dir):
    config = ChunkingConfig(separators=MARKDOWN_SEPARATORS)
    return text_chunks(I.documents(spark, sf_dir), config).select(*_CHUNK_COLUMNS)


@query("g2_chunk_text_routed", S.with_ctes(S.chunks(S.ROUTED), _CHUNK_BODY))
def g2_chunk_text_routed(spark, sf_dir):
    return I.routed_chunks(spark, sf_dir).select(*_CHUNK_COLUMNS)


@query("g3_drifting_positions", S.with_ctes([
    *S.chunks(),
    "texts AS (SELECT c.doc_id, c.chunk_index, c.content, c.start_position AS true_position, "
    "d.text FROM chunks c JOIN docs d ON c.doc_id = d.doc_id)",
    "walk AS (SELECT doc_id, -1 AS i, 0::BIGINT AS pos, 0::BIGINT AS found FROM docs UNION ALL "
    "SELECT doc_id, i, found + length(content) AS pos, found FROM ("
    "SELECT t.doc_id, t.chunk_index AS i, t.content, CASE WHEN instr(substr(t.text, s.pos + 1), "
    "t.content) > 0 THEN s.pos + instr(substr(t.text, s.pos + 1), t.content) - 1 ELSE s.pos END "
    "AS found FROM walk s JOIN texts t ON t.doc_id = s.doc_id AND t.chunk_index = s.i + 1))",
], (
    "SELECT d.source_file, c.chunk_index, c.content, c.start_position AS true_position, "
    "s.found AS start_position, s.found + length(c.content) AS end_position FROM walk s "
    "JOIN chunks c ON c.doc_id = s.doc_id AND c.chunk_index = s.i "
    "JOIN docs d ON d.doc_id = c.doc_id"
)))
def g3_drifting_positions(spark, sf_dir):
    return chunking.with_drifting_positions(_cleaned(spark, sf_dir))


@query("f3_drop_empty_chunks", S.with_ctes(S.chunks(), (
    "SELECT source_file, count(*) AS n_chunks, count(*) FILTER (WHERE content = '') AS n_empty "
    "FROM chunks GROUP BY source_file"
)))
def f3_drop_empty_chunks(spark, sf_dir):
    return I.plain_chunks(spark, sf_dir).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.col("content") == "").alias("n_empty"),
    )


@query("f4_stored_columns", S.with_ctes(S.chunks(), (
    "SELECT id, content, source_file, chunk_index, start_position, end_position FROM chunks"
)))
def f4_stored_columns(spark, sf_dir):
    return corpus.stored_columns(I.plain_chunks(spark, sf_dir))


@query("w1_chunk_index", S.with_ctes(S.chunks(), "SELECT source_file, id, chunk_index FROM chunks"))
def w1_chunk_index(spark, sf_dir):
    return I.plain_chunks(spark, sf_dir).select("source_file", "id", "chunk_index")


@query("w8_overlap_with_previous", S.with_ctes(
    S.chunks(), "SELECT id, overlap_previous FROM chunks"
))
def w8_overlap_with_previous(spark, sf_dir):
    return I.plain_chunks(spark, sf_dir).select("id", "overlap_previous")


@query("a2_chunk_summary", S.with_ctes(S.chunks(), _SUMMARY_BODY))
def a2_chunk_summary(spark, sf_dir):
    return chunking.chunk_summary(I.plain_chunks(spark, sf_dir))


_PAGED = S.paged_documents()


@query("j3_asof_section", S.with_ctes([
    *S.chunks(_PAGED), f"heads AS ({SECTIONS_SQL})",
], (
    "SELECT c.id, c.start_position, coalesce(h.found, 'Unknown') AS section FROM chunks c "
    "ASOF LEFT JOIN heads h ON c.doc_id = h.doc_id AND h.position <= c.start_position"
)))
def j3_asof_section(spark, sf_dir):
    docs = I.paged_documents(spark, sf_dir)
    chunks = chunking.chunk_documents(docs).select("id", "source_file", "start_position")
    heads = docs.select("source_file", F.inline(st.sections(F.col("content"))))
    return chunking.asof_sections(chunks, heads).select("id", "start_position", "section")


@query("j4_page_of_chunk", S.with_ctes([
    *S.chunks(_PAGED), f"breaks AS ({BREAKS_SQL})",
], (
    "SELECT c.id, 1 + count(b.position)::INTEGER AS page FROM chunks c LEFT JOIN breaks b "
    "ON c.doc_id = b.doc_id AND b.position <= c.start_position GROUP BY c.id"
)))
def j4_page_of_chunk(spark, sf_dir):
    return chunking.located_chunks(I.paged_documents(spark, sf_dir)).select("id", "page")


@query("t17_chunk_locator", S.with_ctes([
    *S.chunks(_PAGED), f"heads AS ({SECTIONS_SQL})", f"breaks AS ({BREAKS_SQL})",
    "pages AS (SELECT c.id, 1 + count(b.position) AS page FROM chunks c LEFT JOIN breaks b "
    "ON c.doc_id = b.doc_id AND b.position <= c.start_position GROUP BY c.id)",
    "named AS (SELECT c.id, coalesce(h.found, 'Unknown') AS section FROM chunks c "
    "ASOF LEFT JOIN heads h ON c.doc_id = h.doc_id AND h.position <= c.start_position)",
], (
    "SELECT id, concat('section:', section, ';page:', page) AS locator "
    "FROM named JOIN pages USING (id)"
)))
def t17_chunk_locator(spark, sf_dir):
    return chunking.located_chunks(I.paged_documents(spark, sf_dir)).select("id", "locator")
