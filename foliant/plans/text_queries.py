"""Queries on documents: scans, types, cleaning, ids, structure (S, T, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.config import SUPPORTED_TYPES, ChunkingConfig
from foliant.functions import structure as st
from foliant.functions import text as tx
from foliant.operators import corpus, extraction
from foliant.plans import inputs as I
from foliant.plans import sql as S
from foliant.plans.registry import query
from foliant.sources.readers import parse_chunk_input

_DOCS = f"docs AS ({S.documents()})"


@query("s1_document_scan", (
    f"SELECT source_file, strlen(text)::INTEGER AS size, {S.file_type('source_file')} AS file_type "
    f"FROM ({S.documents()})"
))
def s1_document_scan(spark, sf_dir):
    return I.documents(spark, sf_dir).select(
        "source_file", F.octet_length("content").alias("size"),
        tx.detect_file_type("source_file").alias("file_type"),
    )


@query("s2_size_limit", (
    "SELECT doc_id, strlen(text)::INTEGER AS size FROM documents WHERE strlen(text) <= 4096"
))
def s2_size_limit(spark, sf_dir):
    config = ChunkingConfig(max_file_size_mb=4096 / 1024 / 1024)
    docs = I.documents(spark, sf_dir).filter(
        extraction.within_size(F.octet_length("content"), config)
    )
    return docs.select("doc_id", F.octet_length("content").alias("size"))


@query("s3_type_routing", (
    f"SELECT doc_id, file_type, CASE WHEN file_type = 'pdf' THEN {S.clean_pdf('text')} "
    f"ELSE {S.clean_text('text')} END AS content FROM "
    f"(SELECT *, {S.file_type('source_file')} AS file_type FROM ({S.documents(I.NOISY_TEXT)}))"
))
def s3_type_routing(spark, sf_dir):
    docs = I.heavy_documents(spark, sf_dir, I.NOISY_TEXT).withColumn(
        "file_type", tx.detect_file_type("source_file")
    )
    return docs.select(
        "doc_id", "file_type",
        extraction.clean_by_type(F.col("file_type"), F.col("content")).alias("content"),
    )


@query("s3_kept_whitespace", (
    f"SELECT doc_id, CASE WHEN file_type = 'pdf' THEN {S.clean_pdf('text')} "
    "ELSE trim(text, concat(' ', chr(9), chr(10))) END AS content FROM "
    f"(SELECT *, {S.file_type('source_file')} AS file_type FROM ({S.documents(I.NOISY_TEXT)}))"
))
def s3_kept_whitespace(spark, sf_dir):
    """Plain text is only trimmed where blanks are to be kept."""
    docs = I.heavy_documents(spark, sf_dir, I.NOISY_TEXT).withColumn(
        "file_type", tx.detect_file_type("source_file")
    )
    config = ChunkingConfig(remove_extra_whitespace=False)
    return docs.select("doc_id", extraction.clean_by_type(
        F.col("file_type"), F.col("content"), config).alias("content"))


_LAYOUT = "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE text END"
_RAW = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('raw ', text) END"
_PAGE = "CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('page ', text) END"
_OCR = "CASE WHEN doc_id % 7 < 3 THEN '' ELSE concat('ocr ', text) END"


@query("s4_extraction_cascade", (
    f"WITH t AS (SELECT doc_id, source_file, nullif({_LAYOUT}, '') AS l, {_LAYOUT} IS NULL AS failed, "
    f"nullif({_RAW}, '') AS r, nullif({_PAGE}, '') AS p, nullif({_OCR}, '') AS o "
    f"FROM ({S.documents()})) "
    "SELECT doc_id, CASE WHEN failed THEN coalesce(r, p, o, missing) "
    "ELSE coalesce(l, o, missing) END AS content, "
    "CASE WHEN l IS NOT NULL THEN 'layout' WHEN failed AND r IS NOT NULL THEN 'raw' "
    "WHEN failed AND p IS NOT NULL THEN 'page' WHEN o IS NOT NULL THEN 'ocr' "
    "ELSE 'failed' END AS extraction_method FROM (SELECT *, concat('[PDF Document] ', source_file, "
    "' - Could not extract text. May be encrypted or image-only PDF.') AS missing FROM t)"
))
def s4_extraction_cascade(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(I.SOURCE_FILE).alias("source_file"),
        F.expr(_LAYOUT).alias("layout_text"), F.expr(_RAW).alias("raw_text"),
        F.expr(_PAGE).alias("page_text"), F.expr(_OCR).alias("ocr_text"),
    )
    return extraction.extract_text(docs).select("doc_id", "content", "extraction_method")


@query("s5_page_assembly", (
    "SELECT source_file, string_agg(concat(part, chr(10), chr(10), '--- Page ', page, ' ---', "
    "chr(10), chr(10)), '' ORDER BY page) AS content, count(*) AS n_pages FROM ("
    "SELECT source_file, i + 1 AS page, CASE WHEN i % 4 = 3 THEN '' "
    "ELSE substr(text, i * 500 + 1, 500) END AS part FROM ("
    "SELECT source_file, text, unnest(range(0, (length(text) - 1) // 500 + 1)) AS i "
    f"FROM ({S.documents()}))) WHERE part <> '' GROUP BY source_file"
))
def s5_page_assembly(spark, sf_dir):
    numbered = I.heavy_documents(spark, sf_dir).select(
        "source_file", "content",
        F.explode(F.sequence(
            F.lit(0), F.floor((F.length("content") - 1) / 500).cast("int")
        )).alias("i"),
    )
    pages = numbered.select(
        "source_file", (F.col("i") + 1).alias("page"),
        F.expr("CASE WHEN i % 4 = 3 THEN '' ELSE substr(content, i * 500 + 1, 500) END").alias("text"),
    )
    return extraction.assemble_pages(pages)


@query("s6_document_info", (
    "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(info, chr(10)), "
    "lambda l: regexp_matches(l, '^(Pages|Title|Author|Creator|Encrypted):')), "
    f"lambda l: concat(l, ' ')), '') AS summary FROM (SELECT doc_id, {I.PDF_INFO} AS info "
    "FROM documents)"
))
def s6_document_info(spark, sf_dir):
    info = I.table(spark, sf_dir, "documents").select("doc_id", F.expr(I.PDF_INFO).alias("info"))
    return info.select("doc_id", extraction.document_info(F.col("info")).alias("summary"))


@query("s7_page_count", (
    "SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(info, 'Pages:\\s*([0-9]+)', 1), '') "
    f"AS INTEGER), -1) AS pages FROM (SELECT doc_id, {I.PDF_INFO} AS info FROM documents)"
))
def s7_page_count(spark, sf_dir):
    info = I.table(spark, sf_dir, "documents").select("doc_id", F.expr(I.PDF_INFO).alias("info"))
    return info.select("doc_id", extraction.page_count(F.col("info")).alias("pages"))


@query("s11_session_catalog", S.with_ctes([S.DIRECTORIES], (
    "SELECT directory, regexp_replace(directory, '_[^_]*$', '') AS name FROM directories"
)))
def s11_session_catalog(spark, sf_dir):
    return corpus.session_catalog(I.session_directories(spark, sf_dir))


@query("s12_chunk_input", (
    "SELECT concat('c', doc_id) AS id, text AS content, CASE WHEN doc_id % 2 = 0 THEN lang "
    "ELSE '' END AS metadata FROM documents"
))
def s12_chunk_input(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    entry = F.struct(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("metadata"),
    )
    # NULL fields are left out by to_json, as a missing metadata is in the input.
    lists = docs.select(F.to_json(F.array(entry)).alias("value"))
    return parse_chunk_input(lists)


@query("t1_detect_file_type", (
    "SELECT path, " + S.file_type("path") + " AS file_type FROM (SELECT url AS path FROM pages "
    f"UNION ALL SELECT {I.SOURCE_FILE} FROM documents "
    "UNION ALL SELECT concat('./', source, '/file') FROM documents "
    "UNION ALL SELECT concat(source, '.tar.PDF') FROM documents "
    "UNION ALL SELECT source FROM documents)"
))
def t1_detect_file_type(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    paths = I.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    for expression in (
        I.SOURCE_FILE, "concat('./', source, '/file')", "concat(source, '.tar.PDF')", "source",
    ):
        paths = paths.unionAll(docs.select(F.expr(expression)))
    return paths.select("path", tx.detect_file_type("path").alias("file_type"))


@query("t2_clean_text", (
    f"SELECT doc_id, {S.clean_text('noisy')} AS content, "
    f"{S.clean_text('noisy')} <> noisy AS changed FROM "
    f"(SELECT doc_id, {I.NOISY_TEXT} AS noisy FROM documents)"
))
def t2_clean_text(spark, sf_dir):
    docs = I.heavy_documents(spark, sf_dir, I.NOISY_TEXT)
    cleaned = docs.withColumn("cleaned", tx.clean_text("content"))
    return cleaned.select(
        "doc_id", F.col("cleaned").alias("content"),
        (F.col("cleaned") != F.col("content")).alias("changed"),
    )


@query("t3_clean_pdf_text", (
    f"SELECT doc_id, {S.clean_pdf('noisy')} AS content, "
    f"{S.clean_pdf('noisy')} <> noisy AS changed FROM "
    f"(SELECT doc_id, {I.PDF_TEXT} AS noisy FROM documents)"
))
def t3_clean_pdf_text(spark, sf_dir):
    docs = I.heavy_documents(spark, sf_dir, I.PDF_TEXT)
    cleaned = docs.withColumn("cleaned", tx.clean_pdf_text("content"))
    return cleaned.select(
        "doc_id", F.col("cleaned").alias("content"),
        (F.col("cleaned") != F.col("content")).alias("changed"),
    )


_SHORT_PIECES = (
    "concat(CASE doc_id % 6 WHEN 0 THEN '. ' WHEN 1 THEN '  ) ' WHEN 2 THEN 'ary ' "
    "WHEN 3 THEN 'an ' WHEN 4 THEN chr(9) ELSE '' END, text, "
    "CASE doc_id % 4 WHEN 0 THEN ' (' WHEN 1 THEN ' [ ' WHEN 2 THEN '{' ELSE '' END)"
)
_CLEAN_CHUNK_SQL = S.with_ctes([
    f"pieces AS (SELECT doc_id, 0 AS s, {_SHORT_PIECES} AS c, false AS whole FROM documents)",
    S.cleaned_pieces(),
], "SELECT doc_id, content FROM cleaned")


@query("t4_clean_chunk", _CLEAN_CHUNK_SQL)
def t4_clean_chunk(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_SHORT_PIECES).alias("piece")
    )
    return docs.select("doc_id", tx.clean_chunk("piece").alias("content"))


@query("t5_estimate_tokens", "SELECT doc_id, strlen(text) // 4 AS token_count FROM documents")
def t5_estimate_tokens(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", tx.estimate_tokens("text").alias("token_count")
    )


@query("t6_chunk_id", (
    f"SELECT doc_id, concat('chunk_', md5(source_file), '_', doc_id % 7) AS id "
    f"FROM ({S.documents()})"
))
def t6_chunk_id(spark, sf_dir):
    return I.documents(spark, sf_dir).select(
        "doc_id", tx.chunk_id("source_file", F.col("doc_id") % 7).alias("id")
    )


@query("t7_file_metadata", (
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(',type:', file_type) "
    "ELSE concat('size:', strlen(text), ',modified:', 1704067200 + doc_id, ',type:', file_type) "
    f"END AS metadata FROM (SELECT *, {S.file_type('source_file')} AS file_type "
    f"FROM ({S.documents()}))"
))
def t7_file_metadata(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    known = F.col("doc_id") % 5 != 0
    return docs.select("doc_id", tx.file_metadata(
        F.when(known, F.octet_length("content")),
        F.when(known, F.col("doc_id") + 1704067200),
        tx.detect_file_type("source_file"),
    ).alias("metadata"))


@query("t8_prompt_prefix", (
    "SELECT item_id, concat('search_query: ', text) AS as_query, "
    "concat('search_document: ', text) AS as_document FROM benchmark"
))
def t8_prompt_prefix(spark, sf_dir):
    return I.table(spark, sf_dir, "benchmark").select(
        "item_id", tx.with_prompt("text", "query").alias("as_query"),
        tx.with_prompt("text", "document").alias("as_document"),
    )


_SENTENCE_CHARS = (
    "chars AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) AS i FROM "
    f"(SELECT doc_id, regexp_extract_all({I.SENTENCE_TEXT}, '(?s).') AS c FROM documents)), "
    "around AS (SELECT doc_id, i, ch, lag(ch) OVER p AS p1, lag(ch, 2) OVER p AS p2, "
    "lead(ch) OVER p AS nx FROM chars WINDOW p AS (PARTITION BY doc_id ORDER BY i)), "
    "ends AS (SELECT doc_id, i AS boundary FROM around WHERE ch IN ('.', '!', '?') "
    "AND nx IN (' ', chr(10), chr(9)) AND NOT (ch = '.' AND i >= 3 AND ("
    "concat(p2, p1) IN ('Dr', 'Mr', 'Ms', 'vs') OR regexp_matches(p1, '^[A-Z]$'))))"
)


@query("t9_sentence_boundaries", f"WITH {_SENTENCE_CHARS} SELECT doc_id, boundary FROM ends")
def t9_sentence_boundaries(spark, sf_dir):
    docs = I.heavy_documents(spark, sf_dir, I.SENTENCE_TEXT)
    return docs.select(
        "doc_id", F.explode(st.sentence_boundaries(F.col("content"))).alias("boundary")
    )


def _match_sql(docs: str, pattern: str, end: bool) -> str:
    """Match offsets from the lengths of the texts between the matches."""
    found = f"regexp_extract_all(text, '{pattern}')"
    gaps = f"string_split(regexp_replace(text, '{pattern}', chr(1), 'g'), chr(1))"
    upto = "k" if end else "k - 1"
    return (
        "SELECT doc_id, source_file, found[k] AS found, (list_sum(list_transform(gaps[1:k], "
        "lambda g: length(g))) + coalesce(list_sum(list_transform("
        f"found[1:{upto}], lambda g: length(g))), 0))::BIGINT AS position FROM ("
        "SELECT doc_id, source_file, found, gaps, unnest(range(1, len(found) + 1)) AS k FROM "
        f"(SELECT doc_id, source_file, {found} AS found, {gaps} AS gaps FROM ({docs})))"
    )


_BREAKS = r"\n\s*---\s*Page\s+\d+\s*---\s*\n"
_HEADINGS = r"(?m)^\s*\d+\.\s+[A-Z][^\n]{5,50}\s*$"
SECTIONS_SQL = _match_sql(S.paged_documents(), _HEADINGS, False)
BREAKS_SQL = _match_sql(S.paged_documents(), _BREAKS, False)


@query("t10_paragraph_boundaries", (
    f"SELECT doc_id, position AS boundary FROM ({_match_sql(S.paged_documents(), chr(92) + 'n' + chr(92) + 'n+', True)})"
))
def t10_paragraph_boundaries(spark, sf_dir):
    return I.paged_documents(spark, sf_dir).select(
        "doc_id", F.explode(st.paragraph_boundaries(F.col("content"))).alias("boundary")
    )


@query("t11_page_breaks", f"SELECT doc_id, position FROM ({BREAKS_SQL})")
def t11_page_breaks(spark, sf_dir):
    return I.paged_documents(spark, sf_dir).select(
        "doc_id", F.explode(st.page_breaks(F.col("content"))).alias("position")
    )


@query("t12_sections", (
    "SELECT doc_id, found AS title, trim(found, concat(' ', chr(10))) AS trimmed, "
    f"position AS start_position FROM ({SECTIONS_SQL})"
))
def t12_sections(spark, sf_dir):
    found = I.paged_documents(spark, sf_dir).select(
        "doc_id", F.inline(st.sections(F.col("content")))
    )
    return found.select(
        "doc_id", "title", F.btrim("title", F.lit(" \n")).alias("trimmed"), "start_position"
    )


@query("t13_optimal_chunk_end", (
    f"WITH {_SENTENCE_CHARS}, starts AS (SELECT doc_id, length({I.SENTENCE_TEXT}) AS n, "
    f"unnest([0, length({I.SENTENCE_TEXT}) // 3]) AS start FROM documents), "
    "near AS (SELECT s.doc_id, s.start, arg_min(boundary, "
    "abs(boundary - (start + 1000)) * 10000000 + boundary) AS best FROM starts s JOIN ends b "
    "ON s.doc_id = b.doc_id AND boundary > start AND boundary - start >= 500 "
    "AND boundary - start <= 1500 AND abs(boundary - (start + 1000)) < 1000 GROUP BY 1, 2) "
    "SELECT doc_id, start, CASE WHEN start + 1000 >= n THEN n "
    "ELSE coalesce(best, start + 1000) END AS chunk_end FROM starts LEFT JOIN near "
    "USING (doc_id, start)"
))
def t13_optimal_chunk_end(spark, sf_dir):
    docs = I.heavy_documents(spark, sf_dir, I.SENTENCE_TEXT).select(
        "doc_id", F.length("content").cast("bigint").alias("n"),
        st.sentence_boundaries(F.col("content")).alias("boundaries"),
    )
    starts = docs.withColumn("starts", F.array(F.lit(0).cast("bigint"), F.floor(F.col("n") / 3)))
    ends = st.optimal_chunk_ends(F.col("n"), F.col("starts"), F.col("boundaries"), 1000)
    both = starts.select("doc_id", F.explode(F.arrays_zip("starts", ends.alias("ends"))).alias("both"))
    return both.select(
        "doc_id", F.col("both.starts").alias("start"), F.col("both.ends").alias("chunk_end"))


@query("t15_format_timestamp", (
    f"SELECT event_id, {S.stamp('ts')} AS shown FROM events"
))
def t15_format_timestamp(spark, sf_dir):
    return I.table(spark, sf_dir, "events").select(
        "event_id", tx.format_timestamp("ts").alias("shown")
    )


@query("t16_message_id", (
    "SELECT event_id, concat('id_', epoch_us(ts) // 1000) AS id, "
    "concat('id_', epoch_us(ts) // 1000, '_', event_id) AS unique_id FROM events"
))
def t16_message_id(spark, sf_dir):
    return I.table(spark, sf_dir, "events").select(
        "event_id", tx.message_id(F.col("ts")).alias("id"),
        tx.message_id(F.col("ts"), F.col("event_id")).alias("unique_id"),
    )


@query("f1_not_empty", (
    "SELECT doc_id, length(t)::INTEGER AS n FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' "
    "WHEN 1 THEN '  ' ELSE text END AS t FROM documents) WHERE length(t) > 0"
))
def f1_not_empty(spark, sf_dir):
    docs = I.documents(
        spark, sf_dir, "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE text END"
    )
    return docs.filter(tx.not_empty("content")).select("doc_id", F.length("content").alias("n"))


@query("f2_minimum_length", (
    f"SELECT doc_id, file_type, strlen(text)::INTEGER AS n FROM ({S.ROUTED})"
))
def f2_minimum_length(spark, sf_dir):
    kept = extraction.cleaned_documents(I.heavy_documents(spark, sf_dir))
    return kept.select("doc_id", "file_type", F.octet_length("content").alias("n"))


@query("f7_supported_types", (
    f"SELECT doc_id, file_type FROM (SELECT doc_id, {S.file_type('source_file')} AS file_type "
    f"FROM ({S.documents()})) WHERE file_type IN {SUPPORTED_TYPES}"
))
def f7_supported_types(spark, sf_dir):
    docs = I.documents(spark, sf_dir).select(
        "doc_id", tx.detect_file_type("source_file").alias("file_type")
    )
    return docs.filter(extraction.supported(F.col("file_type")))
