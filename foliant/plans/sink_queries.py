"""Queries on sinks and streams: round trips, exports, incremental ingest (K, S, ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.config import ChunkingConfig, ExportConfig, IngestConfig, RetrievalConfig
from foliant.functions import text as tx
from foliant.functions.embedding import HashedWords, embed
from foliant.operators.session_index import index_cells, index_top_k, session_index
from foliant.plans import inputs as I
from foliant.plans import sql as S
from foliant.plans.registry import query
from foliant.runtime import fresh_path, written
from foliant.sinks import documents as docs
from foliant.sinks import writers
from foliant.sources import readers
from foliant.streaming import ingest

_CHUNKS_SQL = S.with_ctes([*S.chunks(), *S.embedded("v", "chunks", "id", "content")], (
    "SELECT session, id, content, source_file, chunk_index, start_position, end_position, "
    "(SELECT sum(round(weight::DOUBLE * 1000000)) FROM v WHERE v.id = chunks.id)::BIGINT AS weight "
    "FROM chunks"
))


def _with_weight(chunks):
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint"))
    weight = F.aggregate(scaled, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return chunks.select(
        "session", "id", "content", "source_file",
        "chunk_index", "start_position", "end_position",
        F.when(F.exists(scaled, lambda x: x != 0), weight).alias("weight"),
    )


@query("k1_chunk_documents", _CHUNKS_SQL)
def k1_chunk_documents(spark, sf_dir):
    """Saved chunk documents, read back."""
    path = fresh_path(spark, "chunk-documents")
    writers.write_documents(docs.chunk_documents_json(I.embedded_chunks(spark, sf_dir)), path)
    return _with_weight(readers.read_chunk_documents(spark, path))


@query("s8_chunk_scan", S.with_ctes(S.chunks(), (
    "SELECT source_file, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars, "
    "count(*) FILTER (WHERE strlen(content) > 0) AS n_filled FROM chunks GROUP BY source_file"
)))
def s8_chunk_scan(spark, sf_dir):
    """Scan of chunk documents without embeddings."""
    path = fresh_path(spark, "chunk-scan")
    chunks = I.plain_chunks(spark, sf_dir).withColumn(
        "embedding", F.lit(None).cast("array<float>")
    )
    writers.write_documents(docs.chunk_documents_json(chunks), path)
    return readers.read_chunk_documents(spark, path).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"),
        F.count_if(F.length("content") > 0).alias("n_filled"),
    )


@query("s9_chat_scan", S.with_ctes(S.CHAT, (
    "SELECT session, count(*) AS n_messages, sum(len(source_chunks))::BIGINT AS n_sources, "
    f"min({S.CHAT_TIME}) AS first_asked FROM chat GROUP BY session"
)))
def s9_chat_scan(spark, sf_dir):
    """Scan of chat documents of at most ten messages each."""
    path = fresh_path(spark, "chat-scan")
    writers.write_documents(docs.chat_documents_json(I.chat(spark, sf_dir), "seq", 10), path)
    return readers.read_chat_documents(spark, path).groupBy("session").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.size("source_chunks")).alias("n_sources"),
        tx.format_timestamp(F.min("timestamp")).alias("first_asked"),
    )


@query("s10_metadata_scan", S.with_ctes([*S.chunks(S.ROUTED), *S.CHAT, *S.SESSIONS], (
    "SELECT session AS name, total_chunks, total_messages, description, "
    "(SELECT count(*) FROM paths p WHERE p.session = sessions.session) AS n_listed FROM sessions"
)))
def s10_metadata_scan(spark, sf_dir):
    """Scan of metadata documents whose document lists come in parts of ten."""
    path = fresh_path(spark, "metadata-scan")
    listed = I.documents(spark, sf_dir).select("session", "source_file", "doc_id")
    writers.write_documents(
        docs.metadata_documents_json(I.sessions(spark, sf_dir), listed, "doc_id", 10), path
    )
    return readers.read_metadata_documents(spark, path).groupBy(
        "name", "total_chunks", "total_messages", "description"
    ).agg(F.sum(F.size("documents")).alias("n_listed"))


_POLICY = (
    ("document_add", "metadata"), ("document_add", "chunks"), ("manual_save", "metadata"),
    ("manual_save", "chat"), ("manual_save", "chunks"), ("manual_save", "index"),
    ("close", "metadata"), ("close", "chat"), ("close", "chunks"), ("close", "index"),
)


@query("k7_save_policy", S.with_ctes([*S.chunks(S.ROUTED), *S.CHAT, *S.SESSIONS], (
    "SELECT operation, name, CASE name WHEN 'metadata' THEN (SELECT count(*) FROM sessions) "
    "WHEN 'chat' THEN (SELECT count(*) FROM chat) ELSE (SELECT count(*) FROM chunks) END AS n_rows "
    "FROM (VALUES " + ", ".join(str(p) for p in _POLICY) + ") AS t(operation, name)"
)))
def k7_save_policy(spark, sf_dir):
    """Operations one after another in one folder; the tables each writes, with their rows at the end."""
    chunks = written(I.routed_chunks(spark, sf_dir).withColumn(
        "embedding", embed("content", HashedWords(I.EMBED_DIM))), "saved-chunks")
    # Saved several times each, so they are worked out once.
    tables = {
        "metadata": written(I.sessions(spark, sf_dir), "saved-metadata"),
        "chat": written(I.chat(spark, sf_dir), "saved-chat"),
        "chunks": chunks, "index": written(session_index(chunks), "saved-index"),
    }
    root, counts = fresh_path(spark, "saved"), None
    pairs = [
        (operation, name)
        for operation in ("document_add", "document_add", "chat_message", "manual_save", "close")
        for name in writers.save(operation, tables, root)
    ]
    for operation, name in sorted(set(pairs)):
        one = writers.read_table(spark, root, name).agg(F.count(F.lit(1)).alias("n_rows"))
        one = one.select(F.lit(operation).alias("operation"), F.lit(name).alias("name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


_CELLS_PER_SESSION = 4
_SESSION_VECTORS = [
    *S.chunks(), *S.embedded("v", "chunks", "id", "content"),
    "centres AS (SELECT session, id AS centre, row_number() OVER (PARTITION BY session "
    "ORDER BY md5(id), id) - 1 AS cell FROM chunks QUALIFY row_number() OVER "
    f"(PARTITION BY session ORDER BY md5(id), id) <= {_CELLS_PER_SESSION})",
    "norms AS (SELECT id, sum(weight::DOUBLE * weight::DOUBLE) AS square FROM v GROUP BY id)",
    "products AS (SELECT c.session, c.id, t.centre, t.cell, coalesce((SELECT "
    "sum(a.weight::DOUBLE * b.weight::DOUBLE) FROM v a JOIN v b ON a.bucket = b.bucket "
    "WHERE a.id = c.id AND b.id = t.centre), 0) AS score FROM chunks c JOIN centres t USING (session))",
    "nearest AS (SELECT session, id, coalesce(max(cell) FILTER (id = centre), "
    "arg_min(cell, -round(score, 6) * 1000000 * 1000 + cell)) AS cell FROM products GROUP BY 1, 2)",
]


def _session_chunks(spark, sf_dir):
    return written(
        I.embedded_chunks(spark, sf_dir).select("session", "id", "embedding"), "session-chunks")


@query("k7_session_index", S.with_ctes(_SESSION_VECTORS, (
    "SELECT n.session, n.cell::INTEGER AS cell, count(*) AS n, "
    "round(max(sqrt(greatest(0, coalesce(x.square, 0) + coalesce(y.square, 0) - 2 * p.score))), 4) "
    "AS radius FROM nearest n JOIN products p ON p.id = n.id AND p.session = n.session "
    "AND p.cell = n.cell LEFT JOIN norms x ON x.id = n.id LEFT JOIN norms y ON y.id = p.centre "
    "GROUP BY 1, 2"
)))
def k7_session_index(spark, sf_dir):
    """The saved vector index of each session: its cells with rows and radius."""
    root = fresh_path(spark, "saved-index")
    index = session_index(
        _session_chunks(spark, sf_dir), RetrievalConfig(nlist=_CELLS_PER_SESSION))
    writers.save("close", {"index": index}, root, only=("index",))
    return index_cells(writers.read_table(spark, root, "index")).select(
        "session", "cell", "n", F.round("radius", 4).alias("radius"))


@query("k7_index_search", S.with_ctes([
    *S.chunks(), *S.embedded("v", "chunks", "id", "content"),
    *S.embedded("q", "benchmark", "item_id", "text"),
    "scores AS (SELECT i.item_id AS query_id, c.id, round(coalesce((SELECT "
    "sum(a.weight::DOUBLE * b.weight::DOUBLE) FROM q a JOIN v b ON a.bucket = b.bucket "
    "WHERE a.item_id = i.item_id AND b.id = c.id), 0), 6) AS score FROM benchmark i "
    "JOIN chunks c ON c.session = concat('src', i.item_id % 20))",
], (
    "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"
    "::INTEGER AS rank FROM scores QUALIFY row_number() OVER "
    "(PARTITION BY query_id ORDER BY score DESC, id) <= 5"
)))
def k7_index_search(spark, sf_dir):
    """Best chunks of each question's session, from the saved index alone."""
    root = fresh_path(spark, "saved-index")
    index = session_index(_session_chunks(spark, sf_dir), RetrievalConfig(nlist=16))
    writers.save("close", {"index": index}, root, only=("index",))
    asked = I.questions(spark, sf_dir).withColumn(
        "session", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return index_top_k(
        asked, writers.read_table(spark, root, "index"), config=RetrievalConfig(nprobe=2))


@query("u2_delete_and_recreate", (
    "SELECT source AS session, count(*) AS n_documents FROM documents WHERE source <> 'src3' "
    "AND (source <> 'src7' OR doc_id % 2 = 0) GROUP BY source"
))
def u2_delete_and_recreate(spark, sf_dir):
    """Two sessions are deleted, one of them is saved anew with half of its documents."""
    root = fresh_path(spark, "recreated")
    listed = I.documents(spark, sf_dir).select("session", "source_file", "doc_id")
    writers.save("document_add", {"chunks": listed}, root, only=("chunks",))
    for session in ("src3", "src7"):
        writers.delete_session(spark, root, session)
    half = listed.filter("session = 'src7' AND doc_id % 2 = 0")
    writers.save("document_add", {"chunks": half}, root, only=("chunks",))
    return writers.read_table(spark, root, "chunks").groupBy("session").agg(
        F.count(F.lit(1)).alias("n_documents"))


@query("u2_vacuum", (
    "SELECT session, count(*) AS n_before, count(*) AS n_after, count(*) AS n_stored FROM ("
    "SELECT source AS session FROM documents WHERE source <> 'src3' "
    "AND (source <> 'src7' OR doc_id % 2 = 0)) GROUP BY session"
))
def u2_vacuum(spark, sf_dir):
    """Rows read before and after the files of deleted sessions go, and the rows still stored."""
    root = fresh_path(spark, "vacuumed")
    listed = I.documents(spark, sf_dir).select("session", "source_file", "doc_id")
    writers.save("document_add", {"chunks": listed}, root, only=("chunks",))
    for session in ("src3", "src7"):
        writers.delete_session(spark, root, session)
    half = listed.filter("session = 'src7' AND doc_id % 2 = 0")
    writers.save("document_add", {"chunks": half}, root, only=("chunks",))

    def counted(rows, name):
        return rows.groupBy("session").agg(F.count(F.lit(1)).alias(name))

    before = written(counted(writers.read_table(spark, root, "chunks"), "n_before"), "before")
    writers.vacuum(spark, root, 0)
    after = counted(writers.read_table(spark, root, "chunks"), "n_after")
    stored = counted(writers.read_sessions(spark, f"{root}/chunks"), "n_stored")
    return before.join(after, "session", "full").join(stored, "session", "full")


@query("k6_chunk_table", _CHUNKS_SQL)
def k6_chunk_table(spark, sf_dir):
    """The columnar table, written and read back."""
    path = fresh_path(spark, "chunk-table")
    writers.write_table(I.embedded_chunks(spark, sf_dir), path)
    return _with_weight(writers.read_sessions(spark, path))


_LISTED = 10


@query("k2_metadata_documents", S.with_ctes([*S.chunks(S.ROUTED), *S.CHAT, *S.SESSIONS], (
    f"SELECT session, session AS name, {S.stamp('created_at')} AS created_at, "
    f"{S.stamp('last_modified')} AS last_modified, description, total_chunks, total_messages, "
    "coalesce(documents, '') AS documents FROM sessions LEFT JOIN ("
    "SELECT session AS listed, string_agg(source_file, ',' ORDER BY doc_id) AS documents FROM ("
    "SELECT *, (row_number() OVER (PARTITION BY session ORDER BY doc_id) - 1) "
    f"// {_LISTED} AS part FROM paths) GROUP BY session, part) ON listed = session"
)))
def k2_metadata_documents(spark, sf_dir):
    """Saved session metadata, read back (K2, S10), with lists in parts of bounded length."""
    path = fresh_path(spark, "metadata-documents")
    listed = I.documents(spark, sf_dir).select("session", "source_file", "doc_id")
    writers.write_documents(
        docs.metadata_documents_json(I.sessions(spark, sf_dir), listed, "doc_id", _LISTED), path
    )
    saved = readers.read_metadata_documents(spark, path)
    return saved.withColumn("documents", F.array_join("documents", ","))


@query("k3_chat_documents", S.with_ctes(S.CHAT, (
    f"SELECT session, id, question, answer, {S.CHAT_TIME} AS asked_at, "
    "array_to_string(source_chunks, ';') AS sources FROM chat"
)))
def k3_chat_documents(spark, sf_dir):
    """Saved chat logs, read back."""
    path = fresh_path(spark, "chat-documents")
    writers.write_documents(docs.chat_documents_json(I.chat(spark, sf_dir), "seq"), path)
    saved = readers.read_chat_documents(spark, path)
    return saved.select(
        "session", "id", "question", "answer",
        tx.format_timestamp("timestamp").alias("asked_at"),
        F.array_join("source_chunks", ";").alias("sources"),
    )


_SECTION_HEAD = (
    "SELECT session, unnest([{{'section': 0, 'place': 0, 'line': '=== SESSION EXPORT ==='}}, "
    "{{'section': 0, 'place': 1, 'line': ''}}, "
    "{{'section': 0, 'place': 2, 'line': concat('Session: ', session)}}, "
    "{{'section': 0, 'place': 3, 'line': 'Created: ' || {created}}}, "
    "{{'section': 0, 'place': 4, 'line': 'Last Modified: ' || {modified}}}, "
    "{{'section': 0, 'place': 5, 'line': CASE WHEN description <> '' "
    "THEN concat('Description: ', description) END}}, "
    "{{'section': 0, 'place': 6, 'line': ''}}, "
    "{{'section': 0, 'place': 7, 'line': concat('Documents (', n_documents, '):')}}, "
    "{{'section': 2, 'place': 0, 'line': ''}}, "
    "{{'section': 2, 'place': 1, 'line': concat('Chat History (', total_messages, ' messages):')}}, "
    "{{'section': 2, 'place': 2, 'line': ''}}]) AS l FROM sessions"
).format(created=S.stamp("created_at"), modified=S.stamp("last_modified"))
_EXPORT_CTES = [
    *S.chunks(S.ROUTED), *S.CHAT, *S.SESSIONS, f"head AS ({_SECTION_HEAD})",
    "talk AS (SELECT session, seq, unnest([{'place': 0, 'line': concat('Q: ', question)}, "
    "{'place': 1, 'line': concat('A: ', answer)}, "
    "{'place': 2, 'line': concat('   [', " + S.CHAT_TIME + ", ']')}, "
    "{'place': 3, 'line': ''}]) AS l FROM chat)",
    "lines AS (SELECT session, l.section::INTEGER AS section, 0::BIGINT AS key, "
    "l.place::INTEGER AS place, l.line AS line FROM head WHERE l.line IS NOT NULL UNION ALL "
    "SELECT session, 1, doc_id, 0, concat('  - ', source_file) FROM paths UNION ALL "
    "SELECT session, 3, seq, l.place, l.line FROM talk)",
]


@query("k4_text_export", S.with_ctes(
    _EXPORT_CTES, "SELECT session, section, key, place, line FROM lines"
))
def k4_text_export(spark, sf_dir):
    return docs.text_export(
        I.sessions(spark, sf_dir), I.documents(spark, sf_dir), I.chat(spark, sf_dir),
        document_order="doc_id", chat_order="seq",
    )


@query("k4_written_export", S.with_ctes(
    _EXPORT_CTES, "SELECT session, line, count(*) AS n FROM (SELECT session, unnest("
    "string_split(line, chr(10))) AS line FROM lines) GROUP BY session, line"
))
def k4_written_export(spark, sf_dir):
    """The lines of the written text export by session, read back from its files."""
    path = fresh_path(spark, "text-export")
    writers.write_export(docs.text_export(
        I.sessions(spark, sf_dir), I.documents(spark, sf_dir), I.chat(spark, sf_dir),
        document_order="doc_id", chat_order="seq",
    ), path)
    saved = spark.read.schema("value string, session string").option("lineSep", "\n").text(path)
    return saved.groupBy("session", F.col("value").alias("line")).agg(
        F.count(F.lit(1)).alias("n"))


@query("s1_document_files", (
    "SELECT doc_id, strlen(text) + 1 AS size, 'txt' AS file_type, md5(concat(text, chr(10))) AS md5 "
    "FROM documents WHERE strlen(text) + 1 <= 4096"
))
def s1_document_files(spark, sf_dir):
    """Documents as files of a folder, read with the size limit pushed into the scan."""
    path = fresh_path(spark, "document-files")
    writers.write_files(I.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("value")), path, "doc_id")
    config = ChunkingConfig(max_file_size_mb=4096 / 1024 / 1024)
    return readers.read_documents(spark, path, config).select(
        F.regexp_extract("source_file", "doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id"),
        "size", "file_type", F.md5("content").alias("md5"),
    )


@query("k5_markdown_export", S.with_ctes(S.CHAT, (
    "SELECT session, 0 AS section, seq AS key, l.place::INTEGER AS place, l.line AS line FROM "
    "(SELECT session, seq, unnest([{'place': 0, 'line': concat('## ', question)}, "
    "{'place': 1, 'line': ''}, {'place': 2, 'line': answer}, {'place': 3, 'line': ''}, "
    "{'place': 4, 'line': concat('*', " + S.CHAT_TIME + ", '*')}, {'place': 5, 'line': ''}]) AS l "
    "FROM chat)"
)))
def k5_markdown_export(spark, sf_dir):
    return docs.markdown_export(I.chat(spark, sf_dir), chat_order="seq")


_FLAT_SQL = S.with_ctes(S.CHAT, (
    f"SELECT session, id, question, answer, {S.CHAT_TIME} AS asked_at, "
    "array_to_string(source_chunks, ';') AS sources FROM chat"
))


@query("k5_csv_export", _FLAT_SQL)
def k5_csv_export(spark, sf_dir):
    """The csv export, read back; answers span lines and hold quotes."""
    path = fresh_path(spark, "csv-export")
    rows = docs.flat_export(I.chat(spark, sf_dir))
    writers.write_rows(rows, path, "csv")
    saved = spark.read.schema(rows.schema).csv(path, header=True, multiLine=True, escape='"', quote='"')
    return saved.select(*rows.columns)


@query("k5_json_export", _FLAT_SQL)
def k5_json_export(spark, sf_dir):
    """The json export, read back."""
    path = fresh_path(spark, "json-export")
    rows = docs.flat_export(I.chat(spark, sf_dir))
    writers.write_rows(rows, path, "json")
    return spark.read.schema(rows.schema).json(path).select(*rows.columns)


@query("k8_export_options", S.with_ctes(S.CHAT, (
    "SELECT session, id, question, answer FROM chat"
)))
def k8_export_options(spark, sf_dir):
    bare = ExportConfig(include_timestamps=False, include_sources=False)
    return docs.flat_export(I.chat(spark, sf_dir), bare)


_INGEST_SQL = S.with_ctes(S.chunks(S.ROUTED), (
    "SELECT session, source_file, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens "
    "FROM chunks GROUP BY session, source_file"
))


def _ingested(spark, root):
    return ingest.ingested_chunks(spark, root).groupBy("session", "source_file").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens")
    )


def _document_stream(spark, sf_dir):
    table = I.table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(table.schema).option(
        "pathGlobFilter", "documents.parquet"
    ).parquet(sf_dir)
    return stream.select(
        F.col("source").alias("session"), F.expr(I.SOURCE_FILE).alias("source_file"),
        F.col("text").alias("content"),
    )


@query("st1_incremental_ingest", _INGEST_SQL)
def st1_incremental_ingest(spark, sf_dir):
    """The documents as a stream, chunked, embedded and stored."""
    root = fresh_path(spark, "ingest")
    ingest.start_ingest(
        _document_stream(spark, sf_dir), root, f"{root}-checkpoint",
        embedder=HashedWords(I.EMBED_DIM),
    ).awaitTermination()
    return _ingested(spark, root)


@query("st2_replayed_batch", _INGEST_SQL)
def st2_replayed_batch(spark, sf_dir):
    """A batch that is written twice adds nothing the second time."""
    root = fresh_path(spark, "replay")
    documents = I.documents(spark, sf_dir).select("session", "source_file", "content")
    for _ in range(2):
        ingest.ingest_batch(documents, 0, root)
    return _ingested(spark, root)


@query("st3_path_deduplication", S.with_ctes(S.chunks(S.ROUTED), (
    "SELECT session, source_file, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens "
    "FROM chunks GROUP BY session, source_file UNION ALL "
    "SELECT 'copy', source_file, count(*), sum(token_count)::BIGINT FROM chunks "
    "WHERE doc_id % 5 = 0 GROUP BY source_file"
)))
def st3_path_deduplication(spark, sf_dir):
    """Known documents in a later batch are skipped, also those that it holds twice.

    The same path in another session is another document.
    """
    root = fresh_path(spark, "dedup")
    documents = I.documents(spark, sf_dir).select("doc_id", "session", "source_file", "content")
    labelled = I.table(spark, sf_dir, "labels").select("doc_id")
    copies = documents.filter("doc_id % 5 = 0").withColumn("session", F.lit("copy"))
    ingest.ingest_batch(documents.join(labelled, "doc_id", "left_semi"), 0, root)
    ingest.ingest_batch(documents.unionByName(copies).unionByName(documents), 1, root)
    return _ingested(spark, root)


_BATCHES = 6


@query("st3_bucketed_paths", _INGEST_SQL)
def st3_bucketed_paths(spark, sf_dir):
    """Batches that each bring documents of the batch before again; their lists are merged twice."""
    root, config = fresh_path(spark, "bucketed"), IngestConfig(path_buckets=16, compact_every=2)
    documents = I.documents(spark, sf_dir).select("doc_id", "session", "source_file", "content")
    for batch in range(_BATCHES):
        own = documents.filter(F.col("doc_id") % _BATCHES == batch)
        again = documents.filter(F.col("doc_id") % _BATCHES == batch - 1)
        ingest.ingest_batch(own.unionByName(again), batch, root, ingest=config)
    return _ingested(spark, root)


_REVISED = "CASE WHEN doc_id % 3 = 0 THEN concat(text, ' revised') ELSE text END"
_REVISED_SQL = [*S.chunks(S.routed(_REVISED))]


def _revised(spark, sf_dir, **options):
    """A third of the documents changes; of the rest some come again, and some in an older version."""
    root = fresh_path(spark, "revised")

    def batch(content: str, hour: int, wanted: str, number: int) -> None:
        rows = I.documents(spark, sf_dir, content).filter(wanted).withColumn(
            "changed", F.timestamp_seconds(F.lit(hour * 3600)))
        ingest.ingest_batch(rows, number, root, version="changed", **options)

    batch("text", 1, "true", 0)
    batch("concat(text, ' revised')", 2, "doc_id % 3 = 0", 1)
    batch("concat(text, ' revised')", 2, "doc_id % 3 = 0", 1)  # replayed
    batch("text", 1, "doc_id % 3 = 1", 2)
    batch("'stale'", 0, "doc_id % 3 < 2", 3)
    return root


@query("u3_replaced_documents", S.with_ctes(_REVISED_SQL, (
    "SELECT session, source_file, chunk_index, content, start_position FROM chunks"
)))
def u3_replaced_documents(spark, sf_dir):
    """Chunks after changed documents took the place of their old versions, and a vacuum."""
    root = _revised(spark, sf_dir)
    ingest.vacuum_chunks(spark, root)
    return ingest.ingested_chunks(spark, root).select(
        "session", "source_file", "chunk_index", "content", "start_position")


@query("a1_ingested_totals", S.with_ctes(_REVISED_SQL, (
    "SELECT session, count(DISTINCT source_file) AS n_documents, count(*) AS n_chunks, "
    "count(*) AS n_embedded, sum(token_count)::BIGINT AS n_tokens, true AS complete "
    "FROM chunks GROUP BY session"
)))
def a1_ingested_totals(spark, sf_dir):
    """Totals kept up to date by every batch, replayed and changed ones included (A1, A3)."""
    root = _revised(spark, sf_dir, embedder=HashedWords(I.EMBED_DIM))
    return ingest.session_totals(spark, root)


class _Refusing(HashedWords):
    """A model that fails on texts of certain lengths."""

    def encode(self, texts):
        if any(len(text) % 11 == 3 for text in texts):
            raise ValueError("a text of a bad length")
        return super().encode(texts)


@query("v9_dead_letters", S.with_ctes(S.chunks(S.ROUTED), (
    "SELECT session, source_file, CASE WHEN count(*) FILTER (length(content) % 11 = 3) > 0 "
    "THEN 'ValueError: a text of a bad length' END AS reason, CASE WHEN count(*) FILTER "
    "(length(content) % 11 = 3) > 0 THEN count(*) FILTER (length(content) % 11 = 3) "
    "ELSE count(*) END AS n FROM chunks GROUP BY session, source_file"
)))
def v9_dead_letters(spark, sf_dir):
    """Documents with a text that the model refuses, set apart with the reason; the others are stored."""
    root = fresh_path(spark, "dead-letters")
    rows = I.documents(spark, sf_dir).select("session", "source_file", "content")
    ingest.ingest_batch(rows, 0, root, embedder=_Refusing(I.EMBED_DIM), reject_failures=True)
    kept = ingest.ingested_documents(spark, root).select(
        "session", "source_file", F.lit(None).cast("string").alias("reason"),
        F.col("n_chunks").alias("n"))
    return kept.unionByName(ingest.rejected_documents(spark, root).select(
        "session", "source_file", "reason", F.col("n_failed").alias("n")))


@query("v9_retried_documents", _INGEST_SQL)
def v9_retried_documents(spark, sf_dir):
    """Rejected documents taken in again once the model works."""
    root = fresh_path(spark, "retried")
    rows = I.documents(spark, sf_dir).select("session", "source_file", "content")
    ingest.ingest_batch(rows, 0, root, embedder=_Refusing(I.EMBED_DIM), reject_failures=True)
    ingest.retry_rejected(spark, root, 0, embedder=HashedWords(I.EMBED_DIM))
    return _ingested(spark, root)
