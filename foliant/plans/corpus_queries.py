"""Queries on the corpus: joins, totals, sessions, chat (J, A, W, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions.vectors import is_embedded
from foliant.operators import corpus
from foliant.operators.extraction import text_chunks
from foliant.plans import inputs as I
from foliant.plans import sql as S
from foliant.plans.registry import ORACLES, query
from foliant.runtime import fresh_path
from foliant.sinks import buckets
from foliant.streaming import messages

_EVENT_SESSIONS = (
    "SELECT concat('user_', user_id) AS name, min(ts) AS created_at, max(ts) AS last_modified, "
    "count(*) AS n_events FROM events GROUP BY user_id"
)


def _event_sessions(spark, sf_dir):
    return I.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_modified"),
        F.count(F.lit(1)).alias("n_events"),
    ).withColumn("name", F.concat(F.lit("user_"), F.col("user_id").cast("string")))


# -- joins -------------------------------------------------------------------

_CHUNK_VECTORS = (
    "vectors AS (SELECT concat('chunk_', md5(source_file), '_0') AS id, vec_id, embedding "
    f"FROM ({S.documents()}) d JOIN embeddings e "
    "ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) "
    "OR e.vec_id = (d.doc_id + 7) % (SELECT count(*) FROM embeddings) AND d.doc_id % 3 = 0)"
)


def _chunk_vectors(spark, sf_dir):
    """A vector for the first chunk of every document, and two for every third."""
    vectors = I.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    own = F.col("doc_id") % n
    numbers = F.when(F.col("doc_id") % 3 == 0, F.array_distinct(
        F.array(own, (F.col("doc_id") + 7) % n))).otherwise(F.array(own))
    wanted = I.documents(spark, sf_dir).select(
        tx.chunk_id("source_file", F.lit(0)).alias("id"), F.explode(numbers).alias("vec_id"))
    return wanted.join(vectors, "vec_id").select("id", "vec_id", "embedding")


@query("j1_attach_embeddings", S.with_ctes([
    *S.chunks(), _CHUNK_VECTORS,
    "latest AS (SELECT id, arg_max(embedding, vec_id) AS embedding FROM vectors GROUP BY id)",
], (
    "SELECT c.id, l.embedding IS NOT NULL AS embedded, "
    "round(l.embedding[1]::DOUBLE * 1000000)::BIGINT AS first_component "
    "FROM chunks c LEFT JOIN latest l ON c.id = l.id"
)))
def j1_attach_embeddings(spark, sf_dir):
    joined = corpus.attach_embeddings(
        I.plain_chunks(spark, sf_dir), _chunk_vectors(spark, sf_dir), "vec_id"
    )
    return joined.select(
        "id", is_embedded(F.col("embedding")).alias("embedded"),
        F.round(F.col("embedding")[0].cast("double") * 1000000).cast("bigint").alias(
            "first_component"),
    )


def _bucketed(spark, frame, name):
    path = fresh_path(spark, name)
    buckets.write_bucketed(frame, path, buckets=16)
    return buckets.read_bucketed(spark, path)


@query("j1_bucketed_embeddings", ORACLES["j1_attach_embeddings"])
def j1_bucketed_embeddings(spark, sf_dir):
    """Chunks and vectors stored in buckets of the id and joined bucket by bucket."""
    chunks = _bucketed(spark, I.plain_chunks(spark, sf_dir), "chunk-buckets")
    vectors = _bucketed(spark, _chunk_vectors(spark, sf_dir), "vector-buckets")
    return corpus.attach_embeddings(chunks, vectors, "vec_id").select(
        "id", is_embedded(F.col("embedding")).alias("embedded"),
        F.round(F.col("embedding")[0].cast("double") * 1000000).cast("bigint").alias(
            "first_component"),
    )


@query("v9_reject_incomplete", S.with_ctes([*S.chunks(), _CHUNK_VECTORS], (
    "SELECT id, source_file FROM chunks WHERE source_file NOT IN (SELECT source_file FROM chunks "
    "WHERE id NOT IN (SELECT id FROM vectors))"
)))
def v9_reject_incomplete(spark, sf_dir):
    embedded = corpus.attach_embeddings(
        I.plain_chunks(spark, sf_dir), _chunk_vectors(spark, sf_dir), "vec_id"
    )
    return corpus.fully_embedded(embedded).select("id", "source_file")


_EXISTING = (
    f"existing AS (SELECT DISTINCT session, source_file FROM ({S.documents()}) d "
    "JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1)"
)


def _existing(spark, sf_dir):
    """Paths already in the corpus: those of documents labelled as good."""
    good = I.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return I.documents(spark, sf_dir).join(good, "doc_id", "left_semi").select(
        "session", "source_file")


_INCOMING = (
    f"docs AS (SELECT * FROM ({S.documents()}) UNION ALL SELECT * REPLACE ('copy' AS session) "
    f"FROM ({S.documents()}) WHERE doc_id % 5 = 0)"
)


@query("j2_new_documents", S.with_ctes([_INCOMING, _EXISTING], (
    "SELECT doc_id, session, source_file FROM docs d WHERE NOT EXISTS "
    "(SELECT 1 FROM existing e WHERE e.source_file = d.source_file AND e.session = d.session)"
)))
def j2_new_documents(spark, sf_dir):
    """Every fifth path comes in a second session too, where it is new."""
    docs = I.documents(spark, sf_dir)
    again = docs.filter("doc_id % 5 = 0").withColumn("session", F.lit("copy"))
    fresh = corpus.new_documents(docs.unionByName(again), _existing(spark, sf_dir))
    return fresh.select("doc_id", "session", "source_file")


@query("j6_answer_sources", S.with_ctes([*S.chunks(), *S.CHAT], (
    "SELECT m.session, m.id AS message_id, m.ordinal, m.chunk_id, c.content, c.source_file "
    "FROM (SELECT session, id, unnest(source_chunks) AS chunk_id, "
    "(generate_subscripts(source_chunks, 1) - 1)::INTEGER AS ordinal FROM chat) m "
    "JOIN chunks c ON c.id = m.chunk_id"
)))
def j6_answer_sources(spark, sf_dir):
    found = corpus.answer_sources(I.chat(spark, sf_dir), I.plain_chunks(spark, sf_dir))
    return found.select("session", "message_id", "ordinal", "chunk_id", "content", "source_file")


@query("j6_bucketed_sources", ORACLES["j6_answer_sources"])
def j6_bucketed_sources(spark, sf_dir):
    """The same against chunks stored in buckets, which stay where they are."""
    chunks = _bucketed(spark, I.plain_chunks(spark, sf_dir), "chunk-buckets")
    found = corpus.answer_sources(I.chat(spark, sf_dir), chunks)
    return found.select("session", "message_id", "ordinal", "chunk_id", "content", "source_file")


@query("j6_cited_chunks", S.with_ctes([*S.chunks(), *S.CHAT], (
    "SELECT id, source_file FROM chunks WHERE id IN (SELECT unnest(source_chunks) FROM chat)"
)))
def j6_cited_chunks(spark, sf_dir):
    return corpus.cited_chunks(
        I.chat(spark, sf_dir), I.plain_chunks(spark, sf_dir)
    ).select("id", "source_file")


@query("j6_uncited_chunks", S.with_ctes([*S.chunks(), *S.CHAT], (
    "SELECT id, source_file FROM chunks WHERE id NOT IN (SELECT unnest(source_chunks) FROM chat)"
)))
def j6_uncited_chunks(spark, sf_dir):
    return corpus.uncited_chunks(
        I.chat(spark, sf_dir), I.plain_chunks(spark, sf_dir)
    ).select("id", "source_file")


_SESSION_IDS_SQL = S.with_ctes([
    f"requested AS ({_EVENT_SESSIONS} UNION ALL SELECT source, TIMESTAMP '2024-02-01 10:20:30', "
    "TIMESTAMP '2024-02-01 10:20:30', 0 FROM documents GROUP BY source)",
    S.DIRECTORIES,
    "catalog AS (SELECT regexp_replace(directory, '_[^_]*$', '') AS name, "
    "max(directory) AS directory FROM directories GROUP BY 1)",
], (
    "SELECT r.name, coalesce(c.directory, concat(r.name, '_', "
    "strftime(r.created_at, '%Y-%m-%d-%H%M%S'))) AS session_id, "
    "c.directory IS NOT NULL AS existed FROM requested r LEFT JOIN catalog c ON r.name = c.name"
))


def _session_ids(spark, sf_dir):
    asked = _event_sessions(spark, sf_dir).select("name", "created_at")
    sources = I.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    requested = asked.unionByName(sources.withColumn(
        "created_at", F.lit("2024-02-01 10:20:30").cast("timestamp_ntz")
    ))
    return corpus.session_ids(requested, I.session_directories(spark, sf_dir)).select(
        "name", "session_id", "existed"
    )


@query("t14_session_id", _SESSION_IDS_SQL)
def t14_session_id(spark, sf_dir):
    return _session_ids(spark, sf_dir)


@query("j7_existing_session", _SESSION_IDS_SQL.replace(
    "SELECT r.name,", "SELECT r.name, c.directory,").replace(", coalesce(c.directory, concat("
    "r.name, '_', strftime(r.created_at, '%Y-%m-%d-%H%M%S'))) AS session_id", ""))
def j7_existing_session(spark, sf_dir):
    found = _session_ids(spark, sf_dir)
    return found.select(
        "name", F.when(F.col("existed"), F.col("session_id")).alias("directory"), "existed"
    )


# -- aggregations ------------------------------------------------------------

@query("a1_session_totals", S.with_ctes([*S.chunks(S.ROUTED), *S.CHAT, *S.SESSIONS], (
    f"SELECT session, n_documents, total_chunks, total_messages, {S.stamp('created_at')} "
    f"AS created_at, {S.stamp('last_modified')} AS last_modified FROM sessions"
)))
def a1_session_totals(spark, sf_dir):
    totals = corpus.session_totals(I.routed_chunks(spark, sf_dir), I.chat(spark, sf_dir))
    return totals.withColumns({
        "created_at": tx.format_timestamp("created_at"),
        "last_modified": tx.format_timestamp("last_modified"),
    })


@query("a3_embedding_coverage", S.with_ctes([*S.chunks(), _CHUNK_VECTORS], (
    "SELECT session, count(*) FILTER (WHERE id IN (SELECT id FROM vectors)) AS n_embedded, "
    "count(*) AS n_chunks, count(*) FILTER (WHERE id IN (SELECT id FROM vectors)) = count(*) "
    "AS complete FROM chunks GROUP BY session"
)))
def a3_embedding_coverage(spark, sf_dir):
    return corpus.embedding_coverage(corpus.attach_embeddings(
        I.plain_chunks(spark, sf_dir), _chunk_vectors(spark, sf_dir), "vec_id"
    ))


@query("a4_document_list", (
    "SELECT session, source_file, row_number() OVER (PARTITION BY session ORDER BY doc_id) - 1 "
    f"AS position FROM ({S.documents()})"
))
def a4_document_list(spark, sf_dir):
    docs = I.documents(spark, sf_dir).select("session", "source_file", "doc_id")
    return corpus.document_list(docs, "doc_id").select("session", "source_file", "position")


@query("a5_embedding_batches", S.with_ctes(S.chunks(), (
    "SELECT session, source_file, (chunk_index // 16)::BIGINT AS batch, count(*) AS n_texts, "
    "sum(token_count)::BIGINT AS n_tokens, string_agg(id, ',' ORDER BY chunk_index) AS ids "
    "FROM chunks GROUP BY 1, 2, 3"
)))
def a5_embedding_batches(spark, sf_dir):
    return corpus.embedding_batches(I.plain_chunks(spark, sf_dir))


@query("a6_distinct_documents", S.with_ctes(
    S.chunks(), "SELECT DISTINCT session, source_file FROM chunks"
))
def a6_distinct_documents(spark, sf_dir):
    return corpus.distinct_documents(I.plain_chunks(spark, sf_dir))


@query("a6_first_by_path", (
    "SELECT source AS session, concat('text/', md5(text)) AS source_file, min(doc_id // 2) AS place "
    "FROM documents GROUP BY source, md5(text)"
))
def a6_first_by_path(spark, sf_dir):
    """Rows with the same text share a path; two of a session may have the same place."""
    by_text = I.table(spark, sf_dir, "documents").select(
        F.col("source").alias("session"), F.concat(F.lit("text/"), F.md5("text")).alias("source_file"),
        "doc_id", F.expr("doc_id div 2").alias("place"),
    )
    return corpus.first_by_path(by_text, "place").select("session", "source_file", "place")


@query("a7_message_counts", S.with_ctes(
    S.CHAT, "SELECT session, count(*) AS n_messages FROM chat GROUP BY session"
))
def a7_message_counts(spark, sf_dir):
    return corpus.message_counts(I.chat(spark, sf_dir))


@query("a7_message_totals", S.with_ctes(S.CHAT, (
    f"SELECT session, count(*) AS n_messages, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_asked, "
    "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_asked FROM chat GROUP BY session"
)))
def a7_message_totals(spark, sf_dir):
    """Totals that batches of messages keep up to date; one of them comes twice."""
    root, chat = fresh_path(spark, "messages"), I.chat(spark, sf_dir)
    for number in (0, 1, 1, 2):
        messages.add_messages(chat.filter(F.col("conv_id") % 3 == number), number, root)
    return messages.message_totals(spark, root).select(
        "session", "n_messages", tx.format_timestamp("first_asked").alias("first_asked"),
        tx.format_timestamp("last_asked").alias("last_asked"))


# -- windows and listings ----------------------------------------------------

@query("w2_last_message", S.with_ctes(S.CHAT, (
    f"SELECT session, id, question, answer, {S.CHAT_TIME} AS asked_at FROM chat "
    "QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, seq DESC) = 1"
)))
def w2_last_message(spark, sf_dir):
    last = corpus.last_message(I.chat(spark, sf_dir), ["timestamp", "seq"])
    return last.select(
        "session", "id", "question", "answer", tx.format_timestamp("timestamp").alias("asked_at")
    )


@query("w3_session_listing", (
    "SELECT source AS name, source = 'src7' AS active, concat(source, CASE WHEN source = 'src7' "
    "THEN ' (active)' ELSE '' END) AS label FROM documents GROUP BY source ORDER BY name"
))
def w3_session_listing(spark, sf_dir):
    names = I.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    return corpus.session_listing(names, active="src7")


@query("w4_latest_directory", S.with_ctes([S.DIRECTORIES], (
    "SELECT regexp_replace(directory, '_[^_]*$', '') AS name, max(directory) AS directory "
    "FROM directories GROUP BY 1"
)))
def w4_latest_directory(spark, sf_dir):
    return corpus.latest_directory(I.session_directories(spark, sf_dir))


@query("w5_top_k_per_group", S.with_ctes(S.chunks(), (
    "SELECT session, id, token_count, row_number() OVER (PARTITION BY session "
    "ORDER BY token_count DESC, id)::INTEGER AS rank FROM chunks "
    "QUALIFY row_number() OVER (PARTITION BY session ORDER BY token_count DESC, id) <= 5"
)))
def w5_top_k_per_group(spark, sf_dir):
    chunks = I.plain_chunks(spark, sf_dir).select("session", "id", "token_count")
    return corpus.ranked(chunks, "session", [F.desc("token_count"), F.asc("id")], 5)


@query("w6_session_retention", (
    f"SELECT name, {S.stamp('last_modified')} AS last_modified, n_events FROM ({_EVENT_SESSIONS}) "
    "WHERE last_modified >= TIMESTAMP '2024-02-25 00:00:00' - INTERVAL 30 DAY "
    "ORDER BY last_modified DESC, name LIMIT 100"
))
def w6_session_retention(spark, sf_dir):
    as_of = F.lit("2024-02-25 00:00:00").cast("timestamp_ntz")
    kept = corpus.retained_sessions(_event_sessions(spark, sf_dir), as_of)
    return kept.select(
        "name", tx.format_timestamp("last_modified").alias("last_modified"), "n_events"
    )


@query("w7_pair_messages", (
    "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER p AS next_role, "
    "lead(text) OVER p AS answer FROM conversations "
    "WINDOW p AS (PARTITION BY conv_id ORDER BY turn)) "
    "WHERE role = 'user' AND next_role = 'assistant'"
))
def w7_pair_messages(spark, sf_dir):
    pairs = corpus.pair_messages(I.table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", "question", "answer")


@query("w7_pair_messages_ranged", ORACLES["w7_pair_messages"])
def w7_pair_messages_ranged(spark, sf_dir):
    """The same with every longer conversation cut into ranges."""
    pairs = corpus.pair_messages(I.table(spark, sf_dir, "conversations"), rows_per_range=4)
    return pairs.select("conv_id", "turn", "question", "answer")


# -- maintenance -------------------------------------------------------------

@query("u1_append", S.with_ctes(S.chunks(), (
    "SELECT session, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens FROM ("
    "SELECT session, token_count FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels) "
    "UNION ALL SELECT session, token_count FROM chunks "
    "WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY session"
)))
def u1_append(spark, sf_dir):
    docs, known = I.documents(spark, sf_dir), I.table(spark, sf_dir, "labels").select("doc_id")
    both = corpus.append(*(
        text_chunks(docs.join(known, "doc_id", how), keep=("doc_id", "session"))
        for how in ("left_semi", "left_anti")
    ))
    return both.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens")
    )


@query("u2_delete_session", S.with_ctes(S.chunks(), (
    "SELECT session, count(*) AS n_chunks FROM chunks WHERE session <> 'src7' GROUP BY session"
)))
def u2_delete_session(spark, sf_dir):
    left = corpus.without_session(I.plain_chunks(spark, sf_dir), "src7")
    return left.groupBy("session").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("u3_changed_documents", S.with_ctes([f"docs AS ({S.documents()})"], (
    "SELECT source_file, modified FROM (SELECT source_file, doc_id + CASE WHEN doc_id IN "
    "(SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS modified FROM docs) "
    "EXCEPT SELECT source_file, doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)"
)))
def u3_changed_documents(spark, sf_dir):
    labels = I.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = I.documents(spark, sf_dir).select("doc_id", "session", "source_file").join(
        labels, "doc_id", "left"
    )
    incoming = docs.select(
        "session", "source_file",
        (F.col("doc_id") + F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("modified"),
    )
    stored = docs.filter(F.col("toxic").isNotNull()).select(
        "session", "source_file", F.col("doc_id").alias("modified")
    )
    return corpus.changed_documents(incoming, stored).select("source_file", "modified")
