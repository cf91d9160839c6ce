"""Saved sessions, vacuum, bucketed tables and message totals."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliant.operators import corpus
from foliant.runtime import names_below
from foliant.sinks import buckets, writers
from foliant.streaming import ingest, messages

KIND = "session string, id string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), KIND)


def read(spark, root, name):
    return sorted((r.session, r.id) for r in writers.read_table(spark, root, name).collect())


def test_k7_a_missing_table_is_an_error(spark, tmp_path):
    root, some = str(tmp_path / "store"), rows(spark, ("s", "a"))
    with pytest.raises(ValueError, match="chunks"):
        writers.save("document_add", {"metadata": some}, root)
    with pytest.raises(ValueError, match="chat, index"):
        writers.save("close", {"metadata": some, "chunks": some}, root)
    assert names_below(spark, root) == []
    assert writers.save("chat_message", {}, root) == ()
    tables = {name: some for name in ("metadata", "chat", "chunks", "index")}
    assert writers.save("manual_save", tables, root) == ("metadata", "chat", "chunks", "index")
    assert read(spark, root, "index") == [("s", "a")]


def test_k7_an_emptied_session_is_empty_in_that_table_only(spark, tmp_path):
    root = str(tmp_path / "store")
    metadata = rows(spark, ("s", "m"), ("t", "m"))
    full = rows(spark, ("s", "a"), ("t", "b"), ("u", "c"))
    tables = {"metadata": metadata, "chat": full, "chunks": full, "index": full}
    writers.save("close", tables, root)
    tables["chat"] = rows(spark, ("t", "d"))
    writers.save("close", tables, root)
    # Session u is not among those that were saved, so its rows stay.
    assert read(spark, root, "chat") == [("t", "d"), ("u", "c")]
    assert read(spark, root, "chunks") == [("s", "a"), ("t", "b"), ("u", "c")]
    tables["chat"] = rows(spark, ("s", "e"))
    writers.save("close", tables, root)
    assert read(spark, root, "chat") == [("s", "e"), ("u", "c")]


def test_u2_vacuum_keeps_what_was_saved_after_the_mark(spark, tmp_path):
    root = str(tmp_path / "store")
    tables = {"metadata": rows(spark, ("s", "m"), ("t", "m")), "chunks": rows(spark, ("s", "a"), ("t", "b"))}
    writers.save("document_add", tables, root)
    assert writers.vacuum(spark, root, 0) == 0
    for session in ("s", "t"):
        writers.delete_session(spark, root, session)
    writers.save("document_add", {"chunks": rows(spark, ("s", "new"))}, root, only=("chunks",))
    assert writers.vacuum(spark, root, 3600) == 0  # the marks are too young
    assert read(spark, root, "chunks") == [("s", "new")] and read(spark, root, "metadata") == []
    assert writers.vacuum(spark, root, 0) == 3
    assert read(spark, root, "chunks") == [("s", "new")]
    assert writers.read_sessions(spark, f"{root}/chunks").count() == 1
    marks = spark.read.schema("session string, deleted_at bigint, name string").parquet(
        f"{root}/deleted_sessions")
    assert marks.count() == 0
    writers.delete_session(spark, root, "s")
    assert read(spark, root, "chunks") == []


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_j1_j6_stored_sides_are_not_shuffled(spark, tmp_path):
    chunks = spark.range(500).select(
        F.lit("s").alias("session"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"),
        F.lit("text").alias("content"), F.lit("f").alias("source_file"))
    vectors = spark.range(300).select(
        F.concat(F.lit("c"), (F.col("id") % 200).cast("string")).alias("id"),
        F.array(F.col("id").cast("float")).alias("embedding"), F.col("id").alias("at"))
    chat = spark.range(50).select(
        F.lit("s").alias("session"), F.col("id").cast("string").alias("id"),
        F.array(F.concat(F.lit("c"), (F.col("id") * 7).cast("string")), F.lit("none")).alias("source_chunks"))
    for name, frame in (("chunks", chunks), ("vectors", vectors)):
        buckets.write_bucketed(frame, str(tmp_path / name), buckets=4)
    stored, of = (buckets.read_bucketed(spark, str(tmp_path / n)) for n in ("chunks", "vectors"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = corpus.attach_embeddings(stored, of, "at")
        plain = corpus.attach_embeddings(chunks, vectors, "at")
        assert exchanges(joined) == 0 and exchanges(plain) == 2
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))
        cited = corpus.answer_sources(chat, stored)
        assert exchanges(cited) == 1
        assert cited.count() == corpus.answer_sources(chat, chunks).count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # A session that does not know the table registers it again.
    spark.sql(f"DROP TABLE {buckets._name(f'{tmp_path}/chunks/id-of-4')}")
    assert buckets.read_bucketed(spark, str(tmp_path / "chunks")).count() == 500
    with pytest.raises(ValueError, match="no bucketed table"):
        buckets.read_bucketed(spark, str(tmp_path))
    with pytest.raises(ValueError, match="column name"):
        buckets.write_bucketed(chunks, str(tmp_path / "x"), key="a b")


def test_a1_a7_totals_of_batches_and_replays(spark, tmp_path):
    root = str(tmp_path / "corpus")
    assert messages.message_totals(spark, root).count() == 0

    def batch(*some):
        return spark.createDataFrame(
            [(s, datetime.datetime(2024, 1, day), "q") for s, day in some],
            "session string, timestamp timestamp, question string")

    messages.add_messages(batch(("s", 1), ("s", 5), ("t", 2)), 0, root)
    messages.add_messages(batch(("s", 3)), 1, root)
    messages.add_messages(batch(("s", 3), ("t", 9)), 1, root)
    docs = spark.createDataFrame([("s", "a.txt", "text"), ("u", "b.txt", "text")],
                                 "session string, source_file string, content string")
    ingest.ingest_batch(docs, 0, root)
    found = {r.session: (r.n_documents, r.n_chunks, r.n_messages, r.first_asked and r.first_asked.day,
                         r.last_asked and r.last_asked.day)
             for r in messages.corpus_totals(spark, root).collect()}
    assert found == {"s": (1, 1, 3, 1, 5), "t": (0, 0, 2, 2, 9), "u": (1, 1, 0, None, None)}
