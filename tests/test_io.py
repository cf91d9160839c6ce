"""Readers, writers, exports, streams."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.config import ChunkingConfig, ExportConfig
from foliant.functions.embedding import HashedWords
from foliant.operators import extraction
from foliant.sinks import documents as docs
from foliant.sinks import writers
from foliant.sources import readers
from foliant.streaming import ingest

NASTY = 'He said "no",\nthen\tleft; \\ é 日本 {"x": [1]}'


def chat_table(spark, n=7):
    rows = [("s one", i, f"q{i} {NASTY}", f"a{i} {NASTY}", [f"c{i}", 'c"x']) for i in range(n)]
    rows.append(("t", 0, "q", "a", []))
    df = spark.createDataFrame(
        rows, "session string, seq bigint, question string, answer string, source_chunks array<string>")
    return df.withColumns({
        "id": F.concat("session", F.lit("-"), F.col("seq").cast("string")),
        "timestamp": F.timestamp_seconds(F.lit(1704067200) + F.col("seq")),
    })


def test_s1_s2_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("été".encode())
    (tmp_path / "sub" / "b.PDF").write_bytes(b"bad \xff byte")
    (tmp_path / "big.md").write_bytes(b"x" * 2049)
    (tmp_path / "edge.md").write_bytes(b"x" * 2048)
    (tmp_path / "empty.json").write_bytes(b"")
    config = ChunkingConfig(max_file_size_mb=2048 / 1024 / 1024)
    rows = {Path(r.source_file).name: r for r in readers.read_documents(spark, str(tmp_path), config).collect()}
    assert set(rows) == {"a.txt", "b.PDF", "edge.md"}
    assert rows["a.txt"].content == "été" and rows["a.txt"].size == 5
    assert rows["b.PDF"].file_type == "pdf" and "�" in rows["b.PDF"].content
    plan = readers.read_documents(spark, str(tmp_path), config)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,2048)" in plan.replace(" ", "")


def test_s4_extraction(spark):
    rows = [
        ("a.pdf", "L", "R", "P", "O", "L", "layout"), ("b.pdf", "", "R", "P", "O", "O", "ocr"),
        ("c.pdf", None, "R", "P", "O", "R", "raw"), ("d.pdf", None, "", "P", "O", "P", "page"),
        ("e.pdf", None, None, None, "O", "O", "ocr"), ("f.pdf", "", "R", "P", "", None, "failed"),
        ("g.pdf", None, "", "", None, None, "failed"),
    ]
    df = spark.createDataFrame(
        rows, "source_file string, layout_text string, raw_text string, page_text string, "
        "ocr_text string, want string, method string")
    for r in extraction.extract_text(df).collect():
        assert r.extraction_method == r.method
        if r.method == "failed":
            assert r.content == (
                f"[PDF Document] {r.source_file} - Could not extract text. "
                "May be encrypted or image-only PDF.")
        else:
            assert r.content == r.want


def test_s4_placeholder_is_one_uncleaned_chunk(spark):
    name = "dir/" + "x-\n  y" * 300 + ".pdf"
    df = spark.createDataFrame(
        [(name, "", "", "", ""), ("short.pdf", "too short", "", "", "")],
        "source_file string, layout_text string, raw_text string, page_text string, ocr_text string")
    rows = extraction.document_chunks(extraction.extract_text(df)).collect()
    assert [(r.source_file, r.chunk_index, r.start_position, r.end_position) for r in rows] == [
        (name, 0, 0, len(rows[0].content))]
    assert name in rows[0].content


def test_s5_empty_pages_keep_their_number(spark):
    pages = spark.createDataFrame(
        [("d", 10, "ten"), ("d", 2, "two"), ("d", 1, ""), ("e", 1, "")],
        "source_file string, page int, text string")
    rows = extraction.assemble_pages(pages).collect()
    assert [r.content for r in rows] == ["two\n\n--- Page 2 ---\n\nten\n\n--- Page 10 ---\n\n"]


def test_s6_s7(spark):
    info = "Title: a\nAuthor: b\n Pages: 3\nPages:   42\nEncrypted: no\nProducer: x"
    df = spark.createDataFrame([(info,), ("nothing",), ("Pages: 99999999999",)], "i string")
    rows = df.select(extraction.document_info(F.col("i")), extraction.page_count(F.col("i"))).collect()
    assert rows[0][0] == "Title: a Author: b Pages:   42 Encrypted: no "
    assert [r[1] for r in rows] == [3, -1, -1]


def test_s12_missing_metadata_and_bad_input(spark):
    good = spark.createDataFrame([(json.dumps([
        {"id": "1", "content": NASTY}, {"id": "2", "content": "x", "metadata": "m"}]),)], "value string")
    assert [tuple(r) for r in readers.parse_chunk_input(good).collect()] == [
        ("1", NASTY, ""), ("2", "x", "m")]
    with pytest.raises(Exception):
        readers.parse_chunk_input(spark.createDataFrame([("[{",)], "value string")).collect()


def test_k3_s9_round_trip_in_parts(spark, tmp_path):
    chat = chat_table(spark)
    saved = docs.chat_documents_json(chat, "seq", entries=3, rows_per_range=2)
    assert {(r.session, r.part, r.n_entries) for r in saved.collect()} == {
        ("s one", 0, 3), ("s one", 1, 3), ("s one", 2, 1), ("t", 0, 1)}
    writers.write_documents(saved, str(tmp_path / "chat"))
    back = readers.read_chat_documents(spark, str(tmp_path / "chat"))
    columns = ["session", "id", "question", "answer", "timestamp", "source_chunks"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(
        map(str, chat.select(columns).collect()))


def test_k1_s8_round_trip(spark, tmp_path):
    rows = [("s", f"c{i}", NASTY, "f", i, i * 10, i * 10 + 5, [0.5, float(i)] if i else None)
            for i in range(5)]
    chunks = spark.createDataFrame(
        rows, "session string, id string, content string, source_file string, chunk_index int, "
        "start_position bigint, end_position bigint, embedding array<float>")
    saved = docs.chunk_documents_json(chunks, entries=2)
    assert saved.count() == 3
    first = json.loads(saved.orderBy("part").first().value)
    assert list(first) == ["chunks"] and [c["id"] for c in first["chunks"]] == ["c0", "c1"]
    assert list(first["chunks"][0]) == [
        "id", "content", "source_file", "chunk_index", "start_position", "end_position", "embedding"]
    writers.write_documents(saved, str(tmp_path / "chunks"))
    back = readers.read_chunk_documents(spark, str(tmp_path / "chunks")).orderBy("id").collect()
    assert [(r.session, r.id, r.content, r.chunk_index, r.embedding) for r in back] == [
        ("s", f"c{i}", NASTY, i, [0.5, float(i)] if i else []) for i in range(5)]


def test_s8_pretty_printed_file(spark, tmp_path):
    entry = {"id": "1", "content": "x", "source_file": "f", "chunk_index": 0,
             "start_position": 0, "end_position": 1, "embedding": [1.0]}
    (tmp_path / "doc_chunks.json").write_text(json.dumps({"chunks": [entry]}, indent=2))
    rows = readers.read_chunk_documents(spark, str(tmp_path), multi_line=True).collect()
    assert [(r.id, r.embedding) for r in rows] == [("1", [1.0])]


def session_rows(spark):
    return spark.sql(
        "SELECT 's one' AS session, 2L AS n_documents, 7L AS total_chunks, 7L AS total_messages, "
        "timestamp'2024-01-01 00:00:00' AS created_at, timestamp'2024-01-02 00:00:00' AS last_modified, "
        "'a \"b\"' AS description UNION ALL SELECT 't', 0L, 0L, 1L, timestamp'2024-01-01 00:00:00', "
        "timestamp'2024-01-01 00:00:00', ''")


def document_rows(spark):
    return spark.createDataFrame([("s one", "b.txt", 1), ("s one", "a.txt", 2)],
                                 "session string, source_file string, n bigint")


def test_k2_s10_documents_keep_their_order(spark, tmp_path):
    saved = docs.metadata_documents_json(session_rows(spark), document_rows(spark), "n")
    writers.write_documents(saved, str(tmp_path / "meta"))
    rows = {r.name: r for r in readers.read_metadata_documents(spark, str(tmp_path / "meta")).collect()}
    assert rows["s one"].documents == ["b.txt", "a.txt"] and rows["s one"].description == 'a "b"'
    assert rows["t"].documents == [] and rows["s one"].created_at == "2024-01-01 00:00:00"


def test_k4_text_export_file(spark, tmp_path):
    chat = chat_table(spark, 2).withColumn("question", F.concat(F.lit("q"), F.col("seq").cast("string"))) \
        .withColumn("answer", F.lit("a"))
    lines = docs.text_export(session_rows(spark), document_rows(spark), chat,
                             document_order="n", chat_order="seq")
    writers.write_export(lines, str(tmp_path / "export"))
    folder = next(p for p in (tmp_path / "export").iterdir() if p.name.startswith("session=s"))
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert text == (
        "=== SESSION EXPORT ===\n\nSession: s one\nCreated: 2024-01-01 00:00:00\n"
        'Last Modified: 2024-01-02 00:00:00\nDescription: a "b"\n\nDocuments (2):\n'
        "  - b.txt\n  - a.txt\n\nChat History (7 messages):\n\n"
        "Q: q0\nA: a\n   [2024-01-01 00:00:00]\n\nQ: q1\nA: a\n   [2024-01-01 00:00:01]\n\n")


def test_k8_flags(spark):
    bare = ExportConfig(include_metadata=False, include_timestamps=False, include_sources=False)
    lines = docs.text_export(session_rows(spark), document_rows(spark), chat_table(spark, 1),
                             document_order="n", chat_order="seq", config=bare)
    text = [r.line for r in lines.collect()]
    assert not any(t.startswith(("Session:", "Documents", "  - ", "   [")) for t in text)


def test_u2_deleted_sessions_are_left_out(spark, tmp_path):
    root = str(tmp_path / "store")
    chunks = spark.createDataFrame([("s_1", "a"), ("t_1", "b")], "session string, id string")
    assert writers.save(
        "document_add", {"chunks": chunks, "chat": chunks}, root, only=("chunks",)) == ("chunks",)
    assert writers.read_table(spark, root, "chunks").count() == 2
    writers.delete_session(spark, root, "s_1")
    assert [r.id for r in writers.read_table(spark, root, "chunks").collect()] == ["b"]


def test_k7_a_save_takes_the_place_of_the_last(spark, tmp_path):
    root = str(tmp_path / "store")
    kind = "session string, id string"
    both = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c")], kind)
    for operation in ("document_add", "document_add", "manual_save", "close"):
        writers.save(operation, {"chunks": both}, root, only=("chunks",))
    assert writers.read_table(spark, root, "chunks").count() == 3
    writers.save("document_add", {"chunks": spark.createDataFrame([("s", "d")], kind)}, root,
                 only=("chunks",))
    assert sorted(r.id for r in writers.read_table(spark, root, "chunks").collect()) == ["c", "d"]
    writers.delete_session(spark, root, "s")
    writers.save("document_add", {"chunks": spark.createDataFrame([("s", "e")], kind)}, root,
                 only=("chunks",))
    assert sorted(r.id for r in writers.read_table(spark, root, "chunks").collect()) == ["c", "e"]


def test_session_names_stay_strings(spark, tmp_path):
    names = ["007", "7", "2024-01-01", "1e3"]
    rows = spark.createDataFrame([(n, f"id{n}") for n in names], "session string, id string")
    root = str(tmp_path / "store")
    writers.save("document_add", {"chunks": rows}, root, only=("chunks",))
    writers.delete_session(spark, root, "7")
    left = writers.read_table(spark, root, "chunks").collect()
    assert sorted((r.session, r.id) for r in left) == sorted(
        (n, f"id{n}") for n in names if n != "7")
    chat = chat_table(spark, 1).crossJoin(spark.createDataFrame([(n,) for n in names], "n string"))
    saved = docs.chat_documents_json(chat.withColumn("session", F.col("n")), "seq")
    writers.write_documents(saved, str(tmp_path / "chat"))
    back = readers.read_chat_documents(spark, str(tmp_path / "chat"))
    assert {r.session for r in back.collect()} == set(names)


def test_empty_session_names_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("", "a")], "session string, id string")
    with pytest.raises(Exception, match="empty name"):
        writers.save("document_add", {"chunks": rows}, str(tmp_path / "store"), only=("chunks",))


def test_ingest_keeps_one_row_per_document(spark, tmp_path):
    root = str(tmp_path / "corpus")
    rows = spark.createDataFrame(
        [("s", "a.txt", "text"), ("s", "a.txt", "text"), ("t", "a.txt", "text")],
        "session string, source_file string, content string")
    ingest.ingest_batch(rows, 0, root)
    ingest.ingest_batch(rows, 1, root)
    assert ingest.ingested_chunks(spark, root).count() == 2
    assert {(r.session, r.n_chunks) for r in ingest.ingested_documents(spark, root).collect()} == {
        ("s", 1), ("t", 1)}


def test_unknown_export_format(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.write_rows(chat_table(spark), str(tmp_path / "x"), "xls")


def stream(spark, path):
    return readers.stream_documents(spark, path, files_per_batch=2).withColumn("session", F.lit("s"))


def test_st1_st2_st3(spark, tmp_path):
    inbox, root, state = (str(tmp_path / n) for n in ("inbox", "root", "state"))
    Path(inbox).mkdir()
    for i in range(5):
        Path(inbox, f"d{i}.txt").write_text(f"document {i}. " * 200)
    Path(inbox, "empty.txt").write_text("")
    run = dict(embedder=HashedWords(8))
    ingest.start_ingest(stream(spark, inbox), root, state, **run).awaitTermination()
    chunks = ingest.ingested_chunks(spark, root)
    assert chunks.select("batch_id").distinct().count() == 3
    batch = extraction.document_chunks(readers.read_documents(spark, inbox))
    columns = ["source_file", "chunk_index", "content", "start_position"]
    everything = sorted(map(tuple, batch.select(columns).collect()))
    assert sorted(map(tuple, chunks.select(columns).collect())) == everything
    assert chunks.filter(F.size("embedding") != 8).count() == 0
    assert ingest.ingested_documents(spark, root).count() == 5

    # Again with the same state: nothing new.  With a new state: all known.
    ingest.start_ingest(stream(spark, inbox), root, state, **run).awaitTermination()
    ingest.start_ingest(stream(spark, inbox), root, state + "2", **run).awaitTermination()
    Path(inbox, "late.md").write_text("late text " * 10)
    ingest.start_ingest(stream(spark, inbox), root, state, **run).awaitTermination()
    spark.catalog.clearCache()
    assert ingest.ingested_documents(spark, root).count() == 6
    batch = extraction.document_chunks(readers.read_documents(spark, inbox))
    assert sorted(map(tuple, ingest.ingested_chunks(spark, root).select(columns).collect())) == sorted(
        map(tuple, batch.select(columns).collect()))


def test_st2_a_replayed_batch_is_overwritten(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame(
        [("s", "a.txt", "one " * 5), ("s", "b.txt", "two " * 5)],
        "session string, source_file string, content string")
    for _ in range(2):
        ingest.ingest_batch(df, 4, root, run="r")
    assert ingest.ingested_chunks(spark, root).count() == 2
    ingest.ingest_batch(df.filter("source_file = 'a.txt'"), 5, root, run="r")
    assert ingest.ingested_chunks(spark, root).count() == 2
    assert ingest.ingested_documents(spark, root).count() == 2
