"""The bucketed document list, replaced versions and rejected documents."""

import datetime
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.config import IngestConfig
from foliant.functions.embedding import HashedWords, embed_or_reason
from foliant.operators import corpus, extraction
from foliant.runtime import names_below
from foliant.streaming import ingest
from foliant.streaming.catalog import DocumentCatalog

KIND = "session string, source_file string, content string"
SMALL = IngestConfig(path_buckets=8, compact_every=5)


def batch_rows(spark, numbers):
    return spark.createDataFrame([("s", f"d{i}.txt", f"text {i}") for i in numbers], KIND)


def files_below(path):
    return [p for p in Path(path).rglob("*.parquet")]


def listed_rows(spark, numbers):
    return spark.createDataFrame(
        [(f"d{i}.txt", "s", None, 1, 0, 2) for i in numbers],
        "source_file string, session string, modified timestamp, n_chunks long, n_embedded long, n_tokens long")


def test_st3_fifty_batches_leave_a_bounded_number_of_files(spark, tmp_path):
    root = str(tmp_path / "corpus")
    catalog = DocumentCatalog(spark, root, SMALL)
    for batch in range(50):
        catalog.compact("r", batch)
        catalog.add(listed_rows(spark, [2 * batch, 2 * batch + 1]), "r", batch)
    listed = [r.source_file for r in catalog.documents().collect()]
    assert sorted(listed) == sorted(f"d{i}.txt" for i in range(100))
    # Two epochs of eight buckets, deltas of two rounds, and the commits.
    assert len(files_below(f"{root}/documents")) <= 2 * 8 + 3 * 5 * 2 + 4
    some = catalog.entries([3])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[\(?concat_ws\(/, ", plan)
    assert catalog.has_merged("r", 3) and not catalog.has_merged("r", 49) and not catalog.has_merged("q", 3)


def test_st3_batches_that_bring_known_documents(spark, tmp_path):
    root, config = str(tmp_path / "corpus"), IngestConfig(path_buckets=4, compact_every=2)
    for batch in range(6):  # each brings two new documents and one of the batch before
        ingest.ingest_batch(
            batch_rows(spark, [2 * batch, 2 * batch + 1, max(0, 2 * batch - 1)]), batch, root, ingest=config)
    listed = ingest.ingested_documents(spark, root, config).select("source_file", "n_chunks").collect()
    assert sorted(map(tuple, listed)) == sorted((f"d{i}.txt", 1) for i in range(12))
    # A batch that is part of the merged list is complete: nothing happens when it comes again.
    ingest.ingest_batch(batch_rows(spark, [500]), 1, root, ingest=config)
    assert ingest.ingested_chunks(spark, root).count() == 12


def test_st3_a_merge_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "corpus")
    catalog = DocumentCatalog(spark, root, SMALL)
    for batch in range(5):
        catalog.add(listed_rows(spark, [batch]), "r", batch)
    monkeypatch.setattr(DocumentCatalog, "_clean", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalog.compact("r", 5)
    # The commit counts, although its deltas are still there; an incomplete one does not.
    monkeypatch.undo()
    Path(f"{root}/documents/of-8/commits/epoch=2/buckets").mkdir(parents=True)
    assert catalog._epoch() == 1 and catalog.documents().count() == 5
    assert not catalog.compact("r", 5)
    for batch in range(5, 12):
        catalog.compact("r", batch)
        catalog.add(listed_rows(spark, [batch, batch - 1]), "r", batch)
    assert catalog._epoch() == 2 and catalog.documents().count() == 12
    with pytest.raises(ValueError, match="other buckets"):
        DocumentCatalog(spark, root, IngestConfig(path_buckets=9))


def test_u3_a_stream_with_changes_equals_a_batch_of_the_newest(spark, tmp_path):
    inbox, root, state = (tmp_path / n for n in ("inbox", "root", "state"))
    inbox.mkdir()
    kind = KIND + ", changed timestamp"

    def arrive(name, *rows):
        (inbox / name).write_text("".join(json.dumps(dict(zip(
            ("session", "source_file", "content", "changed"), r))) + "\n" for r in rows))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(inbox))
        ingest.start_ingest(stream, str(root), str(state), version="changed", ingest=SMALL).awaitTermination()

    first = [("s", f"d{i}.txt", f"first text {i}. " * 150, "2024-01-01T00:00:00") for i in range(5)]
    second = [("s", f"d{i}.txt", f"second text {i}. " * n, "2024-01-02T00:00:00") for i, n in ((1, 40), (3, 300))]
    arrive("a.json", *first)
    arrive("b.json", *second, ("s", "new.txt", "late", "2024-01-02T00:00:00"), first[0])
    newest = [first[0], second[0], first[2], second[1], first[4], ("s", "new.txt", "late", "")]
    columns = ["source_file", "chunk_index", "content", "start_position"]
    batch = extraction.document_chunks(spark.createDataFrame([r[:3] for r in newest], KIND))
    want = sorted(map(tuple, batch.select(columns).collect()))

    def stored():
        return sorted(map(tuple, ingest.ingested_chunks(spark, str(root)).select(columns).collect()))

    assert stored() == want
    every = ingest._read(spark, f"{root}/chunks", ingest._CHUNKS)
    assert every.count() > len(want)
    assert ingest.vacuum_chunks(spark, str(root)) == 1
    assert stored() == want
    assert ingest._read(spark, f"{root}/chunks", ingest._CHUNKS).count() == len(want)
    assert ingest.vacuum_chunks(spark, str(root)) == 0


def test_u3_versions_in_any_order_and_replayed(spark, tmp_path):
    kind = KIND + ", at timestamp"

    def rows(*some):
        return spark.createDataFrame(
            [(s, f, c, None if at is None else datetime.datetime(2024, 1, at))
             for s, f, c, at in some], kind)

    batches = [
        rows(("s", "a.txt", "a2", 2), ("t", "a.txt", "other", 1), ("s", "b.txt", "b0", None)),
        rows(("s", "a.txt", "a1", 1), ("s", "a.txt", "a3", 3), ("s", "a.txt", "a3 again", 2)),
        rows(("s", "b.txt", "b1", 1), ("s", "a.txt", "a0", 2), ("s", "c.txt", "", 9)),
        rows(("s", "b.txt", "never", None), ("t", "a.txt", "same", 1)),
    ]
    want = [("s", "a.txt", "a3"), ("s", "b.txt", "b1"), ("t", "a.txt", "other")]
    for order in ((3, 2, 1, 0), (0, 1, 1, 2, 3)):
        root = str(tmp_path / "-".join(map(str, order)))
        for batch in order:
            ingest.ingest_batch(batches[batch], batch, root, version="at", ingest=SMALL)
        found = ingest.ingested_chunks(spark, root).select("session", "source_file", "content")
        got = sorted(map(tuple, found.filter("content != ''").collect()))
        if order[0] == 3:  # equal versions: the first to come stays
            assert [g[:2] for g in got] == [w[:2] for w in want] and got[:2] == want[:2]
        else:
            assert got == want
        totals = {r.session: (r.n_documents, r.n_chunks) for r in ingest.session_totals(spark, root, SMALL).collect()}
        recount = ingest.ingested_chunks(spark, root).groupBy("session").agg(
            F.countDistinct("source_file").alias("d"), F.count(F.lit(1)).alias("c"))
        assert totals == {r.session: (r.d, r.c) for r in recount.collect()}


def test_v9_rejected_documents_are_set_apart_and_retried(spark, tmp_path):
    class Picky(HashedWords):
        def encode(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            vectors = super().encode(texts)
            vectors[[i for i, t in enumerate(texts) if "nan" in t]] = float("nan")
            return vectors

    root = str(tmp_path / "corpus")
    rows = spark.createDataFrame([
        ("s", "good.txt", "fine"), ("s", "bad.txt", "x" * 990 + ". a bad end here"), ("t", "bad.txt", "nan"),
        ("t", "good.txt", "fine")], KIND)
    for _ in range(2):  # a replay changes nothing
        ingest.ingest_batch(rows, 0, root, embedder=Picky(8), reject_failures=True)
    stored = ingest.ingested_chunks(spark, root)
    assert sorted((r.session, r.source_file) for r in stored.collect()) == [
        ("s", "good.txt"), ("t", "good.txt")]
    rejected = {(r.session, r.source_file): (r.reason, r.n_failed, r.batch_id)
                for r in ingest.rejected_documents(spark, root).collect()}
    assert rejected == {("s", "bad.txt"): ("RuntimeError: refused", 1, 0),
                        ("t", "bad.txt"): ("the vector is not finite", 1, 0)}
    ingest.retry_rejected(spark, root, 0, embedder=Picky(8))
    assert ingest.ingested_documents(spark, root).count() == 2
    ingest.retry_rejected(spark, root, 1, embedder=HashedWords(8))
    ingest.retry_rejected(spark, root, 2, embedder=HashedWords(8))
    assert ingest.ingested_documents(spark, root).count() == 4
    plain = extraction.document_chunks(rows.select("source_file", "content", "session"), keep=("session",))
    assert stored.count() == 2 and ingest.ingested_chunks(spark, root).count() == plain.count()


def test_v9_a_model_that_cannot_open_fails(spark):
    class Gone(HashedWords):
        def open(self):
            raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        spark.createDataFrame([("a",)], "t string").select(embed_or_reason("t", Gone())).collect()


def test_u3_newest_and_newer(spark):
    kind = "session string, source_file string, v int"
    rows = spark.createDataFrame([("s", "a", 1), ("s", "a", 3), ("s", "b", None), ("t", "a", 2)], kind)
    newest = corpus.newest_by_path(rows, "v")
    assert sorted(map(tuple, newest.collect()), key=str) == [("s", "a", 3), ("s", "b", None), ("t", "a", 2)]
    stored = spark.createDataFrame([("s", "a", 2), ("s", "a", 1), ("s", "b", None), ("t", "a", 2)], kind)
    assert [tuple(r) for r in corpus.newer_documents(newest, stored, "v").collect()] == [("s", "a", 3)]
    assert names_below(spark, "/no/such/folder") == []
