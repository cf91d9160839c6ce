"""Steps whose cost must not grow with the rows of a batch or the number of files."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from foliant.config import ChunkingConfig
from foliant.functions import embedding
from foliant.operators.chunking import chunk_documents, spans_table, with_drifting_positions
from foliant.operators.session_index import session_index
from foliant.runtime import gathered
from foliant.sinks import writers
from foliant.sources import files, readers


def test_document_files(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(600)] + [(3, "again"), (700, None), (701, "ä\nb")]
    path = f"file://{tmp_path}/files"
    writers.write_files(spark.createDataFrame(rows, "doc_id long, value string"), path, "doc_id")
    folders = list((tmp_path / "files").iterdir())
    assert len(folders) <= 256  # not one per document, which takes a listing each
    found = readers.read_documents(spark, path)
    files = {r.source_file.rsplit("/", 1)[1]: r.content for r in found.collect()}
    assert len(files) == 602
    assert files["doc_id=5.txt"] == "text 5\n" and files["doc_id=700.txt"] == "\n"
    assert sorted(files["doc_id=3.txt"].split("\n")) == ["", "again", "text 3"]
    assert files["doc_id=701.txt"] == "ä\nb\n"


def test_scan_of_many_files_has_few_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 50 * cores)
    assert gathered(many).rdd.getNumPartitions() <= 8 * cores
    assert gathered(many).count() == 10
    assert gathered(spark.range(0, 10, 1, 2)).rdd.getNumPartitions() == 2


def test_driver_holds_no_list_of_many_files(spark, tmp_path):
    for i in range(10_100):
        if i < 20:
            (tmp_path / f"in/{i}").mkdir(parents=True)
        (tmp_path / f"in/{i % 20}/{i}.md").write_bytes(b"text %d" % i * (1 + i % 9))
    config = ChunkingConfig(max_file_size_mb=64 / 1024 / 1024)
    found = readers.read_documents(spark, f"{tmp_path}/in", config)
    assert len(found.inputFiles()) < 1000  # Spark's scan names every file there
    rows = {r.source_file: r for r in found.collect()}
    assert len(rows) == sum(len(f"text {i}") * (1 + i % 9) <= 64 for i in range(10_100))
    one = rows[f"file:{tmp_path}/in/1/10001.md"]
    assert (one.content, one.size, one.file_type) == ("text 10001" * 3, 30, "md")
    assert found.schema == readers.read_documents(spark, f"{tmp_path}/in/7", config).schema


def test_tasks_list_files_as_spark_does(spark, tmp_path):
    names = (
        "a.txt", "_hidden.txt", "_k=v.txt", ".dot.txt", "c.txt._COPYING_", "_metadata", "_metadata_x/in.txt",
        "_metadata_x/_metadata", "_folder/z.txt", ".d/z.txt", "_k=1/z.txt", "sub/deep/er/e.txt",
        "sp ace/%41 b.txt", "plus+/h#a?s&h.txt", "[br]/{c}.txt", "é/ü.txt", "new\nline.txt", "d._COPYING_/f.txt")
    root = tmp_path / "in"
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() + b"\0\xff\r\n")
    (root / "empty.txt").write_bytes(b"")
    (root / "nothing").mkdir()
    (root / "big.txt").write_bytes(b"x" * 101)
    (root / "edge.txt").write_bytes(b"x" * 100)
    for link, target in (("link.txt", "a.txt"), ("broken.txt", "none"), ("loop", "loop"), ("folder", "sub")):
        (root / link).symlink_to(target)
    os.utime(root / "a.txt", ns=(0, 1_700_000_000_123_999_999))

    def rows(df):
        return sorted(map(tuple, df.select("path", "modificationTime", "length", "content").collect()))

    for paths in ([f"{root}"], [f"file://{root}/sub/.."], [f"{root}/sub/", f"file:{root}", f"{root}/sub"]):
        scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        folders = files.local_folders(spark, paths)
        assert rows(files.read_files(spark, folders, 100)) == rows(scan.filter("length <= 100"))
    for paths in ([f"{root}/*"], [f"{root}/a.txt"], [f"{root}", f"{root}/none"], [""]):
        assert files.local_folders(spark, paths) is None  # left to Spark's scan


def test_looks_at_a_bounded_number_of_files(spark, tmp_path):
    for name in ("a/b/1", "a/b/2", "a/3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    folders = files.local_folders(spark, [str(tmp_path / "a")])
    assert files.hold_more_than(folders, 3) and not files.hold_more_than(folders, 4)
    assert not files.hold_more_than([f"file:{tmp_path}/none"], 0)


def test_slices():
    texts = ["aä" * 40, None, "", "x" * 500, "b", None, "c" * 99]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
        parts = list(embedding.slices(column, 100))
        assert [t for p in parts for t in p.to_pylist()] == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 100
                   for p in parts)
        assert len(parts) > 2
    assert [len(p) for p in embedding.slices(pa.array([], pa.string()))] == [0]


def test_model_calls_are_bounded_by_bytes(spark):
    class Counting(embedding.HashedWords):
        def encode(self, texts):
            if sum(map(len, texts)) > 1 << 20:
                raise ValueError("too much at once")
            return super().encode(texts)

    rows = spark.range(40).select(F.repeat(F.lit("some words "), 10_000).alias("text")).coalesce(1)
    assert rows.select(embedding.embed("text", Counting(8)).alias("e")).filter("size(e) = 8").count() == 40
    tried = rows.select(embedding.embed_or_reason("text", Counting(8)).alias("r"))
    assert tried.filter("r.reason IS NULL").count() == 40


def test_whole_texts_go_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    documents = spark.createDataFrame([("a.txt", "some text")], "source_file string, content string")
    try:
        for step in (chunk_documents, spans_table, with_drifting_positions):
            spark.conf.set(key, "10000")
            assert step(documents).count() == 1
            assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)


def test_index_rows_are_assigned_once(spark):
    rows = spark.createDataFrame(
        [("s", f"c{i}", [float(i % 3), 1.0]) for i in range(9)],
        "session string, id string, embedding array<float>")
    index = session_index(rows)
    assert "FlatMapCoGroups" not in index._jdf.queryExecution().optimizedPlan().toString()
    assert index.count() == 9 and index.filter("centre").count() == 9
