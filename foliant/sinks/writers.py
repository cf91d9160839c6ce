"""Write tables, documents and exports, partitioned by session."""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.config import SavePolicy
from foliant.runtime import names_below, remove

_SAVED = "_saved_at"
_MARKS = "session string, deleted_at bigint, name string"
_SORT = ("session", "section", "key", "place")


def _balanced(df: DataFrame) -> DataFrame:
    """Let adaptive execution split big sessions and join small ones before a write.

    A folder cannot tell an empty name from a missing one, so it is refused.
    """
    named = F.when(F.col("session") == "", F.raise_error(F.lit("a session has an empty name")))
    return df.withColumn("session", named.otherwise(F.col("session"))).hint("rebalance", "session")


def write_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """JSON documents, one per line, below ``session=…`` folders (K1–K3)."""
    _balanced(documents.select("session", "value")).write.mode(mode).partitionBy("session").text(path)


def write_export(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export lines in order (K4): a session's files read by name make its text.

    Sorted by ranges over the cluster, so a large session spans several files.
    """
    ordered = lines.repartitionByRange(*_SORT).sortWithinPartitions(*_SORT)
    ordered.select("session", F.col("line").alias("value")).write.mode(mode).partitionBy(
        "session"
    ).text(path)


_FOLDERS = 256


def write_files(rows: DataFrame, path: str, key: str) -> None:
    """A text file for each value of ``key``, with a line for each ``value`` of its rows (K4).

    Files are named ``<key>=<its value>`` and lie in a bounded number of folders, which are listed
    much faster than a folder per file.  Tasks write them one after another through Arrow,
    since Spark's writer has the driver move every file, and starts two processes for each on
    a local disk; it is taken where Arrow does not know the file system.  A file gets its name
    when it is complete, so a repeated task writes the same files.
    """
    dealt = rows.select(key, "value").repartition(key).sortWithinPartitions(key)
    try:
        FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        dealt.write.partitionBy(key).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(path)
        made, out, names, count = set(), None, (), 0

        def close() -> None:
            if out:
                out.close()
                system.move(*names)

        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                label = "__HIVE_DEFAULT_PARTITION__" if own is None else str(own)
                folder = f"{root}/{zlib.crc32(label.encode()) % _FOLDERS}"
                name = f"{folder}/{key}={label}.txt"
                if out is None or names[1] != name:
                    close()
                    if folder not in made:
                        system.create_dir(folder)
                        made.add(folder)
                    names, count = (f"{folder}/.{uuid.uuid4().hex}", name), count + 1
                    out = system.open_output_stream(names[0])
                if value.is_valid:
                    out.write(value.as_buffer())
                out.write(b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    dealt.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def write_rows(rows: DataFrame, path: str, file_format: str, mode: str = "errorifexists") -> None:
    """Flat exports as json or csv (K5)."""
    if file_format == "json":
        _balanced(rows).write.mode(mode).partitionBy("session").json(path)
    elif file_format == "csv":
        # Quotes are doubled, as csv readers expect.
        _balanced(rows).write.mode(mode).partitionBy("session").csv(
            path, header=True, escape='"', quoteAll=True
        )
    else:
        raise ValueError(f"unknown export format {file_format!r}")


def write_table(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Columnar chunk table with embeddings (K6)."""
    _balanced(chunks).write.mode(mode).partitionBy("session").parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """A table below ``session=…`` folders; the names are strings as they were written."""
    found = spark.read.parquet(path).schema
    fields = [f for f in found.fields if f.name != "session"]
    return spark.read.schema(T.StructType([*fields, T.StructField("session", T.StringType())])
                             ).parquet(path)


def _now() -> int:
    return time.time_ns()


def save(operation: str, tables: dict[str, DataFrame], root: str,
         policy: SavePolicy = SavePolicy(), only: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """Write the tables an operation saves; returns their names (K7).

    A table holds the whole state of its sessions, and takes the place of what
    was saved of them before; other sessions stay as they are.  The sessions are those of
    the metadata: one of them without rows in another table, say an emptied chat, is
    marked as empty there.  All tables of the operation have to be given, or of those named
    by ``only``; a missing one is an error, before anything is written.
    """
    names = tuple(n for n in policy.tables(operation) if only is None or n in only)
    missing = [name for name in names if name not in tables]
    if missing:
        raise ValueError(f"{operation} saves {', '.join(missing)} too, but got no such table")
    for name in names:
        saved = tables[name].withColumn(_SAVED, F.lit(_now()))
        if name != "metadata" and "metadata" in tables:
            _mark_emptied(name, saved, tables["metadata"], root)
        _balanced(saved).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("session").parquet(f"{root}/{name}")
    return names


def _mark_emptied(name: str, saved: DataFrame, metadata: DataFrame, root: str) -> None:
    """Mark the sessions that had rows in a table and have none any more."""
    spark = saved.sparkSession
    if not names_below(spark, f"{root}/{name}"):
        return
    before = read_sessions(spark, f"{root}/{name}").select("session").distinct()
    now = metadata.select("session").distinct().join(
        saved.select("session").distinct(), "session", "left_anti")
    marks = before.join(now, "session", "left_semi").select(
        "session", F.lit(_now()).alias("deleted_at"), F.lit(name).alias("name"))
    if not marks.isEmpty():
        marks.write.mode("append").parquet(f"{root}/deleted_sessions")


def delete_session(spark: SparkSession, root: str, session_id: str) -> None:
    """Mark a session as deleted (U2); its files stay, readers leave them out.

    What is saved under the name afterwards is a new session.
    """
    marked = spark.createDataFrame([(session_id, _now(), None)], _MARKS)
    marked.write.mode("append").parquet(f"{root}/deleted_sessions")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A saved table without what was saved of a session before it was deleted."""
    table = read_sessions(spark, f"{root}/{name}")
    try:
        marks = spark.read.schema(_MARKS).parquet(f"{root}/deleted_sessions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return table.drop(_SAVED)
    # A mark without a table's name holds for all tables.
    last = marks.filter(F.coalesce(F.col("name") == name, F.lit(True))).groupBy(
        F.col("session").alias("_session")).agg(F.max("deleted_at").alias("_deleted"))
    gone = (table.session == last["_session"]) & (table[_SAVED] <= last["_deleted"])
    return table.join(last, gone, "left_anti").drop(_SAVED)


def vacuum(spark: SparkSession, root: str, older_than_seconds: float = 7 * 24 * 3600) -> int:
    """Remove the files that deleted sessions left behind, and their marks; the number of files.

    Only marks of at least that age count, so readers and saves that began before have ended.
    Others may go on meanwhile: single files are removed, those all of whose rows were saved
    before the mark, and never a folder, so a session that is saved anew under the
    same name keeps its files; marks that come in meanwhile are in files of their own.
    """
    limit = _now() - int(older_than_seconds * 1e9)
    if not names_below(spark, f"{root}/deleted_sessions"):
        return 0
    marks = spark.read.schema(_MARKS).parquet(f"{root}/deleted_sessions")
    read, old = marks.inputFiles(), marks.filter(F.col("deleted_at") <= limit)
    removed = 0
    for name in names_below(spark, root):
        if name == "deleted_sessions" or not any(
                n.startswith("session=") for n in names_below(spark, f"{root}/{name}")):
            continue
        last = old.filter(F.coalesce(F.col("name") == name, F.lit(True))).groupBy(
            F.col("session").alias("_session")).agg(F.max("deleted_at").alias("_deleted"))
        files = read_sessions(spark, f"{root}/{name}").select(
            "session", _SAVED, F.col("_metadata.file_path").alias("file")).groupBy(
            "file", "session").agg(F.max(_SAVED).alias("saved"))
        dead = files.join(last, (F.col("session") == F.col("_session"))
                          & (F.col("saved") <= F.col("_deleted")), "left_semi")
        for row in dead.select("file").toLocalIterator():
            removed += remove(spark, row.file)
    young = marks.filter(F.col("deleted_at") > limit)
    if not young.isEmpty():
        young.coalesce(1).write.mode("append").parquet(f"{root}/deleted_sessions")
    for file in read:
        remove(spark, file)
    return removed
