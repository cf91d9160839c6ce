"""Files of local folders, listed and read by tasks: the driver holds no list of them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import shared_dir, tasks_for, written

_SCHEME = "file:"
_ROWS_PER_BATCH = 10_000
_BYTES_PER_BATCH = 4 << 20
_LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])
_READ = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("length", pa.int64()),
                   ("content", pa.binary())])


def local_folders(spark: SparkSession, paths: list[str]) -> list[str] | None:
    """The paths as Hadoop writes them; None if one of them is a pattern or no local folder.

    None too on a cluster without a shared folder, where the list could not be kept.
    """
    try:
        shared_dir(spark)
    except ValueError:
        return None
    folders = []
    for path in paths:
        if not path or any(c in path for c in "{}[]*?\\"):
            return None
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
        if not folder.startswith(f"{_SCHEME}/") or not os.path.isdir(folder.removeprefix(_SCHEME)):
            return None
        folders.append(folder)
    return folders


def hold_more_than(folders: list[str], most: int) -> bool:
    """True if there are more files and folders below; looks at no more than that many."""
    pending, seen = list(folders), 0
    while pending:
        try:
            with os.scandir(pending.pop().removeprefix(_SCHEME)) as entries:
                for entry in entries:
                    seen += 1
                    if seen > most:
                        return True
                    if entry.is_dir():
                        pending.append(entry.path)
        except OSError:
            return False  # for Spark's listing to report
    return False


def _is_read(name: str, folder: bool) -> bool:
    """The names that Spark's listing goes on with."""
    if name.startswith(".") or name.startswith("_") and "=" not in name:
        return folder and name.startswith(("_metadata", "_common_metadata"))
    return not name.endswith("._COPYING_")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def entries() -> Iterator[tuple[str, bool, int]]:
        for batch in batches:
            for parent in batch.column(0).to_pylist():
                with os.scandir(parent.removeprefix(_SCHEME)) as found:
                    for entry in found:
                        try:
                            entry.name.encode()
                            folder, size = entry.is_dir(), entry.stat().st_size
                        except (OSError, UnicodeEncodeError):
                            continue  # a link to nowhere, or a name that Java cannot open
                        if _is_read(entry.name, folder) and (folder or size):
                            yield f"{parent.rstrip('/')}/{entry.name}", folder, 0 if folder else size

    rows = entries()
    while part := list(islice(rows, _ROWS_PER_BATCH)):
        yield _batch(part, _LISTED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)


def read_files(spark: SparkSession, folders: list[str], max_bytes: int) -> DataFrame:
    """All files of a size below the folders, at any depth, with the columns of Spark's binary file source.

    Which files there are is found once, level by level, and kept as a table below the shared
    folder.  Names count, links are followed and empty files left out as Spark's own listing does; a
    file is opened only if it has at most ``max_bytes``.
    """
    level = spark.createDataFrame([(folder,) for folder in folders], "path string")
    below, levels, size = len(folders), [], 0
    while below:
        dealt = level.select("path").repartition(min(below, tasks_for(spark, 0)), "path")
        found = written(dealt.mapInArrow(_list, "path string, folder boolean, size bigint"), "file-list")
        below, more = found.agg(F.count_if("folder"), F.coalesce(F.sum("size"), F.lit(0))).first()
        levels.append(found.filter(~F.col("folder")).select("path"))
        level, size = found.filter("folder"), size + more
    paths = reduce(DataFrame.union, levels).repartition(tasks_for(spark, size), "path")
    if len(folders) > 1:
        paths = paths.dropDuplicates(["path"])  # one may lie below another
    ignored = [spark.conf.get(f"spark.sql.files.ignore{kind}Files") == "true"
               for kind in ("Missing", "Corrupt")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(path.removeprefix(_SCHEME), "rb") as file:
                        status = os.fstat(file.fileno())
                        if status.st_size > max_bytes:
                            continue
                        content = file.read()
                except OSError as error:
                    if not ignored[not isinstance(error, FileNotFoundError)]:
                        raise
                    continue
                rows.append((path, status.st_mtime_ns // 1_000_000, status.st_size, content))
                held += len(content)
                if held >= _BYTES_PER_BATCH or len(rows) == _ROWS_PER_BATCH:
                    yield _batch(rows, _READ)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _READ)

    files = paths.mapInArrow(read, "path string, modified bigint, length bigint, content binary")
    return files.withColumnRenamed("modified", "modificationTime").withColumn(
        "modificationTime", F.timestamp_millis("modificationTime"))
