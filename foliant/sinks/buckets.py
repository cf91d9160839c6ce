"""Tables bucketed by a key, so that joins on it need no shuffle of the stored side.

The folder's name keeps the key and the number of buckets, so that a session that did not
write a table can register it again.  Tables with the same key and number of buckets are
joined bucket by bucket; any other side is shuffled into the same buckets, while the stored
rows stay where they are.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from foliant.runtime import names_below

BUCKETS = 64


def write_bucketed(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Store a table in buckets of a column, each sorted by it.

    One shuffle, by the hash that tells the bucket, so every bucket is one file, written by one
    task; a table should have so many buckets that one of them fits a task.
    """
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", key):
        raise ValueError(f"no plain column name: {key!r}")
    folder = f"{path}/{key}-of-{buckets}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option(
        "path", folder).saveAsTable(_name(folder))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A bucketed table, registered in this session's catalog if it is not yet."""
    found = [re.fullmatch(r"([A-Za-z][A-Za-z0-9_]*)-of-([0-9]+)", n) for n in names_below(spark, path)]
    known = [m for m in found if m]
    if len(known) != 1:
        raise ValueError(f"no bucketed table in {path}")
    key, buckets = known[0].groups()
    folder = f"{path}/{known[0].group()}"
    if not spark.catalog.tableExists(_name(folder)):
        columns = spark.read.parquet(folder)._jdf.schema().toDDL()
        location = folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {_name(folder)} ({columns}) USING parquet CLUSTERED BY ({key}) "
            f"SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{location}'")
    return spark.table(_name(folder))


def _name(folder: str) -> str:
    return f"bucketed_{hashlib.md5(folder.encode()).hexdigest()}"
