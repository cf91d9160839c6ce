"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    Cuts the lineage, survives lost executors, and fixes values that a second
    evaluation could give differently.  The folder belongs to the session.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    Where every character is one byte, ``lower`` does just that and is faster.
    """
    filled = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(filled) == F.char_length(filled), F.lower(filled)).otherwise(
        F.translate(filled, UPPER, LOWER)
    )


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def once_per_worker(key: tuple, build: Callable[[], object]):
    """An object built once in each Python worker process and kept for its later tasks.

    The last one only, so that the next operator's tasks find its memory free.
    """
    kept = sys.modules.setdefault(
        "foliant_worker_objects", types.ModuleType("foliant_worker_objects")
    ).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = build()
    return kept[key]
