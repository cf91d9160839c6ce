"""The stages of the corpus pipeline, and their run from documents to token ids.

Each stage takes all documents that the one before it kept, and is written as
Parquet below the shared folder.  The stages up to the last return the columns
of the documents, whatever they are; added columns never take their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.block_names import exact_duplicates
from foliant.llm.byte_bpe import WORD_WISE, coding
from foliant.llm.decontamination import contaminations
from foliant.llm.near_duplicates import STRICT, near_components
from foliant.llm.shared import lower_ascii, stored, table
from foliant.llm.toxicity import judge, train
from foliant.llm.toxicity_queries import THRESHOLD, third


ROWS_PER_BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    """Whole texts make large Arrow batches; with fewer rows both sides need less memory."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < rows <= ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; empty ones stay."""
    _small_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"), training=third() != 1)
    judged = judge(spark, model)
    return docs.filter(judged(F.col("text")).getField("score") < THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, but for the case of A-Z, the document with the largest id.

    Of repeated rows one stays.  What goes is decided on ids and digests alone; whole texts
    meet only the list of the keys that go, and those of repeated rows.
    """
    judged = stored(
        exact_duplicates(docs.select("doc_id", "text")).groupBy(
            F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")
        ).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "exact-keys")
    own = docs.select(
        F.struct("*").alias("row"), F.sha2(lower_ascii(F.col("text")), 256).alias("sha"))

    def meeting(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        same = rows["row.doc_id"].eqNullSafe(keys["_id"]) & (rows["sha"] == keys["_sha"])
        return rows.join(keys.select("_id", "_sha"), same, how)

    left = meeting(own, judged.filter("NOT kept"), "left_anti")
    repeated = judged.filter("kept AND n > 1")
    if not repeated.isEmpty():
        place = F.row_number().over(Window.partitionBy("row.doc_id", "sha").orderBy("row.doc_id"))
        once = meeting(left, repeated, "left_semi").withColumn("place", place).filter("place = 1")
        left = meeting(left, repeated, "left_anti").unionByName(once.drop("place"))
    return left.select("row.*")


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Near copies are linked by SimHash fingerprints of three words at two or fewer differing
    bits.  A document without an id yields to any that has one; of those that share an id
    the one with the smaller hash of its text stays.
    """
    _small_batches(spark)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"))
    found = near_components(docs.select(key.alias("key"), "text"), STRICT, key="key")
    kept = found.filter(F.col("key") == F.col("component_id")).select("key").distinct()
    rows = docs.select(F.struct("*").alias("row"), key.alias("own"))
    same = (rows["own.hash"] == kept["key.hash"]) & rows["own.doc_id"].eqNullSafe(kept["key.doc_id"])
    return rows.join(kept, same, "left_semi").select("row.*")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    _small_batches(spark)
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = contaminations(rows, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("contaminations") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text as little-endian unsigned 32-bit integers."""
    _small_batches(spark)
    to_ids, _ = coding(
        spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
        WORD_WISE,
    )
    return docs.select("doc_id", to_ids(F.col("text")).alias("ids")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids"
    )


STAGES = [
    ("toxicity", harmless), ("exact dedup", distinct), ("near dedup", dissimilar),
    ("decontamination", uncontaminated), ("byte-level BPE", tokens),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
