"""Query on token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from foliant.llm.registry import query
from foliant.llm.shared import table
from foliant.llm.token_files import ids_crc32, with_start, write_tokens
from foliant.runtime import fresh_path

END_ID = 2


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    """Write the ids of every whole text, and describe each document from the files."""
    path = fresh_path(spark, "tokens")
    write_tokens(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"),
        end_id=END_ID,
    )
    return with_start(spark, path).select(
        "doc_id", "start", F.col("n_tokens").cast("bigint").alias("n_tokens"),
        ids_crc32()("tokens").alias("ids_crc32"),
    )
