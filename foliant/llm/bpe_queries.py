"""Query on byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from foliant.llm.byte_bpe import WORD_WISE, coding
from foliant.llm.registry import query
from foliant.llm.shared import table


@query("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    """Ids of every whole text, and the bytes they decode to, as digests."""
    to_ids, to_bytes = coding(
        spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
        WORD_WISE,
    )
    ids = table(spark, sf_dir, "documents").select("doc_id", to_ids(F.col("text")).alias("ids"))
    return ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(to_bytes(F.col("ids")), 256).alias("decoded_sha256"),
    )
