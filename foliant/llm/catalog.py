"""All queries on the training-data operators."""

from __future__ import annotations

from foliant.llm import (  # noqa: F401  (importing a module registers its queries)
    audit_queries,
    bpe_queries,
    class_queries,
    dedup_queries,
    leak_queries,
    mining_queries,
    minhash_queries,
    near_queries,
    shard_queries,
    token_queries,
    toxicity_queries,
    url_queries,
    warc_queries,
)
from foliant.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
