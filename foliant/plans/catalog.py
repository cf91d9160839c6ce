"""All named queries."""

from __future__ import annotations

from foliant.plans import (  # noqa: F401  (importing a module registers its queries)
    chunk_queries,
    corpus_queries,
    retrieval_queries,
    sink_queries,
    text_queries,
)
from foliant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
