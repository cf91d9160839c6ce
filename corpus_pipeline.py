"""A training corpus from documents."""

from __future__ import annotations

from foliant.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
