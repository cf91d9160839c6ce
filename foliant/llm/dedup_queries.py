"""Query on exact duplicates."""

from __future__ import annotations

from foliant.llm.block_names import exact_duplicates
from foliant.llm.registry import query
from foliant.llm.shared import LOWER, UPPER, table

_SQL = f"""
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents
), groups AS (
    SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM texts JOIN groups USING (text)
"""


@query("op2_block_naming", _SQL)
def op2_block_naming(spark, sf_dir):
    """Exact duplicates among the whole texts of all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
