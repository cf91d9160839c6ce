"""Query on web archives."""

from __future__ import annotations

from foliant.llm.registry import query
from foliant.llm.shared import stored, table
from foliant.llm.warc import page_records, read_archives, write_archives
from foliant.runtime import fresh_path


#: Base32 of a hexadecimal SHA-1: its 160 bits in groups of five.
_BITS = (
    "array_to_string(list_transform(string_split(sha1(html), ''), "
    "lambda c: right('000' || bin(instr('0123456789abcdef', c) - 1), 4)), '')"
)
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + list_sum(list_transform(range(5), lambda j: "
    "substr(bits, (5 * i + j + 1)::BIGINT, 1)::INTEGER * (16 >> j)))::BIGINT, 1)), '')"
)
_SQL = f"""
WITH filled AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), digests AS (
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BITS} AS bits,
        max(page_id) OVER (PARTITION BY html) AS keep FROM filled
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN keep <> page_id THEN keep END AS refers_to, true AS sound
FROM digests
"""


@query("op1_warc_segments", _SQL)
def op1_warc_segments(spark, sf_dir):
    """Archive all pages and describe each from the archives."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = stored(read_archives(spark, path, with_payload=False), "warc-records")
    return page_records(records).withColumnRenamed("type", "record_type")
