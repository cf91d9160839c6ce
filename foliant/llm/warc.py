"""WARC archives with segmented records: write, read back, reassemble.

Writing: one record per page, an HTTP response whose body has chunked transfer
framing.  A page whose payload equals that of a page with a larger key becomes
a revisit record, which names the other's record and carries no payload.  A
block longer than a segment is cut: the first part keeps the record's type, the
rest are continuation records with the first one's identifier as origin, their
segment numbers, and, on the last, the total length.

Reading: files are parsed record by record; continuation records and the
records they continue are grouped by origin, ordered by segment number, checked
for gaps and against the total length, and joined; then the framing is decoded
and the payload's digest is compared with the header.  Records that were never
cut take no part in the grouping.

Records are written by the text writer with the two line ends that close a
record as its separator, so files are committed by Spark and each holds a
bounded number of records of bounded length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import stored

END = b"\r\n"
SEGMENT_BYTES = 64 << 10
RECORDS_PER_FILE = 4096
CHUNK_BYTES = 8 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- framing -----------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x" % len(part), END, part, END]
    return b"".join([*parts, b"0", END, END])


def dechunked(framed: bytes) -> bytes | None:
    """The body of chunked framing; None where the framing is broken."""
    parts, at = [], 0
    while True:
        stop = framed.find(END, at)
        if stop < 0:
            return None
        try:
            size = int(framed[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        at = stop + 2
        if size == 0:
            return b"".join(parts)
        if framed[at + size : at + size + 2] != END:
            return None
        parts.append(framed[at : at + size])
        at += size + 2


def headers_of(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(END))
    return {name.strip().lower().decode(): value.strip().decode() for name, _, value in pairs}


def http_payload(block: bytes) -> bytes | None:
    """The decoded payload of an HTTP response."""
    head, _, body = block.partition(END + END)
    framing = headers_of(head).get("transfer-encoding", "").lower()
    return dechunked(body) if framing == "chunked" else body


# -- writing -----------------------------------------------------------------


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{name}: {value}".encode() for name, value in headers)]
    lines.append(b"Content-Length: %d" % len(block))
    return END.join([*lines, b"", block])


def _records(
    key: int | None, url: str, payload: bytes, refers_to: int | None, row: int, segment_bytes: int,
) -> Iterator[bytes]:
    """The records of one page, without the line ends that close them.

    A record is named by its page and its row, so that no two rows share a name; a
    revisit names the page and payload digest of the record it refers to.
    """
    uri = "".join(url.split())
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    digest = ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")
    kind = ("Content-Type", "application/http;msgtype=response")
    head = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
                     b"Transfer-Encoding: chunked", b"", b""])
    own = f"<{URN}{'none' if key is None else key}:{row}>"
    if refers_to is not None:
        yield _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, kind, digest,
             ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")], head,
        )
        return
    block = head + chunked(payload)
    starts = range(0, len(block), segment_bytes)
    for number, at in enumerate(starts, 1):
        first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind, digest]
        rest = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{number}>"),
                *common, ("WARC-Segment-Origin-ID", own)]
        headers = first if number == 1 else rest
        if len(starts) > 1:
            headers.append(("WARC-Segment-Number", number))
        if len(starts) > 1 and number == len(starts):
            headers.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(headers, block[at : at + segment_bytes])


def write_archives(
    pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", body: str = "html",
    minimum_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write each page as a record, equal payloads of at least ``minimum_bytes`` as revisits.

    The row with the largest key is the response.  A null body is empty, a
    null address is empty.  Keys are integers or null; a null key is smaller than any other.
    Every row is a record of its own, also one that repeats the key of another; rows
    that share the largest key of a payload are all responses.  Equal payloads are found by
    their SHA-1 and length, with copies counted before they are shuffled.
    """
    rows = pages.select(
        F.col(key).cast("bigint").alias("key"), F.coalesce(url, F.lit("")).alias("url"),
        F.coalesce(body, F.lit("")).cast("binary").alias("payload"),
    )
    sums = [F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size")]
    groups = stored(
        rows.select("key", *sums).groupBy("sha1", "size")
        .agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) & (F.col("size") >= minimum_bytes))
        .drop("copies"), "equal-payloads",
    )
    decided = rows.withColumns({"sha1": sums[0], "size": sums[1]}).join(
        groups, ["sha1", "size"], "left"
    ).select(
        "key", "url", "payload",
        F.when(~F.col("keep").eqNullSafe(F.col("key")), F.col("keep")).alias("keep"),
        F.monotonically_increasing_id().alias("row"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(i) for i in range(5)))
            some, size = [], 0
            for row in columns:
                for record in _records(*(value.as_py() for value in row), segment_bytes):
                    # The writer adds the line ends that close a record.
                    some.append(record)
                    size += len(record)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["record"])
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["record"])

    decided.mapInArrow(encode, "record binary").select(
        F.col("record").cast("string").alias("value")
    ).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


# -- reading -----------------------------------------------------------------

_PARSED = (
    "record_id string, type string, origin string, segment int, total bigint, digest string, "
    "refers_to string, block binary"
)


def parse(content: bytes) -> Iterator[tuple]:
    """The records of one archive file."""
    at = 0
    while at < len(content):
        stop = content.find(END + END, at)
        if stop < 0 or not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = headers_of(content[at:stop].partition(END)[2])
        start = stop + 4
        end = start + int(headers["content-length"])
        if content[end : end + 4] != END + END:
            raise ValueError(f"the record at byte {at} has another length")
        number, total = headers.get("warc-segment-number"), headers.get("warc-segment-total-length")
        yield (
            headers["warc-record-id"], headers["warc-type"],
            headers.get("warc-segment-origin-id") or headers["warc-record-id"],
            int(number) if number else None, int(total) if total else None,
            headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            headers.get("warc-refers-to"), content[start:end],
        )
        at = end + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives, cut ones in their segments."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [part.split()[0] for part in _PARSED.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(),
             pa.string(), pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names
            )

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse(content.as_py()):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 1 << 22:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(records, _PARSED)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records from segments.

    Adds ``complete``: segments are numbered from 1 without gap or repetition
    and their lengths add up to the total.  A record that was not cut is
    complete.  One group is one record, never more; the same segment read twice
    counts once.
    """
    kept = ["type", "digest", "refers_to"]
    whole = records.filter("segment IS NULL").select(
        "record_id", *kept, "block", F.lit(True).alias("complete")
    )
    parts = records.filter("segment IS NOT NULL")
    joined = parts.groupBy("origin").agg(
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in kept),
        F.max("total").alias("total"),
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
    ).select(
        F.col("origin").alias("record_id"), *kept, "total",
        F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast(
            "binary").alias("block"),
        (F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts")))
        .alias("gapless"),
    ).select(
        "record_id", *kept, "block",
        (F.col("gapless") & (F.octet_length("block") == F.col("total"))).alias("complete"),
    )
    return whole.unionByName(joined.withColumn("complete", F.coalesce("complete", F.lit(False))))


_DECODED = (
    "record_id string, type string, refers_to string, payload_bytes bigint, "
    "payload_digest string, sound boolean, payload binary"
)


def decoded(records: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Payloads of whole records, with length and digest.

    ``sound``: the record is complete, its framing is whole, and the digest of
    the payload is the one in the header.  Revisits have no payload; their
    digest is the header's.
    """
    schema = _DECODED if with_payload else _DECODED.removesuffix(", payload binary")
    names = [part.split()[0] for part in schema.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for record_id, kind, digest, refers_to, block, complete in zip(
                *(batch.column(i) for i in range(6))
            ):
                payload = None
                if kind.as_py() != "revisit":
                    payload = http_payload(block.as_py())
                found = digest.as_py() if payload is None else payload_digest(payload)
                rows.append((
                    record_id.as_py(), kind.as_py(), refers_to.as_py(),
                    None if payload is None else len(payload), found,
                    complete.as_py() and found == digest.as_py()
                    and (payload is not None or kind.as_py() == "revisit"), payload,
                ))
                size += len(payload or b"") if with_payload else 0
                if size > 1 << 22:
                    yield _batch(rows, names)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, names)

    return records.select(
        "record_id", "type", "digest", "refers_to", "block", "complete"
    ).mapInArrow(decode, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(),
             pa.binary()]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[i], types[i]) for i in range(len(names))], names
    )


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Whole, decoded records; those that are not sound are marked, none is dropped."""
    return decoded(reassembled(read_records(spark, path)), with_payload=with_payload)


def _page(record: Column) -> Column:
    """The page number in a record's name; null where it has none."""
    found = F.regexp_extract(record, f"{URN}(-?[0-9]+)", 1)
    return F.when(found != "", found).cast("bigint")


def page_records(records: DataFrame) -> DataFrame:
    """One row per record by page number; a revisit has the length of the one it refers to.

    That is the response of the page it names with the same payload digest.  ``records`` is
    read twice, so it should be a written table.
    """
    rows = records.withColumns({
        "page_id": _page(F.col("record_id")), "refers_to": _page(F.col("refers_to")),
    }).select("page_id", "type", "refers_to", "payload_bytes", "payload_digest", "sound")
    responses = rows.filter("type = 'response'")
    revisits = rows.filter("type = 'revisit'").drop("payload_bytes").join(
        responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
            F.max("payload_bytes").alias("payload_bytes"), F.min("sound").alias("_sound"),
        ), ["refers_to", "payload_digest"], "left",
    ).withColumn("sound", F.coalesce(F.col("sound") & F.col("_sound"), F.lit(False)))
    return responses.unionByName(revisits.select(*responses.columns))
