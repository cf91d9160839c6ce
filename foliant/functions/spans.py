"""The sequential chunk scan (G1) as an Arrow function.

Where a chunk starts depends on where the one before it broke, so the scan
cannot be written as a set operation.  It is a small state machine over one
text; Spark splits the documents over tasks and hands them over in Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.config import ChunkingConfig
from foliant.functions.embedding import slices, strings

SPANS_TYPE = "array<struct<start:bigint,end:bigint,content:string>>"
_ARROW_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("content", pa.string())])

_WORD_STOPS = " \n.!?\t"
_BLANKS = " \n\t"
_SENTENCE_ENDS = tuple(mark + blank for mark in ".!?" for blank in " \n")


def iter_spans(text, size: int, overlap: int, separators) -> Iterator[tuple[int, int]]:
    """Half-open spans of one text; ``text`` and ``separators`` are str or bytes alike.

    Every search is bounded by the current chunk, so the scan is linear in
    the text.  A step whose overlap would not move the start forward drops
    the overlap, so the scan always ends.
    """
    n = len(text)
    if n <= size:
        yield 0, n
        return
    if isinstance(text, bytes):
        space, stops, blanks = b" ", _WORD_STOPS.encode(), _BLANKS.encode()
        sentence_ends = tuple(s.encode() for s in _SENTENCE_ENDS)
    else:
        space, stops, blanks = " ", _WORD_STOPS, _BLANKS
        sentence_ends = _SENTENCE_ENDS
    start = 0
    while True:
        end = _break_point(text, start, size, separators, space)
        yield start, end
        if end >= n:
            return
        start = _next_start(text, start, end, overlap, stops, blanks, sentence_ends)


def _break_point(text, start, size, separators, space):
    limit = start + size
    if limit >= len(text):
        return len(text)
    found = limit
    for separator in separators:
        at = text.rfind(separator, start + 1, limit + len(separator))
        if at >= 0:
            found = at + len(separator)
            break
    if found == limit:
        at = text.rfind(space, start + 1, limit + 1)
        if at >= 0:
            found = at + 1
    return found


def _next_start(text, start, end, overlap, stops, blanks, sentence_ends):
    at = end - min(overlap, end - start - 1)
    if at < len(text):
        while at > start and text[at] not in stops:
            at -= 1
        if text[at] in blanks:
            at += 1
        # Prefer a sentence start among the last 100 positions.  Positions
        # below 100 are never looked at: fixed behaviour of the algorithm.
        if at > start + 50 and at >= 100:
            floor = max(start, at - 100)
            sentence = max(text.rfind(s, floor + 1, at + 2) for s in sentence_ends)
            if sentence >= 0:
                at = sentence + 2
    return end if at <= start or at >= end else at


def _span_array(texts: pa.Array, config: ChunkingConfig) -> pa.Array:
    as_bytes = config.unit == "bytes"
    separators = [s.encode() if as_bytes else s for s in config.separators]
    offsets, starts, ends, contents = [0], [], [], []
    for text in strings(texts):
        if text is not None:
            if as_bytes:
                text = text.encode()
            for start, end in iter_spans(text, config.chunk_size, config.chunk_overlap, separators):
                starts.append(start)
                ends.append(end)
                piece = text[start:end]
                contents.append(piece.decode("utf-8", "replace") if as_bytes else piece)
        offsets.append(len(starts))
    values = pa.StructArray.from_arrays(
        [pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(contents, pa.string())],
        fields=list(_ARROW_SPAN),
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def chunk_spans(text: Column | str, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """Chunk spans with their raw content, ``array<struct<start,end,content>>`` (G1).

    The content comes back with the offsets because cutting many pieces out
    of one long string in the JVM would scan it from its start for each.
    """

    @F.arrow_udf(SPANS_TYPE)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in slices(texts):
                yield _span_array(part, config)

    return spans(F.col(text) if isinstance(text, str) else text)


def drifting_positions(text: Column, pieces: Column) -> Column:
    """Start positions found by searching each piece after the end of the last one.

    Chunks overlap, so such positions drift behind the true ones; they are
    kept for comparison with stored corpora that hold them.
    """

    @F.arrow_udf("array<bigint>")
    def positions(texts: pa.Array, piece_lists: pa.Array) -> pa.Array:
        out = []
        for whole, found in zip(strings(texts), piece_lists.to_pylist()):
            if whole is None or found is None:
                out.append(None)
                continue
            at, row = 0, []
            for piece in found:
                hit = whole.find(piece, at)
                begin = hit if hit >= 0 else at
                row.append(begin)
                at = begin + len(piece)
            out.append(row)
        return pa.array(out, pa.list_(pa.int64()))

    return positions(text, pieces)
