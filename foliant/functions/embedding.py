"""Embeddings through a pluggable batched model (V7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def strings(column: pa.Array) -> list:
    """Values of a string column; several times faster than ``to_pylist``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).tolist()


#: Bytes of text that a worker turns into Python objects at once.
SLICE_BYTES = 1 << 20


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A string column in parts of at most ``most`` bytes, a longer text alone; at least one part.

    Arrow batches are bounded by rows, and whole texts make large ones.  A worker that takes a
    part at a time needs memory for that part, whatever the batch holds.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while True:
        before = int(ends[begin - 1]) if begin else 0
        end = max(int(np.searchsorted(ends, before + most, side="right")), begin + 1)
        yield column.slice(begin, end - begin)
        begin = end
        if begin >= len(column):
            return


class Embedder(Protocol):
    """A model: ``open`` loads it once per Python worker, ``encode`` embeds a batch.

    An exception in either fails the task, so nothing of that write is
    committed (V9).
    """

    def open(self) -> None: ...

    def encode(self, texts: list[str]) -> np.ndarray: ...


#: Most words whose buckets a worker remembers.
_KNOWN_WORDS = 1 << 16


class HashedWords:
    """Hashed bag of words with unit length; needs no model files.

    Words are the maximal runs without blank, tab or line feed.  A text
    without words has the zero vector.
    """

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self.known: dict[str, int] = {}

    def open(self) -> None:
        self.known = {}

    def _bucket(self, word: str) -> int:
        bucket = self.known.get(word)
        if bucket is None:
            digest = hashlib.md5(word.encode()).digest()
            bucket = int.from_bytes(digest[:4], "big") % self.dim
            if len(self.known) < _KNOWN_WORDS:
                self.known[word] = bucket
        return bucket

    def encode(self, texts: list[str]) -> np.ndarray:
        flat = pc.replace_substring(pc.replace_substring(pa.array(texts), "\n", " "), "\t", " ")
        split = pc.split_pattern(flat, " ")
        rows = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        words = split.flatten().dictionary_encode()
        # One hash per distinct word of the batch; -1 marks the empty word.
        distinct = [self._bucket(w) if w else -1 for w in strings(words.dictionary)]
        buckets = np.array(distinct, dtype=np.int64)[words.indices.to_numpy()]
        cells = (rows * self.dim + buckets)[buckets >= 0]
        counts = np.bincount(cells, minlength=len(texts) * self.dim).astype(np.float64)
        out = counts.reshape(len(texts), self.dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)


def _as_arrow(vectors: np.ndarray) -> pa.Array:
    count, dim = vectors.shape
    flat = pa.array(np.ascontiguousarray(vectors, dtype=np.float32).ravel())
    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, flat)


def embed(text: Column | str, embedder: Embedder, truncate_dim: int | None = None,
          batch_size: int | None = None) -> Column:
    """Embed a text column; rows keep their order, so no join is needed.

    ``batch_size`` bounds the texts per model call; their bytes (``SLICE_BYTES``) bound them
    in any case.  ``truncate_dim`` keeps the first components only (V1).
    """

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder.open()
        for part in (part for batch in batches for part in slices(batch)):
            texts = [t or "" for t in strings(part)]
            step = batch_size or max(len(texts), 1)
            parts = [embedder.encode(texts[i:i + step]) for i in range(0, len(texts), step)]
            if not parts:
                yield pa.array([], pa.list_(pa.float32()))
                continue
            vectors = np.concatenate([np.asarray(p) for p in parts])
            if len(vectors) != len(texts):
                raise ValueError("the model returned another number of vectors than texts")
            yield _as_arrow(vectors[:, :truncate_dim] if truncate_dim else vectors)

    return run(F.col(text) if isinstance(text, str) else text)


def embed_or_reason(text: Column | str, embedder: Embedder, batch_size: int | None = None) -> Column:
    """``struct<embedding, reason>``: a text that the model refuses gets a reason instead (V9).

    A batch that fails is tried again text by text.  Vectors that are not finite are
    refused, too.  A model that cannot be opened fails the task.
    """
    kind = pa.struct([("embedding", pa.list_(pa.float32())), ("reason", pa.string())])

    def one(texts: list[str]) -> list[tuple]:
        try:
            vectors = np.asarray(embedder.encode(texts), dtype=np.float32)
            if len(vectors) != len(texts):
                raise ValueError("the model returned another number of vectors than texts")
        except Exception as error:  # noqa: BLE001  (whatever the model raises is the reason)
            if len(texts) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            return [found for text in texts for found in one([text])]
        finite = np.isfinite(vectors).all(axis=1)
        return [(v.tolist(), None) if ok else (None, "the vector is not finite")
                for v, ok in zip(vectors, finite)]

    @F.arrow_udf("struct<embedding:array<float>,reason:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder.open()
        for part in (part for batch in batches for part in slices(batch)):
            texts = [t or "" for t in strings(part)]
            step = batch_size or max(len(texts), 1)
            found = [row for i in range(0, len(texts), step) for row in one(texts[i:i + step])]
            yield pa.StructArray.from_arrays([
                pa.array([v for v, _ in found], pa.list_(pa.float32())),
                pa.array([r for _, r in found], pa.string())], fields=list(kind))

    return run(F.col(text) if isinstance(text, str) else text)
