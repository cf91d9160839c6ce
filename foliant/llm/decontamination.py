"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

For each number of words that benchmark items have, windows of a document with as
many words are fingerprinted.  A window that shares no shingle with any item of its
length has similarity zero to all of them, so windows are opened only where such a
shingle occurs; this loses nothing.  Each window's SimHash comes from running bit
counts.  A multi-index over blocks of the fingerprints of the items of that length gives
the items within the radius, and nothing else does: fingerprints that differ in at
most ``radius`` bits differ in at most ``radius // blocks`` bits in one of ``blocks``
blocks, and each block is looked up with every variant of so many bits.  What is
found is verified by the weighted Jaccard similarity of the two multisets of shingles.

Documents are only scanned, whole.  Items are taken in slices of a bounded
size, each slice one scan, so a benchmark of any size goes through; what the driver and
the workers hold never exceeds a slice.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import once_per_worker, stored, words

BITS = 64


@dataclass(frozen=True)
class WindowRule:
    """Words per shingle, least similarity, Hamming radius, and blocks of the multi-index.

    The radius is far beyond the 10 bits that a similarity of 0.8 is expected
    to differ in, so that the fingerprint does not decide about near misses.
    """

    shingle: int = 5
    similarity: float = 0.8
    radius: int = 23
    blocks: int = 8
    items_per_slice: int = 20_000
    seed: int = 42


def shingle_list(tokens: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of words; fewer words: the whole sequence; none: nothing."""
    if not tokens:
        return []
    return [b" ".join(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Shared over all occurrences of shingles."""
    shared = sum((a & b).values())
    everything = sum(a.values()) + sum(b.values()) - shared
    return shared / everything if everything else 0.0


def _bits_of(shingle: bytes, seed: int) -> np.ndarray:
    import xxhash

    digest = np.frombuffer(xxhash.xxh64_digest(shingle, seed), dtype=np.uint8)
    return np.unpackbits(digest).astype(np.int32)


def _variants(width: int, flips: int) -> list[int]:
    return [
        sum(1 << i for i in some) for n in range(flips + 1) for some in combinations(range(width), n)
    ]


class ItemIndex:
    """A slice of the benchmark: shingles, fingerprints, and blocks of these."""

    def __init__(self, items: list[tuple[int, str]], rule: WindowRule):
        self.rule = rule
        self.ids = [item for item, _ in items]
        tokens = [words(text) for _, text in items]
        self.lengths = [len(t) for t in tokens]
        self.counts = [Counter(shingle_list(t, rule.shingle)) for t in tokens]
        self.vocabulary: set[bytes] = set().union(*tokens)
        #: The lengths of the items that hold a shingle.
        self.with_shingle: dict[bytes, set[int]] = defaultdict(set)
        for length, counts in zip(self.lengths, self.counts):
            for shingle in counts:
                self.with_shingle[shingle].add(length)
        self.width = BITS // rule.blocks
        self.variants = _variants(self.width, rule.radius // rule.blocks)
        self.prints = [self.fingerprint(counts) for counts in self.counts]
        #: For each length and block, the items by their bits there.
        self.by_block: dict[int, list[dict[int, set[int]]]] = {
            length: [defaultdict(set) for _ in range(rule.blocks)] for length in set(self.lengths)
        }
        for i, (length, number) in enumerate(zip(self.lengths, self.prints)):
            for block, found in enumerate(self.by_block[length]):
                found[self.block(number, block)].add(i)

    def block(self, number: int, block: int) -> int:
        return (number >> (block * self.width)) & ((1 << self.width) - 1)

    def number(self, counts: np.ndarray, total: int) -> int:
        return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")

    def fingerprint(self, shingles: Counter) -> int:
        counts = sum(
            (n * _bits_of(s, self.rule.seed) for s, n in shingles.items()),
            np.zeros(BITS, dtype=np.int32),
        )
        return self.number(counts, sum(shingles.values()))

    def within_radius(self, number: int, length: int) -> list[int]:
        """All items of a length whose fingerprints are within the radius."""
        near = set()
        for block, found in enumerate(self.by_block[length]):
            own = self.block(number, block)
            for variant in self.variants:
                near |= found.get(own ^ variant, set())
        return [
            i for i in sorted(near)
            if (self.prints[i] ^ number).bit_count() <= self.rule.radius
        ]

    def hits(self, tokens: list[bytes]) -> dict[int, set[int]]:
        """By length, positions in a document of shingles that items of that length hold."""
        size, found = self.rule.shingle, defaultdict(set)
        known = self.vocabulary
        inside = np.fromiter(map(known.__contains__, tokens), dtype=bool, count=len(tokens))
        for run in {min(size, n) for n in self.lengths if n}:
            if len(tokens) < run:
                continue
            runs = np.concatenate([[0], np.cumsum(inside)])
            for at in np.flatnonzero(runs[run:] - runs[:-run] == run).tolist():
                for length in self.with_shingle.get(b" ".join(tokens[at : at + run]), ()):
                    if min(size, length) == run:
                        found[length].add(at)
        return found

    def windows(self, count: int, length: int, at: set[int]) -> list[int]:
        """First words of the windows that hold one of the shingles."""
        reach = length - min(self.rule.shingle, length)
        last = max(0, count - length)
        return sorted({
            start for p in at for start in range(max(0, p - reach), min(last, p) + 1)
        })

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item found."""
        tokens = words(text)
        if not tokens:
            return []
        size, best = self.rule.shingle, {}
        bits: dict[int, np.ndarray] = {}  # of the shingle that begins at a word

        def shingle(at: int, length: int) -> bytes:
            return b" ".join(tokens[at : at + min(size, length)])

        for of_items, at in self.hits(tokens).items():
            length = min(of_items, len(tokens))
            steps = max(1, length - size + 1)
            running, previous = None, None
            for start in self.windows(len(tokens), of_items, at):
                if previous is not None and start == previous + 1 and length >= size:
                    running = running - bits[previous]
                    fresh = [start + steps - 1]
                else:
                    running, fresh = np.zeros(BITS, dtype=np.int32), range(start, start + steps)
                for p in fresh:
                    if p not in bits or length < size:
                        bits[p] = _bits_of(shingle(p, length), self.rule.seed)
                    running = running + bits[p]
                previous, own = start, None
                for item in self.within_radius(self.number(running, steps), of_items):
                    if own is None:
                        own = Counter(shingle(p, length) for p in range(start, start + steps))
                    score = weighted_jaccard(own, self.counts[item])
                    if score >= self.rule.similarity and (
                        item not in best or score > best[item][2]
                    ):
                        best[item] = (start, length, score)
            bits.clear()
        return [(self.ids[i], *found) for i, found in sorted(best.items())]


def _slices(items: DataFrame, key: str, text: str, per_slice: int) -> tuple[int, Iterator[list]]:
    """The number of bounded slices of the items, and these, one at a time on the driver."""
    rows = stored(
        items.select(key, F.coalesce(text, F.lit("")).alias(text)).filter(F.length(text) > 0),
        "benchmark-items",
    )
    # Half full on average, so that uneven hashing stays within the bound.
    n = 1 if (count := rows.count()) <= per_slice else -(-2 * count // per_slice)
    slot = F.pmod(F.xxhash64(key, text), F.lit(n))
    return n, (sorted(tuple(row) for row in rows.filter(slot == i).collect()) for i in range(n))


_FOUND = "array<struct<item:bigint,start:int,n_words:int,similarity:double>>"


def _matcher(sent: Broadcast, name: tuple, rule: WindowRule):
    """Column function for one slice of the items."""

    @F.arrow_udf(_FOUND)
    def match(texts: pa.Array) -> pa.Array:
        index = once_per_worker(name, lambda: ItemIndex(sent.value, rule))
        names = ("item", "start", "n_words", "similarity")
        return pa.array(
            [[dict(zip(names, m)) for m in index.matches(t.as_py())] for t in texts],
            type=pa.list_(pa.struct([
                ("item", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()),
                ("similarity", pa.float64()),
            ])),
        )

    return match


def contaminations(
    docs: DataFrame, items: DataFrame, rule: WindowRule = WindowRule(), *, text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` with ``contaminations``: item, first word, words and similarity of each match.

    Of an item's windows the most similar counts, of ties the first.  Null and
    empty texts match nothing, and so do items without words.  A column of the name
    ``contaminations`` is replaced.  Rows with repeated keys are judged each by its
    text, and items that repeat are found each.  Where items make several slices, the
    documents are scanned once for each and written in between.
    """
    context = docs.sparkSession.sparkContext
    found = docs.withColumn("contaminations", F.array().cast(_FOUND))
    count, slices = _slices(items, item_key, item_text, rule.items_per_slice)
    for some in slices:
        if not some:
            continue
        sent = context.broadcast(some)
        match = _matcher(sent, ("benchmark", hash(tuple(some)), rule), rule)
        found = found.withColumn("contaminations", F.concat("contaminations", match(F.col(text))))
        if count > 1:
            found = stored(found, "scanned-documents")
            sent.destroy()
    return found
