"""SimHash fingerprints of word shingles.

A fingerprint bit is 1 if it is set in over half of the hashes of the text's
shingles.  The first 64 bits come from XXH64 with the given seed; more bits, for
wider fingerprints, from mixing that hash again.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np

#: Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 1 << 16


def shingles(words: list[bytes], size: int):
    """Space-joined runs of words, repeats included; fewer words: the whole sequence."""
    if len(words) <= size:
        if words:
            yield b" ".join(words)
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = [0, *ends[: -size].tolist()]
    view = memoryview(joined)
    for start, end in zip(starts, ends[size - 1 :].tolist()):
        yield view[start : end - 1]


def _mixed(hashes: np.ndarray, step: int) -> np.ndarray:
    """Hashes as good as independent of the given ones (the SplitMix64 finalizer)."""
    x = hashes + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes], size: int, seed: int):
    """Hashes of the shingles, repeats included, in bounded parts."""
    import xxhash

    digest, found = xxhash.xxh64_intdigest, shingles(words, size)
    while some := [digest(shingle, seed) for shingle in islice(found, SHINGLES_AT_ONCE)]:
        yield np.array(some, dtype="<u8")


def hash_set(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order."""
    parts = list(_hashes(words, size, seed))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def fingerprint(words: list[bytes], size: int, numbers: int = 1, seed: int = 42) -> np.ndarray:
    """Fingerprint as so many unsigned 64-bit numbers; no words: zeros."""
    return _print(_hashes(words, size, seed), numbers)


def set_fingerprint(hashes: np.ndarray, numbers: int = 1) -> np.ndarray:
    """The same of a set of hashes, each of which counts once."""
    parts = range(0, len(hashes), SHINGLES_AT_ONCE)
    return _print((hashes[at : at + SHINGLES_AT_ONCE] for at in parts), numbers)


def _print(parts: Iterable[np.ndarray], numbers: int) -> np.ndarray:
    counts, total = np.zeros((numbers, 64), dtype=np.int64), 0
    for hashes in parts:
        total += len(hashes)
        for i in range(numbers):
            octets = (_mixed(hashes, i) if i else hashes).view(np.uint8).reshape(-1, 8)
            counts[i] += np.unpackbits(octets, axis=1, bitorder="little").sum(
                axis=0, dtype=np.int64)
    bits = (2 * counts > total).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
