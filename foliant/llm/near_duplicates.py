"""Near duplicates: SimHash fingerprints, linked by a trie self-join, in components.

Where a rule asks for a similarity, such links only choose candidates, and the
sets of shingles of all members of a component decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.binary_trie import BITS, KEYS_PER_GROUP, trie_links
from foliant.llm.components import components
from foliant.llm.shared import stored, words
from foliant.llm.simhash import fingerprint, hash_set, set_fingerprint
from foliant.llm.similar_sets import ELEMENTS_PER_GROUP, exact_links

#: Texts that share a slice beyond which all of them are candidates of each other.
CROWD = 1024


@dataclass(frozen=True)
class NearRule:
    """What counts as near.

    Texts are linked if some slice of their fingerprints differs in at most
    ``budget`` bits and, where ``radius`` is given, the whole fingerprints in at
    most so many.  Each of the fingerprint's 64-bit ``numbers`` is cut into slices
    of ``bits`` bits, and each slice is joined by a trie of its own.

    With ``similarity``, fingerprints are those of sets of shingles, links between
    them choose candidates, and texts are linked if their sets have this Jaccard
    similarity or more.
    """

    shingle: int = 3
    numbers: int = 1
    bits: int = BITS
    budget: int = 2
    radius: int | None = None
    seed: int = 42
    similarity: float | None = None

    def slices(self) -> list[tuple[int, int]]:
        """(number, first bit) of each slice."""
        return [(n, at) for n in range(self.numbers) for at in range(0, BITS, self.bits)]


#: Fingerprints of 64 bits over three words, linked at two or fewer differing bits.
STRICT = NearRule()


def similar(similarity: float = 0.8, *, shingle: int = 5, numbers: int = 8) -> NearRule:
    """A rule for texts whose sets of shingles have this Jaccard similarity or more.

    The share of differing fingerprint bits estimates the angle between the
    shingle vectors, whose cosine is 2J / (1 + J); 64 bits are too few for that,
    ``numbers`` times as many give the share to within about a percent.  The
    radius lies four standard deviations beyond the expected one, and what is too
    far apart in spite of it is told by the exact similarity.  A slice of 32
    bits with a budget of three finds 27 % of the pairs at 0.8 and 57 % at 0.9;
    all sixteen of them 99.4 % and all.
    """
    bits = BITS * numbers
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = round(bits * share + 4 * math.sqrt(bits * share * (1 - share)))
    return NearRule(shingle, numbers, 32, 3, radius, similarity=similarity)


def fingerprints(text: Column, rule: NearRule) -> Column:
    """The fingerprint of a text as a list of signed 64-bit integers; null and no words: zeros."""
    @F.arrow_udf("array<bigint>")
    def prints(texts: pa.Array) -> pa.Array:
        found = [fingerprint(words(t.as_py()), rule.shingle, rule.numbers, rule.seed) for t in texts]
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        starts = np.arange(len(found) + 1, dtype=np.int32) * rule.numbers
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))

    return prints(text)


def shingle_sets(text: Column, rule: NearRule, *, elements: bool) -> Column:
    """``struct<own, prints>``, or ``struct<own, elements>``, of a text's set of shingles.

    ``own`` is a 128-bit digest of the set, ``elements`` are its hashes.
    """
    kind = pa.struct([("own", pa.binary()), (("elements" if elements else "prints"),
                                            pa.list_(pa.int64()))])
    name = "elements" if elements else "prints"

    @F.arrow_udf(f"struct<own:binary,{name}:array<bigint>>")
    def sets(texts: pa.Array) -> pa.Array:
        import xxhash

        own, found = [], []
        for t in texts:
            hashes = hash_set(words(t.as_py()), rule.shingle, rule.seed)
            own.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            found.append((hashes if elements else set_fingerprint(hashes, rule.numbers))
                         .view(np.int64))
        starts = np.cumsum([0, *map(len, found)], dtype=np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
        return pa.StructArray.from_arrays(
            [pa.array(own, pa.binary()), lists], fields=list(kind))

    return sets(text)


def _verified(
    docs: DataFrame, rows: DataFrame, distinct: DataFrame, links: DataFrame, rule: NearRule,
    elements_per_group: int,
) -> DataFrame:
    """The links that remain by the exact similarity, of members of the same component.

    Only texts that have a candidate are read again.
    """
    others = components(links)
    members = others.selectExpr("a AS id", "b AS root").unionByName(
        others.selectExpr("b AS id", "b AS root").distinct())
    wanted = stored(distinct.join(members, "id").select("id", "own", "root"), "candidates")
    keys = rows.join(wanted, "own", "left_semi").select(F.col("key").alias("_key")).distinct()
    texts = docs.join(keys, docs.key.eqNullSafe(F.col("_key")), "left_semi")
    found = texts.select(shingle_sets(F.col("text"), rule, elements=True).alias("found")).select(
        "found.own", "found.elements")
    sets = stored(
        found.join(wanted, "own").groupBy("id", "root").agg(
            F.any_value("elements").alias("elements")), "candidate-sets",
    )
    return stored(exact_links(sets, rule.similarity, elements_per_group=elements_per_group),
                  "verified-links")


def near_components(
    docs: DataFrame, rule: NearRule = STRICT, *, key: str = "doc_id", text: str = "text",
    keys_per_group: int = KEYS_PER_GROUP, elements_per_group: int = ELEMENTS_PER_GROUP,
) -> DataFrame:
    """One row per row of ``docs``: the key, ``prints`` and ``component_id``.

    The component is named by the smallest key reachable over links, the row's
    own included (null if all are null).  Equal fingerprints (with a
    similarity, equal sets) are one vertex, so copies are never paired.  Repeated rows and keys are rows like any other.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if rule.similarity is None:
        own = "prints"
        rows = docs.select("key", fingerprints(F.col("text"), rule).alias("prints"))
    else:
        own = "own"
        rows = docs.select(
            "key", shingle_sets(F.col("text"), rule, elements=False).alias("found")
        ).select("key", "found.own", "found.prints")
    rows = stored(rows, "fingerprints")
    grouped = rows.groupBy(own).agg(
        F.min("key").alias("least"),
        *([] if own == "prints" else [F.any_value("prints").alias("prints")]))
    distinct = stored(
        grouped.withColumn("id", F.monotonically_increasing_id()), "distinct-fingerprints")
    links = None
    for number, at in rule.slices():
        items = distinct.select(
            "id", F.shiftleft(F.col("prints")[number], at).alias("key"),
            F.col("prints").alias("wide"),
        )
        # One trie after another, each written, so that their shuffles do not add up.
        found = stored(trie_links(
            items, bits=rule.bits, budget=rule.budget, radius=rule.radius,
            keys_per_group=keys_per_group,
            crowd=None if rule.similarity is None else min(CROWD, keys_per_group // 2),
        ), "trie-links")
        links = found if links is None else links.unionByName(found)
    if rule.similarity is not None:
        links = _verified(docs, rows, distinct, links, rule, elements_per_group)
    roots = components(links)
    vertices = stored(
        distinct.join(roots, distinct.id == roots.a, "left").select(
            own, "least", F.coalesce("b", "id").alias("root")
        ), "vertices",
    )
    least = vertices.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(vertices.join(least, "root").select(own, "component_id"), "components")
    return rows.join(named, own).select(F.col("key").alias(key), "prints", "component_id")
