"""Near duplicates by an inverted join of MinHash signatures.

A signature holds, for each of its coordinates, the smallest hash of a text's set of
shingles; two sets of similarity J agree in a coordinate with probability J.  A
text is posted under its (coordinate, value) pairs, and texts that agree in
``matches`` coordinates or more are candidates of each other.

* Prefix: texts that agree in m of k coordinates share one of the k - m + 1 values that are
  rarest in either text, so a text is posted under its rarest values only.  A value that
  no other text has can be no common one: a text with c shared values takes part with its
  c - m + 1 rarest of them, and not at all if c is below m.
* Skip: the long lists of the frequent values are not merged.  The collisions that they
  would add to a candidate are counted from the two signatures instead.

Equal sets are one vertex, and a posting list returns the links of a spanning forest of its
candidates, so copies are not paired out.  Similarity is decided on the whole sets: first
for candidate links themselves; where some fail, all members of that group of
candidates are compared, so no link between different texts is lost to the forest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.binary_trie import Forest
from foliant.llm.components import components
from foliant.llm.shared import stored, words
from foliant.llm.similar_sets import exact_links
from foliant.llm.simhash import hash_set

#: Hashes taken at once for all coordinates; pairs of signatures compared at once.
HASHES_AT_ONCE, PAIRS_AT_ONCE = 512, 1 << 16
#: Lists up to this length are compared pair by pair, longer ones member by member.
SHORT = 16


@dataclass(frozen=True)
class JoinRule:
    """Texts are linked if 100 times the shared shingles are ``percent`` of all or more.

    With 128 coordinates a pair at exactly 0.8 agrees in 102 on average; fewer than the 76
    asked for happen once in more than four million pairs, and more rarely above 0.8.
    Lists of more than ``list_block`` texts are cut into blocks, ``bucket`` postings
    of shorter ones make one task group.
    """

    shingle: int = 2
    percent: int = 80
    coordinates: int = 128
    matches: int = 76
    seed: int = 42
    list_block: int = 4096
    bucket: int = 1 << 14

    def __post_init__(self) -> None:
        if not 0 < self.matches <= self.coordinates:
            raise ValueError("matches must be between 1 and the number of coordinates")


# -- signatures ----------------------------------------------------------------


def _keys(rule: JoinRule) -> np.ndarray:
    """Two odd numbers for each coordinate."""
    return np.random.default_rng(rule.seed).integers(
        0, 1 << 64, (2, rule.coordinates), dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The upper half of the smallest mixed hash of each coordinate; zeros for no hashes."""
    least = np.full(keys.shape[1], np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        mixed = hashes[at: at + HASHES_AT_ONCE, None] * keys[0]
        mixed ^= mixed >> np.uint64(29)
        mixed *= keys[1]
        np.minimum(least, mixed.min(axis=0), out=least)
    if not len(hashes):
        least[:] = 0
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(text: Column, rule: JoinRule) -> Column:
    """``struct<own, n, values, marks>``: digest and size of a text's set, and its signature.

    ``marks`` has the lowest byte of each of the signature's ``values``.
    """
    keys = _keys(rule)
    kind = pa.struct([("own", pa.binary()), ("n", pa.int64()), ("values", pa.list_(pa.int32())),
                      ("marks", pa.binary())])

    @F.arrow_udf("struct<own:binary,n:bigint,values:array<int>,marks:binary>")
    def signed(texts: pa.Array) -> pa.Array:
        import xxhash

        own, sizes, found = [], [], []
        for t in texts:
            hashes = hash_set(words(t.as_py()), rule.shingle, rule.seed)
            own.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            sizes.append(len(hashes))
            found.append(signature(hashes, keys))
        starts = np.arange(len(found) + 1, dtype=np.int32) * rule.coordinates
        flat = np.concatenate(found).view(np.int32) if found else np.zeros(0, np.int32)
        return pa.StructArray.from_arrays([
            pa.array(own, pa.binary()), pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(starts), pa.array(flat)),
            pa.array([values.astype(np.uint8).tobytes() for values in found], pa.binary()),
        ], fields=list(kind))

    return signed(text)


def shingle_hashes(text: Column, rule: JoinRule) -> Column:
    """``struct<own, elements>``: digest and hashes of a text's set of shingles."""
    kind = pa.struct([("own", pa.binary()), ("elements", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<own:binary,elements:array<bigint>>")
    def hashed(texts: pa.Array) -> pa.Array:
        import xxhash

        found = [hash_set(words(t.as_py()), rule.shingle, rule.seed) for t in texts]
        own = [xxhash.xxh3_128_digest(hashes.tobytes()) for hashes in found]
        starts = np.cumsum([0, *map(len, found)], dtype=np.int32)
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([
            pa.array(own, pa.binary()), pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
        ], fields=list(kind))

    # Else a filter on the digest would be moved, with this function, below the join that
    # picks the texts to be hashed.
    return hashed.asNondeterministic()(text)


# -- candidates ----------------------------------------------------------------


def _bytes(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Byte strings of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, size), np.uint8)
    joined = np.frombuffer(column.buffers()[2], np.uint8)
    first = column.buffers()[1]
    starts = np.frombuffer(first, np.int32)[column.offset: column.offset + len(column) + 1]
    return joined[starts[0]: starts[-1]].reshape(len(column), size)


def postings(texts: DataFrame, rule: JoinRule) -> DataFrame:
    """(token, id): each text under the rarest of the values that it shares, as far as needed.

    ``texts``: id, values.  A token is a coordinate and its value in one number.
    """
    own = texts.select("id", F.posexplode("values").alias("coordinate", "value")).select(
        "id", F.expr("(cast(coordinate as bigint) << 32) | (value & 4294967295L)").alias("token"))
    shared = stored(
        own.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-values")
    rarest = F.sort_array(F.collect_list(F.struct("df", "token")))
    needed = F.size("found") - (rule.matches - 1)
    return own.join(shared, "token").groupBy("id").agg(rarest.alias("found")).filter(
        needed > 0).select("id", F.explode(F.slice("found", F.lit(1), needed)).alias("one")).select(
        "id", F.col("one.token").alias("token"))


def list_links(
    token: np.ndarray, ids: np.ndarray, marks: np.ndarray, sizes: np.ndarray, joined: np.ndarray,
    matches: int, percent: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs that connect all candidates which share a list.

    One row per posting: the list's token, the text's id, the marks and the size of its set.
    ``joined`` marks rows that are known to be connected with each other.
    """
    names, at = np.unique(ids, return_inverse=True)
    forest = Forest(len(names))
    known = at[joined]
    forest.join(known[1:], known[:-1])
    found = [np.zeros((0, 2), dtype=np.int64)]

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least, most = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        close = 100 * least >= percent * most
        close[close] = (marks[i[close]] == marks[j[close]]).sum(axis=1) >= matches
        return close

    def tell(i: np.ndarray, j: np.ndarray) -> None:
        """Join the candidates among pairs that were not connected."""
        close = alike(i, j)
        i, j = at[i[close]], at[j[close]]
        forest.join(i, j)
        found.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))

    order = np.argsort(token, kind="stable")
    starts = np.flatnonzero(np.r_[True, token[order][1:] != token[order][:-1]])
    lengths = np.diff(np.r_[starts, len(order)])
    short = (lengths > 1) & (lengths <= SHORT)
    for step in range(1, SHORT):  # pairs of members so many places apart
        far = short & (lengths > step)
        counts = lengths[far] - step
        first = np.repeat(starts[far] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        for part in range(0, len(first), PAIRS_AT_ONCE):
            i = order[first[part: part + PAIRS_AT_ONCE]]
            j = order[first[part: part + PAIRS_AT_ONCE] + step]
            apart = forest.roots(at[i]) != forest.roots(at[j])
            i, j = i[apart], j[apart]
            tell(i, j)
    for start, length in zip(starts[lengths > SHORT], lengths[lengths > SHORT]):
        members = order[start: start + length]
        for place in range(length - 1):
            roots = forest.roots(at[members])
            if place % 64 == 0 and (roots == roots[0]).all():
                break
            later = members[place + 1:][roots[place + 1:] != roots[place]]
            for part in range(0, len(later), PAIRS_AT_ONCE):
                j = later[part: part + PAIRS_AT_ONCE]
                tell(np.full(len(j), members[place]), j)
    pairs = np.unique(np.concatenate(found), axis=0)
    return names[pairs[:, 1]], names[pairs[:, 0]]


def candidate_links(texts: DataFrame, rule: JoinRule) -> DataFrame:
    """Links (a, b) that connect all texts agreeing in enough coordinates.

    ``texts``: id, n (size of the set, above zero), values, marks; a written table.  Marks of
    one byte can only seem to agree in more coordinates than the values.
    """
    posted = stored(postings(texts, rule), "postings")
    lists = stored(
        posted.groupBy("token").agg(F.count(F.lit(1)).alias("length"), F.min("id").alias("first"))
        .filter("length > 1"), "lists")
    members = posted.join(lists, "token").join(texts.select("id", "n", "marks"), "id")
    size, matches, percent = rule.coordinates, rule.matches, rule.percent
    small = lists.filter(F.col("length") <= rule.list_block)
    buckets = max(1, -(-(small.agg(F.sum("length")).first()[0] or 0) // rule.bucket))
    kind = "a bigint, b bigint"

    def linked(table: pa.Table) -> pa.Table:
        a, b = list_links(
            table["token"].to_numpy(), table["id"].to_numpy(), _bytes(table["marks"], size),
            table["n"].to_numpy(), table["star"].to_numpy(), matches, percent)
        return pa.table({"a": a, "b": b})

    columns = ["token", "id", "marks", "n", "star"]
    links = members.filter(F.col("length") <= rule.list_block).select(
        *columns[:-1], F.lit(False).alias("star"),
        F.expr(f"pmod(xxhash64(token), {buckets})").alias("bucket"),
    ).groupBy("bucket").applyInArrow(linked, kind)
    large = lists.filter(F.col("length") > rule.list_block)
    if large.isEmpty():
        return links

    # A crowded list is first held against one of its texts, which connects most of it.
    @F.arrow_udf("boolean")
    def close(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        n, m = n.to_numpy(), m.to_numpy()
        enough = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        return pa.array(((_bytes(a, size) == _bytes(b, size)).sum(axis=1) >= matches) & enough)

    crowds = members.filter(F.col("length") > rule.list_block)
    hubs = crowds.filter("id = first").select(
        "token", F.col("marks").alias("hub"), F.col("n").alias("hub_n"))
    held = stored(
        crowds.join(hubs, "token").withColumn("star", close("marks", "hub", "n", "hub_n")).select(
            *columns, "first"), "crowds")
    stars = held.filter("star AND id != first").select(
        F.col("id").alias("a"), F.col("first").alias("b"))
    # Blocks 0 to r - 1 hold the rest and the others the star; pairs with one of the rest meet.
    half = rule.list_block // 2 or 1
    blocks = stored(
        held.groupBy("token").agg(
            F.ceil(F.count_if(~F.col("star")) / half).cast("int").alias("r"),
            F.ceil(F.count_if("star") / half).cast("int").alias("s")).filter("r > 0"),
        "crowd-blocks")
    own = F.expr("cast(if(star, r + pmod(xxhash64(id), s), pmod(xxhash64(id), r)) as int)")
    others = F.expr("sequence(0, if(star, r, r + s) - 1)")
    dealt = held.join(blocks, "token").withColumn("own", own).withColumn("other", F.explode(others))
    # The first text is a star, so each block of the rest meets another, and itself with it.
    dealt = dealt.filter("own != other").select(
        *columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rest = dealt.groupBy("token", "i", "j").applyInArrow(linked, kind)
    return links.unionByName(stars).unionByName(rest)


# -- exact similarity -----------------------------------------------------------


def _verified(links: DataFrame, sets: DataFrame, rule: JoinRule) -> DataFrame:
    """Links that connect all texts within a group of candidates by the exact similarity.

    ``links``: candidates (a, b), b the smaller; ``sets``: id, root (the group of candidates),
    elements; written tables.  First each text is compared with its smallest candidate, then
    candidates that this has not connected, and at last all members of the groups that
    are still in parts.
    """
    def held(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a"))
        b = sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b"))
        shared = F.size(F.array_intersect("of_a", "of_b")).cast("bigint")
        union = F.size("of_a") + F.size("of_b") - shared
        return stored(
            pairs.join(a, "a").join(b, "b").filter(100 * shared >= rule.percent * union)
            .select("a", "b"), "held-links")

    def parts(of: DataFrame) -> DataFrame:
        """(id, part) of the texts of the groups."""
        roots = components(of)
        return sets.select("id", "root").join(roots, F.col("id") == roots.a, "left").select(
            "id", "root", F.coalesce("b", "id").alias("part"))

    first = stored(links.groupBy("a").agg(F.min("b").alias("b")), "first-links")
    sure = held(first)
    part = stored(parts(sure).drop("root"), "first-parts")
    apart = links.join(first, ["a", "b"], "left_anti").join(
        part.withColumnsRenamed({"id": "a", "part": "part_a"}), "a").join(
        part.withColumnsRenamed({"id": "b", "part": "part_b"}), "b").filter("part_a != part_b")
    sure = stored(sure.unionByName(held(apart.select("a", "b"))), "sure-links")
    open_groups = parts(sure).groupBy("root").agg(
        F.min("part").alias("least"), F.max("part").alias("most")
    ).filter("least != most").select("root")
    rest = stored(sets.join(open_groups, "root", "left_semi"), "open-sets")
    if rest.isEmpty():
        return sure
    return sure.unionByName(exact_links(rest, rule.percent / 100))


def minhash_components(
    docs: DataFrame, rule: JoinRule = JoinRule(), *, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_shingles`` and ``component_id``.

    Words are split at white space with A-Z lower-cased; a text's set holds its distinct runs
    of so many words, with fewer words the whole sequence.  The component is named by the
    smallest key reachable over links, the row's own included (null if all are null).  Null
    texts and texts without words have an empty set and are a component of their own
    each.  Repeated rows and keys are rows like any other, other columns are not
    read, an empty table gives no rows.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stored(
        docs.select("key", signatures(F.col("text"), rule).alias("found")).select(
            "key", "found.own", "found.n", "found.values", "found.marks"), "signatures")
    texts = stored(
        rows.filter("n > 0").groupBy("own").agg(
            F.min("key").alias("least"), F.any_value("n").alias("n"),
            F.any_value("values").alias("values"), F.any_value("marks").alias("marks"),
        ).withColumn("id", F.monotonically_increasing_id()), "distinct-sets")
    links = stored(candidate_links(texts, rule).distinct(), "candidate-links")
    others = components(links)
    members = others.selectExpr("a AS id", "b AS root").unionByName(
        others.selectExpr("b AS id", "b AS root").distinct())
    wanted = stored(texts.join(members, "id").select("id", "own", "root"), "candidates")
    # Only texts that have a candidate are read again.
    keys = rows.join(wanted, "own", "left_semi").select(F.col("key").alias("_key")).distinct()
    again = docs.join(keys, docs.key.eqNullSafe(F.col("_key")), "left_semi").select(
        shingle_hashes(F.col("text"), rule).alias("found")).select("found.own", "found.elements")
    sets = stored(
        again.join(wanted, "own").groupBy("id", "root").agg(
            F.any_value("elements").alias("elements")), "candidate-sets")
    roots = components(_verified(links, sets, rule))
    vertices = stored(
        texts.join(roots, texts.id == roots.a, "left").select(
            "own", "least", F.coalesce("b", "id").alias("root")), "vertices")
    least = vertices.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(vertices.join(least, "root").select("own", "component_id"), "components")
    return rows.join(named, "own", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
