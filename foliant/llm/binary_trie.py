"""Self-join of keys within a Hamming distance by walking a binary trie.

Pairs of trie nodes are followed downwards together.  A pair carries the number
of bits in which its two prefixes differ, and is dropped as soon as this
exceeds the budget; nothing else is dropped, so every pair of keys within the
budget is met exactly once.

The upper part of the trie is walked in tables, some bits per step, until the
two nodes of a pair hold a bounded number of keys; crowded branches go on
further than others.  Each remaining pair is one task group, which walks the
rest in arrays.  A group gives the links of a spanning forest of what it found
and not each link, so a crowd of near copies does not make all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import stored

BITS = 64
KEYS_PER_GROUP = 131_072
STEP = 2
#: Node pairs or key pairs worked on at a time, and keys below which pairs are compared directly.
AT_ONCE, DIRECT = 1 << 18, 16


# -- one pair of subtries ----------------------------------------------------


class _Side:
    """Sorted keys; ``ones[d][i]`` counts the keys before i with bit d set."""

    def __init__(self, keys: np.ndarray, depth: int, bits: int):
        self.keys = keys
        self.depth = depth
        self.ones = np.zeros((bits - depth, len(keys) + 1), dtype=np.int32)
        for level in range(depth, bits):
            bit = (keys >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            np.cumsum(bit, out=self.ones[level - depth, 1:])

    def middle(self, level: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        ones = self.ones[level - self.depth]
        return high - (ones[high] - ones[low])


def _crossed(pairs: tuple) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within pairs of ranges."""
    low_a, high_a, low_b, high_b = pairs[:4]
    width, sizes = high_b - low_b, (high_a - low_a) * (high_b - low_b)
    which = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return low_a[which] + inside // width[which], low_b[which] + inside % width[which]


def near_pairs(
    a: np.ndarray, b: np.ndarray | None, depth: int, differing: int, budget: int, bits: int = BITS,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of keys within the budget, in parts.

    ``a`` and ``b`` are sorted unsigned keys that share their first ``depth``
    bits on each side, which differ in ``differing`` bits; None for ``b`` joins
    ``a`` with itself and gives each pair once.  Keys may repeat.
    """
    left = _Side(a, depth, bits)
    right = left if b is None else _Side(b, depth, bits)
    whole = [np.array([0]), np.array([len(left.keys)]), np.array([0]), np.array([len(right.keys)])]
    stack = [(depth, (*whole, np.array([differing])))]
    while stack:
        level, pairs = stack.pop()
        if len(pairs[0]) > AT_ONCE:
            half = len(pairs[0]) // 2
            stack += [(level, tuple(p[:half] for p in pairs)),
                      (level, tuple(p[half:] for p in pairs))]
            continue
        low_a, high_a, low_b, high_b, diff = pairs
        direct = ((high_a - low_a) * (high_b - low_b) <= DIRECT) | (level == bits)
        ready = [p[direct] for p in pairs]
        sizes = (ready[1] - ready[0]) * (ready[3] - ready[2])
        if len(sizes) == 1 and sizes[0] > AT_ONCE:  # one key many times on either side
            low_a, high_a, low_b, high_b, diff = (p[0] for p in ready)
            cut_a, cut_b = (low_a + high_a) // 2, (low_b + high_b) // 2
            quarters = [
                (la, ha, lb, hb, diff)
                for la, ha in ((low_a, cut_a), (cut_a, high_a))
                for lb, hb in ((low_b, cut_b), (cut_b, high_b))
                if ha > la and hb > lb and (b is not None or la < hb)
            ]
            stack += [(level, tuple(np.array([x]) for x in quarter)) for quarter in quarters]
        elif len(sizes) > 1 and sizes.sum() > 4 * AT_ONCE:
            half = len(sizes) // 2
            stack += [(level, tuple(p[:half] for p in ready)),
                      (level, tuple(p[half:] for p in ready))]
        elif len(sizes):
            i, j = _crossed(tuple(ready))
            if b is None:
                once = i < j
                i, j = i[once], j[once]
            close = np.bitwise_count(left.keys[i] ^ right.keys[j]) <= budget
            if close.any():
                yield i[close], j[close]
        low_a, high_a, low_b, high_b, diff = (p[~direct] for p in pairs)
        if not len(diff):
            continue
        cut_a, cut_b = left.middle(level, low_a, high_a), right.middle(level, low_b, high_b)
        same = (low_a == low_b) & (high_a == high_b) if b is None else np.zeros(len(diff), bool)
        children = []
        for la, ha, lb, hb, more, skip in (
            (low_a, cut_a, low_b, cut_b, 0, None), (cut_a, high_a, cut_b, high_b, 0, None),
            (low_a, cut_a, cut_b, high_b, 1, None), (cut_a, high_a, low_b, cut_b, 1, same),
        ):
            keep = (ha > la) & (hb > lb) & (diff + more <= budget)
            if skip is not None:
                keep &= ~skip
            children.append(tuple(x[keep] for x in (la, ha, lb, hb, diff + more)))
        stack.append((level + 1, tuple(np.concatenate(parts) for parts in zip(*children))))


class Forest:
    """Disjoint sets of positions; the smallest position stands for its set."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.roots(i), self.roots(j)
            apart = i != j
            i, j = np.maximum(i[apart], j[apart]), np.minimum(i[apart], j[apart])
            np.minimum.at(self.parent, i, j)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(self.parent))
        roots = self.roots(at)
        return at[roots != at], roots[roots != at]


# -- all keys ----------------------------------------------------------------


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("bigint")


def _node_pairs(
    keys: DataFrame, bits: int, budget: int, keys_per_group: int
) -> list[tuple[int, DataFrame]]:
    """By depth, the node pairs (p, q, diff) whose keys make one group each."""
    spark = keys.sparkSession
    pairs = spark.createDataFrame([(0, 0, 0)], "p bigint, q bigint, diff int")
    depth, done = 0, []
    while True:
        nodes = stored(
            keys.groupBy(_prefix(F.col("key"), depth).alias("node"))
            .agg(F.count(F.lit(1)).alias("n")), "trie-nodes",
        )
        a, b = nodes.selectExpr("node AS p", "n AS n_p"), nodes.selectExpr("node AS q", "n AS n_q")
        if depth:
            children = nodes.withColumn("parent", F.shiftrightunsigned("node", STEP))
            a = children.selectExpr("parent AS up_p", "node AS p", "n AS n_p")
            b = children.selectExpr("parent AS up_q", "node AS q", "n AS n_q")
            pairs = pairs.selectExpr("p AS up_p", "q AS up_q", "diff AS up_diff")
            diff = F.expr(f"up_diff + bit_count((p ^ q) & {(1 << STEP) - 1})").cast("int")
            once = (F.col("up_p") != F.col("up_q")) | (F.col("p") <= F.col("q"))
            both = pairs.join(a, "up_p").join(b, "up_q").withColumn("diff", diff)
            pairs = both.filter(once & (F.col("diff") <= budget)).select(
                "p", "q", "diff", "n_p", "n_q"
            )
        else:
            pairs = pairs.join(a, "p").join(b, "q")
        pairs = stored(pairs, "trie-pairs")
        small = (F.col("n_p") + F.col("n_q") <= keys_per_group) | F.lit(depth + STEP > bits)
        done.append((depth, pairs.filter(small).select("p", "q", "diff")))
        pairs = pairs.filter(~small)
        if pairs.isEmpty():
            return done
        depth += STEP


def trie_links(
    items: DataFrame, *, bits: int = BITS, budget: int = 2, radius: int | None = None,
    keys_per_group: int = KEYS_PER_GROUP, crowd: int | None = None,
) -> DataFrame:
    """Links (a, b) that connect all items within the budget of each other.

    ``items``: ``id`` and ``key``, integers; the key's first ``bits`` bits count.
    With ``radius``, a column ``wide`` holds a longer fingerprint as a list, and
    items within the budget are linked only if these are within the radius.
    ``items`` is read several times and should be a written table.

    Where links are only candidates, ``crowd`` bounds the items of one key: more
    are all linked without regard to the radius, by one of them that stands for
    all, and so are keys within the budget.  No group then holds over twice as
    many, or ``keys_per_group`` if that is more.
    """
    stars = None
    if bits < BITS:  # groups compare whole keys
        items = items.withColumn("key", F.col("key").bitwiseAND(F.lit(-1 << (BITS - bits))))
    if crowd is not None:
        crowded = stored(
            items.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
            .filter(F.col("n") > crowd).select("key", "least"), "trie-crowds",
        )
        if not crowded.isEmpty():
            # Read from a table, so that adaptive execution can split a key with very many rows.
            within = items.join(crowded, "key", "left")
            stars = within.filter("id != least").select(
                F.col("id").alias("a"), F.col("least").alias("b"))
            items = stored(
                within.filter("least IS NULL OR id = least").select(
                    "id", "key", F.when(F.col("least").isNull(), F.col("wide")).alias("wide")
                ), "trie-items",
            )
    columns = ["id", "key"] + (["wide"] if radius is not None else [])
    sides = []
    for depth, pairs in _node_pairs(items.select("key"), bits, budget, keys_per_group):
        at = items.select(*columns, _prefix(F.col("key"), depth).alias("node"))
        for side, name in enumerate("pq"):
            own = pairs if not side else pairs.filter("p != q")
            sides.append(
                at.join(own, at.node == own[name]).select(
                    F.lit(depth).alias("depth"), "p", "q", "diff", F.lit(side).alias("side"),
                    *columns,
                )
            )
    rows = sides[0]
    for more in sides[1:]:
        rows = rows.unionByName(more)

    def linked(table: pa.Table) -> pa.Table:
        depth, diff, p, q = (table.column(c)[0].as_py() for c in ("depth", "diff", "p", "q"))
        keys = table.column("key").to_numpy().view(np.uint64)
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((ids, keys, side))
        keys, side, ids = keys[order], side[order], ids[order]
        first = int((side == 0).sum())
        wide = None
        if radius is not None:
            lists = table.column("wide").combine_chunks()
            stands = lists.is_null().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy().view(np.uint64)
            numbers = len(flat) // max(1, len(stands) - int(stands.sum()))
            wide = np.zeros((len(ids), numbers), dtype=np.uint64)
            wide[~stands] = flat.reshape(-1, numbers) if numbers else 0
            wide, stands = wide[order], stands[order]
        forest, shift = Forest(len(ids)), 0 if p == q else first
        found = near_pairs(
            keys[:first], None if p == q else keys[first:], depth, diff, budget, bits
        )
        for i, j in found:
            j = j + shift
            if wide is not None:
                close = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= radius
                close |= stands[i] | stands[j]
                i, j = i[close], j[close]
            forest.join(i, j)
        i, j = forest.links()
        return pa.table({"a": ids[i], "b": ids[j]})

    found = rows.groupBy("depth", "p", "q").applyInArrow(linked, "a bigint, b bigint")
    return found if stars is None else found.unionByName(stars)
