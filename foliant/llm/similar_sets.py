"""Exact Jaccard similarity of sets, within groups of candidates.

A group's sets are compared one with all others at a time, and never two that
are already connected, so that a crowd of near copies takes few comparisons.  A
group beyond the bound is first held against one of its sets, which connects
most of a crowd; blocks of the rest then meet the blocks of all members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.binary_trie import Forest
from foliant.llm.shared import stored

#: Elements of all sets of a task group, unless a single pair has more.
ELEMENTS_PER_GROUP = 1 << 22


def set_links(
    flat: np.ndarray, sizes: np.ndarray, joined: np.ndarray, similarity: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) that connect all sets of this similarity or more.

    ``flat`` holds the elements of each set in turn, without repeats and at
    least one; sets marked in ``joined`` are known to be connected.
    """
    forest = Forest(len(sizes))
    known = np.flatnonzero(joined)
    forest.join(known[1:], known[:-1])
    codes = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marked = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool)
    everyone = np.arange(len(sizes))
    # Those still to be compared with the next: later ones, in their own compact arrays.
    own_codes, own_sizes, own = codes, sizes, everyone
    for i in everyone[:-1].tolist():
        roots = forest.roots(everyone)
        apart = (own > i) & (roots[own] != roots[i])
        if not apart.any():
            if (roots == roots[0]).all():
                break
            continue
        later = own > i
        if later.sum() < len(own) // 2:
            own_codes, own_sizes, own = own_codes[np.repeat(later, own_sizes)], own_sizes[later], own[later]
            apart = roots[own] != roots[i]
        elements = codes[starts[i]: ends[i]]
        marked[elements] = True
        shared = np.add.reduceat(
            marked[own_codes], np.cumsum(own_sizes) - own_sizes, dtype=np.int64)
        marked[elements] = False
        alike = apart & (shared / (own_sizes + sizes[i] - shared) >= similarity)
        forest.join(np.full(int(alike.sum()), i), own[alike])
    return forest.links()


def exact_links(
    members: DataFrame, similarity: float, *, elements_per_group: int = ELEMENTS_PER_GROUP,
) -> DataFrame:
    """Links (a, b) that connect all members of a group with this similarity or more.

    ``members``: ``root``, the group, ``id`` and ``elements``, a list of integers
    without repeats.  Empty sets are like no other.  Read several times.
    """
    members = members.filter(F.size("elements") > 0)
    groups = stored(
        members.groupBy("root").agg(
            F.sum(F.size("elements")).alias("total"), F.min("id").alias("first"),
            F.count(F.lit(1)).alias("n")
        ).filter("n > 1"), "set-groups",
    )
    small = groups.filter(F.col("total") <= elements_per_group).select(
        "root", F.lit(0).alias("i"), F.lit(1).alias("j"))
    rows = members.join(small, "root").withColumn("star", F.lit(False))
    columns = ["root", "i", "j", "id", "star", "elements"]
    rows = rows.select(*columns)
    links = None
    large = groups.filter(F.col("total") > elements_per_group)
    if not large.isEmpty():
        crowds = members.join(large.select("root", "first"), "root")
        hubs = crowds.filter("id = first").select("root", F.col("elements").alias("hub"))
        shared = F.size(F.array_intersect("elements", "hub"))
        union = F.size("elements") + F.size("hub") - shared
        # Read from a table, so that adaptive execution can split a group with very many rows.
        held = stored(
            crowds.join(hubs, "root").select(
                "root", "first", "id", (shared / union >= similarity).alias("star")
            ), "set-stars",
        )
        links = held.filter("star AND id != first").select(
            F.col("id").alias("a"), F.col("first").alias("b"))
        # Blocks 0 to r - 1 hold the rest and the others the star; pairs with one of the rest meet.
        sized = members.select("id", "elements").join(held, "id")
        room = F.lit(elements_per_group // 2)
        blocks = stored(
            sized.groupBy("root").agg(
                F.ceil(F.coalesce(F.sum(F.when(~F.col("star"), F.size("elements"))), F.lit(0))
                       / room).cast("int").alias("r"),
                F.ceil(F.sum(F.when(F.col("star"), F.size("elements"))) / room).cast("int")
                .alias("s"),
            ).filter("r > 0"), "set-blocks",
        )
        own = F.expr("cast(if(star, r + pmod(xxhash64(id), s), pmod(xxhash64(id), r)) as int)")
        others = F.expr("""filter(sequence(0, if(star, r, r + s) - 1), x -> x != own)""")
        dealt = sized.join(blocks, "root").withColumn("own", own).withColumn(
            "other", F.explode(others))
        rows = rows.unionByName(dealt.select(
            "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            "id", "star", "elements",
        ))

    def linked(table: pa.Table) -> pa.Table:
        lists = table.column("elements").combine_chunks()
        ids, star = table.column("id").to_numpy(), table.column("star").to_numpy()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        i, j = set_links(lists.flatten().to_numpy(), sizes, star, similarity)
        return pa.table({"a": ids[i], "b": ids[j]})

    found = rows.groupBy("root", "i", "j").applyInArrow(linked, "a bigint, b bigint")
    return found if links is None else links.unionByName(found)
