"""Exact duplicates by deterministic block naming.

A normalised text is cut into fixed-size blocks of bytes.  Equal blocks get
equal integer names: blocks meet in a shuffle, are told apart by their whole
content, and are numbered in sorted order.  Then adjacent names are paired and
each distinct pair is named in turn, level by level, until every document has
one name.  Two documents have the same name on the same level exactly if their
texts are equal; no hash decides.

Names are carried back to the documents by a 128-bit digest of the block, which
only routes: that no two blocks of the corpus share a digest is verified from
the whole blocks, and other seeds are taken if they do.

Everything is DataFrame work.  Copies collapse in the map-side aggregation
before the shuffle, pair levels carry integers only, and the joins back read
written tables, so that adaptive execution can split a hot block's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import lower_ascii, stored

BLOCK_BYTES = 2048
#: Stands for the missing partner of a last name.
ALONE = -1


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows by partition and sorted place within it, and keep the numbers."""
    return stored(
        df.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())
        .drop("block"), name,
    )


def _blocks(text: Column, size: int) -> Column:
    data = text.cast("binary")
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda at: F.substring(data, at, F.lit(size)))


def _digest(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(seed), block).alias("h2")]


def _block_names(texts: DataFrame, size: int, tries: int) -> tuple[DataFrame, int]:
    """A name for each distinct block by digest, and the digest's seed."""
    for seed in range(tries):
        blocks = texts.select(F.explode(_blocks(F.col("text"), size)).alias("block"))
        distinct = blocks.select(*_digest(F.col("block"), seed), "block").distinct()
        names = _numbered(distinct, ["h1", "h2", "block"], "block-names")
        shared = names.groupBy("h1", "h2").count().filter("count > 1")
        if shared.isEmpty():
            return names, seed
    raise RuntimeError(f"blocks share digests under {tries} seeds")


def block_identities(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", normalise=lower_ascii,
    block_bytes: int = BLOCK_BYTES, tries: int = 4,
) -> DataFrame:
    """One row per row of ``docs`` with its identity by whole normalised text.

    Columns: ``row`` (a number for each row), the key, ``text_sha256`` of the
    normalised text, ``level`` and ``name``.  Texts are equal exactly if level
    and name are.  Null texts are empty, and an empty text has one empty block.
    Keys may repeat or be null.
    """
    texts = docs.select(F.col(key).alias("key"), normalise(F.col(text)).alias("text"))
    names, seed = _block_names(texts.select("text"), block_bytes, tries)
    last = F.expr(f"cast((greatest(octet_length(text), 1) - 1) div {block_bytes} AS bigint)")
    # Numbered before the blocks are exploded, so that a document has one number.
    placed = texts.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "key", last.alias("last"), F.sha2("text", 256).alias("text_sha256"),
        F.posexplode(_blocks(F.col("text"), block_bytes)).alias("at", "block"),
    ).select(
        "row", F.col("at").cast("bigint").alias("at"), "last", F.when(F.col("at") == 0, F.struct("key", "text_sha256")).alias("document"),
        *_digest(F.col("block"), seed),
    )
    # Written once: the row numbers, and the names of the blocks.
    first = stored(placed.join(names, ["h1", "h2"]).drop("h1", "h2"), "block-rows")
    documents = first.filter("at = 0").select("row", "document.*")
    rows = first.select("row", "at", "last", "name")
    level, done = 0, []
    while True:
        done.append(rows.filter("last = 0").select("row", F.lit(level).alias("level"), "name"))
        longer = rows.filter("last > 0")
        if longer.isEmpty():
            break
        level += 1
        pairs = stored(
            longer.groupBy("row", F.expr("at div 2").alias("at")).agg(
                F.expr("max(last) div 2").alias("last"),
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(
                    F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(ALONE)
                ).alias("right"),
            ), "block-pairs",
        )
        names = _numbered(
            pairs.select("left", "right").distinct(), ["left", "right"], "pair-names"
        )
        rows = stored(
            pairs.join(names, ["left", "right"]).select("row", "at", "last", "name"), "pair-rows"
        )
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return documents.join(identity, "row").withColumnRenamed("key", key)


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: the key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest key stays; of equal rows one stays,
    and a null key yields to any other.  ``options`` are those of
    ``block_identities``.
    """
    rows = stored(block_identities(docs, key=key, **options), "identities")
    groups = stored(
        rows.groupBy("level", "name").agg(
            F.max(F.struct(F.col(key), F.col("row"))).alias("keep"),
            F.count(F.lit(1)).alias("group_size"),
        ), "identity-groups",
    )
    return rows.join(groups, ["level", "name"]).select(
        key, F.col(f"keep.{key}").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256",
    )
