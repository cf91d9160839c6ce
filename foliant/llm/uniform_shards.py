"""A uniform shuffle into shards of exact sizes by a hypergeometric matrix.

The rows of a uniformly shuffled table that one partition sends to each shard
follow a multivariate hypergeometric law.  So the counts can be drawn first,
exactly, from the sizes of the partitions and of the shards alone.  Then every
partition permutes its rows and deals them out by its counts, the rows are
exchanged, and each shard permutes what it got: every order of the whole table
is equally likely (up to the generators), and shard sizes are exact.

* The matrix is never built.  It is the leaf level of a tree that halves the
  range of partitions and splits the shards' capacities between the halves;
  each node's draw is seeded by its range, so a task draws the nodes on the
  way to its own row again, and only the partition sizes travel.
* A shard is cut into buckets of a bounded number of rows, which stand in the
  matrix in its stead.  As their sizes are known beforehand, so is the first
  slot of each, and no task ever holds or orders a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import stored

ROWS_PER_BUCKET = 50_000
#: Populations up to which numpy draws hypergeometric numbers.
DIRECT = 1_000_000_000
PLACE_BITS = 33  # of monotonically_increasing_id
#: Partitions whose row of the matrix a task keeps.
PARTITIONS_HELD = 8


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Row counts at most one apart; the first shards have the larger ones."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def bucket_sizes(rows: int, shards: int, rows_per_bucket: int) -> list[list[int]]:
    """Sizes of each shard's buckets."""
    return [
        shard_sizes(size, max(1, -(-size // rows_per_bucket))) for size in shard_sizes(rows, shards)
    ]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good + bad`` without replacement, for any population.

    Beyond ``DIRECT``, numpy's limit, by inversion of the probabilities within twelve standard
    deviations of the mode, in double precision: what lies outside has a chance below 1e-30, and
    each probability a relative error of about 1e-10.
    """
    if good + bad < DIRECT:
        return int(rng.hypergeometric(good, bad, drawn)) if good + bad else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = (drawn + 1) * (good + 1) // (good + bad + 2)
    spread = math.sqrt(drawn * (good / (good + bad)) * (bad / (good + bad))) + 1
    around = np.arange(
        max(low, int(mode - 12 * spread)), min(high, int(mode + 12 * spread)) + 1, dtype=np.float64
    )
    steps = np.log(good - around[:-1]) + np.log(drawn - around[:-1]) - np.log(
        around[1:]) - np.log(bad - drawn + around[1:])
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(weights - weights.max()))
    return int(around[np.searchsorted(weights, rng.random() * weights[-1], side="right")])


def split(rng: np.random.Generator, capacities: np.ndarray, drawn: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``drawn`` rows from capacities."""
    taken, left = np.zeros_like(capacities), int(capacities.sum())
    for i, capacity in enumerate(capacities.tolist()):
        left -= capacity
        taken[i] = hypergeometric(rng, capacity, left, drawn)
        drawn -= int(taken[i])
        if not drawn:
            break
    return taken


def matrix_row(
    seed: int, until: np.ndarray, capacities: np.ndarray, partition: int
) -> np.ndarray:
    """Rows that one partition sends to each bucket.

    ``until`` holds the rows before each partition and, last, of all.
    """
    low, high = 0, len(until) - 1
    own = capacities.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split(rng, own, int(until[middle] - until[low]))
        low, high, own = (low, middle, left) if partition < middle else (middle, high, own - left)
    return own


def uniform_shards(
    docs: DataFrame, shards: int, *, seed: int = 0, key: str = "doc_id",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, the row's place in its shard from 0.

    Columns of those names are replaced; all others stay, nulls included.
    Repeated rows are rows like any other.  The order depends on the seed and
    on how the rows lie in partitions; rows and their places are written
    below the shared folder between the two permutations.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = stored(
        docs.select(*own).withColumns({
            "_shards_part": F.spark_partition_id(),
            "_shards_key": F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id()),
        }).sortWithinPartitions("_shards_key").withColumn(
            "_shards_place", F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)
        ), "shard-rows",
    )
    # One number for each partition of the input.
    counts = dict(placed.groupBy("_shards_part").count().collect())
    parts = sorted(counts)
    until = np.cumsum([0, *(counts[p] for p in parts)])
    rows = int(until[-1])
    buckets = bucket_sizes(rows, shards, rows_per_bucket)
    capacities = np.array([size for shard in buckets for size in shard], dtype=np.int64)
    shard_of = np.repeat(np.arange(shards), [len(shard) for shard in buckets])
    first = np.concatenate([np.cumsum([0, *shard[:-1]]) for shard in buckets])
    sent = docs.sparkSession.sparkContext.broadcast((until, capacities, parts))

    @F.arrow_udf("int")
    def bucket(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        until, capacities, parts = sent.value
        drawn: dict[int, np.ndarray] = {}  # a task has the rows of one partition after another
        for part, place in batches:
            part, place = np.asarray(part), np.asarray(place)
            found = np.zeros(len(part), dtype=np.int32)
            for p in np.unique(part).tolist():
                if p not in drawn:
                    if len(drawn) >= PARTITIONS_HELD:
                        drawn.clear()
                    drawn[p] = np.cumsum(matrix_row(seed, until, capacities, parts.index(p)))
                mine = part == p
                found[mine] = np.searchsorted(drawn[p], place[mine], side="right")
            yield pa.array(found, type=pa.int32())

    dealt = placed.withColumn("_shards_bucket", bucket("_shards_part", "_shards_place"))
    again = F.xxhash64(F.lit(seed + 1), F.col("_shards_key"))
    local = F.row_number().over(Window.partitionBy("_shards_bucket").orderBy(again)) - 1
    of_bucket = docs.sparkSession.createDataFrame(
        [(i, int(s), int(f)) for i, (s, f) in enumerate(zip(shard_of, first))],
        "_shards_bucket int, shard int, _shards_first bigint",
    )  # a row for each bucket
    return (
        dealt.withColumn("_shards_local", local)
        .join(F.broadcast(of_bucket), "_shards_bucket")
        .select(*own, "shard", (F.col("_shards_first") + F.col("_shards_local")).alias("slot"))
    )
