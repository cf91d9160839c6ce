"""Hard negatives by threshold joins over a partial inverted index.

For each anchor and each of its best rows of the same label (its positives), the best
rows of other labels whose score lies in a window below the positive's score.

A threshold join finds the rows whose inner product with an anchor reaches the anchor's
threshold.  Dimensions are taken in one order, most energy first, and a block of rows is
posted by dimension only until the norm of a row's remaining dimensions, times the
largest remaining norm of any anchor, can no longer reach a threshold; the rest of the row
is omitted from the index.  Partial scores are accumulated posting list by posting list, a
pair goes as soon as its partial score plus the product of the remaining norms stays below
the threshold, and what is left is scored exactly from the whole vectors.

Thresholds start high and are lowered only for the windows that are not yet full, so that
most anchors never see the long tail of rows.  The last threshold is the window's own lower
end (for positives, none), so results are exact.

Rows and anchors meet on a grid of bounded blocks; a task returns the first rows of every
window, never its pairs.  Vectors hold integers, as doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import stored

#: Dimensions in a posting step; anchors and rows scored at once; share of pairs worth gathering.
STEP, ANCHORS_AT_ONCE, ROWS_AT_ONCE, FEW = 8, 256, 4096, 1 / 16
EXACT = 2.0**53
_LARGEST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class MiningRule:
    """``positives`` rows of the anchor's label, ``negatives`` rows of other labels for each.

    A negative's score lies between ``least_percent`` and ``most_percent`` of the positive's.
    Thresholds of the join, in turn: these shares of the anchor's product with itself, then
    none, for positives; these percents of the positive's score, then ``least_percent``, for
    negatives.
    """

    positives: int = 5
    negatives: int = 10
    least_percent: int = 30
    most_percent: int = 90
    positive_shares: tuple[float, ...] = (0.8, 0.5, 0.2)
    negative_percents: tuple[int, ...] = (75, 60, 45)
    rows_per_block: int = 1 << 16
    anchors_per_block: int = 1 << 14


def is_usable(vector: Column) -> Column:
    """True for vectors without null, infinite or undefined components."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


# -- one block of rows against one block of anchors ---------------------------


def matrix(lists: pa.ChunkedArray | pa.Array, order: np.ndarray) -> np.ndarray:
    """Vectors as rows with dimensions in the given order; missing ones count as zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    full = np.zeros((len(sizes), len(order)))
    full[np.repeat(np.arange(len(sizes)), sizes),
         np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return full[:, order]


def _tails(vectors: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from each posting step on; the last column is zero."""
    steps = -(-vectors.shape[1] // STEP)
    padded = np.zeros((len(vectors), steps * STEP))
    padded[:, : vectors.shape[1]] = vectors
    squares = (padded * padded).reshape(len(vectors), steps, STEP).sum(axis=2)
    tails = np.zeros((len(vectors), steps + 1))
    tails[:, :-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return tails


class PartialIndex:
    """Rows posted by dimension until their suffix cannot reach a threshold.

    ``reach`` bounds, for each step, the remaining norm of any anchor over its threshold: a
    row's dimensions from a step on are omitted if its remaining norm there times
    ``reach`` is below one.  Rows come in the order of their posted steps, so that each
    posting list is a range of them.
    """

    def __init__(self, vectors: np.ndarray, reach: np.ndarray):
        tails = _tails(vectors)
        posted = ((tails * reach[None, :] >= 1)[:, :-1]).sum(axis=1)
        self.order = np.argsort(-posted, kind="stable")
        self.vectors, self.tails = vectors[self.order], tails[self.order]
        self.posted = posted[self.order]

    def candidates(
        self, anchors: np.ndarray, tails: np.ndarray, low: np.ndarray, first: int, last: int,
    ) -> np.ndarray:
        """Which of the rows first to last may reach each anchor's threshold ``low``."""
        posted = self.posted[first:last]
        rows, ends = self.vectors[first:last], self.tails[first:last]
        scores = np.zeros((len(anchors), len(rows)))
        alive = np.broadcast_to(posted > 0, scores.shape).copy()
        slack = 1e-9 * np.outer(tails[:, 0], ends[:, 0]) + 1e-6
        for step in range(int(posted.max(initial=0))):
            listed = int(np.searchsorted(-posted, -step, side="left"))
            part = slice(step * STEP, (step + 1) * STEP)
            scores[:, :listed] += anchors[:, part] @ rows[:listed, part].T
            at = np.minimum(posted, step + 1)
            rest = tails[:, at] * ends[np.arange(len(rows)), at]
            alive &= scores + rest + slack >= low[:, None]
            if alive.sum() < FEW * alive.size:
                break
        return alive


def _exact_scores(
    anchors: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray, exact: bool,
) -> np.ndarray:
    """Inner products of the chosen pairs as 64-bit integers; those beyond are held at the ends."""
    if not exact:
        return np.array([
            max(-_LARGEST, min(_LARGEST, sum(int(x) * int(y) for x, y in zip(anchors[a], rows[b]))))
            for a, b in zip(i, j)
        ], dtype=np.int64)
    if len(i) > FEW * len(anchors) * len(rows):
        return (anchors @ rows.T)[i, j].astype(np.int64)
    found = [
        np.einsum("ij,ij->i", anchors[i[at: at + (1 << 16)]], rows[j[at: at + (1 << 16)]])
        for at in range(0, len(i), 1 << 16)
    ]
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _first(
    keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, nums: np.ndarray, k: int,
) -> np.ndarray:
    """Positions of the first ``k`` of each key: higher scores, then smaller ids, first."""
    order = np.lexsort((nums, ids, -scores, keys))
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else keys
    sizes = np.diff(np.r_[starts, len(keys)])
    return order[np.arange(len(keys)) - np.repeat(starts, sizes) < k]


def block_search(rows: dict, asked: dict, k: int, same_label: bool) -> Iterator[tuple]:
    """(anchor, window, row, score) positions of the first ``k`` rows of every window.

    ``rows``: vectors, labels, ids, nums.  ``asked``: vectors, labels, nums, and the windows as
    ``of`` (position of the anchor), ``low`` and ``high``.
    """
    if not len(rows["nums"]) or not len(asked["of"]):
        return
    anchors = asked["vectors"]
    low = np.full(len(anchors), np.inf)
    np.minimum.at(low, asked["of"], asked["low"].astype(float))
    tails = _tails(anchors)
    # What is at or below zero is reached by any rest, so nothing may be omitted then.
    ratio = tails / np.maximum(low, 1e-300)[:, None]
    ratio[low <= 0] = np.inf
    reach = ratio.max(axis=0) * (1 + 1e-9)
    reach[~np.isfinite(reach)] = 1e300
    with np.errstate(over="ignore"):
        index = PartialIndex(rows["vectors"], reach)
    if (low <= 0).any():  # also rows of zeros reach such a threshold
        index.posted = np.full(len(index.posted), tails.shape[1] - 1)
    top = max(np.abs(anchors).max(initial=0), np.abs(index.vectors).max(initial=0))
    exact = top * top * anchors.shape[1] < EXACT
    labels, ids, nums = (rows[c][index.order] for c in ("labels", "ids", "nums"))
    by_anchor = np.argsort(asked["of"], kind="stable")
    of = asked["of"][by_anchor]
    for begin in range(0, len(anchors), ANCHORS_AT_ONCE):
        end = min(begin + ANCHORS_AT_ONCE, len(anchors))
        windows = by_anchor[np.searchsorted(of, begin): np.searchsorted(of, end)]
        kept = [np.zeros(0, np.int64)] * 3
        for first in range(0, len(nums), ROWS_AT_ONCE):
            last = min(first + ROWS_AT_ONCE, len(nums))
            alike = asked["labels"][begin:end, None] == labels[None, first:last]
            other = asked["nums"][begin:end, None] != nums[None, first:last]
            alive = (alike & other) if same_label else ~alike
            alive &= index.candidates(
                anchors[begin:end], tails[begin:end], low[begin:end], first, last)
            i, j = np.nonzero(alive)
            scores = _exact_scores(anchors[begin:end], index.vectors[first:last], i, j, exact)
            # The pairs of an anchor are a range; its windows each look through them.
            starts = np.searchsorted(i, asked["of"][windows] - begin)
            sizes = np.searchsorted(i, asked["of"][windows] - begin, side="right") - starts
            for some in _bounded(sizes):
                pair = np.repeat(starts[some] - (np.cumsum(sizes[some]) - sizes[some]),
                                 sizes[some]) + np.arange(sizes[some].sum())
                window = np.repeat(windows[some], sizes[some])
                inside = (scores[pair] >= asked["low"][window]) & (
                    scores[pair] <= asked["high"][window])
                pair, window = pair[inside], window[inside]
                row = j[pair] + first
                best = _first(window, scores[pair], ids[row], nums[row], k)
                found = window[best], row[best], scores[pair][best]
                kept = [np.concatenate(both) for both in zip(kept, found)]
        window, row, scores = kept
        best = _first(window, scores, ids[row], nums[row], k)
        yield window[best], index.order[row[best]], scores[best]


def _bounded(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of windows with some million pairs together, unless one has more."""
    begin = 0
    while begin < len(sizes):
        end = begin + 1 + int(np.searchsorted(np.cumsum(sizes[begin + 1:]), 1 << 21))
        yield slice(begin, end)
        begin = end


# -- all rows -------------------------------------------------------------------


def _energy(vectors: DataFrame) -> np.ndarray:
    """Sum of squares of each dimension, one number for each."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for batch in batches:
            lists = batch.column("vector")
            size = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
            own = np.square(matrix(lists, np.arange(size))).sum(axis=0)
            longer, shorter = (own, total) if len(own) > len(total) else (total, own)
            longer[: len(shorter)] += shorter
            total = longer
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], names=["d", "e"])

    rows = vectors.select("vector").mapInArrow(summed, "d bigint, e double").groupBy("d").agg(
        F.sum("e").alias("e")).collect()
    energy = np.zeros(len(rows))
    for row in rows:
        energy[row.d] = row.e
    return energy


class ThresholdJoin:
    """Vectors as a written table, joined with anchors above thresholds.

    ``vectors``: num (a number of the row), id, label (a string), vector.
    """

    def __init__(self, vectors: DataFrame, rule: MiningRule):
        self.vectors, self.rule = vectors, rule
        self.order = np.argsort(-_energy(vectors), kind="stable")
        partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.row_blocks = max(-(-vectors.count() // rule.rows_per_block), partitions)

    def first(self, anchors: DataFrame, windows: DataFrame, k: int, same_label: bool) -> DataFrame:
        """(anchor, window, num, id, score) of the first ``k`` rows in each window of an anchor.

        ``windows``: anchor (a num), window (a number of an anchor's window), low, high.
        """
        order, blocks = self.order, self.row_blocks
        asked = windows.groupBy("anchor").agg(
            F.collect_list(F.struct("window", "low", "high")).alias("windows"))
        asked = anchors.select("num", "label", "vector").join(
            asked, F.col("num") == F.col("anchor")).drop("anchor")
        many = max(1, -(-asked.count() // self.rule.anchors_per_block))

        def dealt(side: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
            return side.withColumn(own, F.expr(f"cast(pmod(xxhash64(num), {n_own}) as int)")).withColumn(
                other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

        left = dealt(self.vectors, "row_block", blocks, "anchor_block", many)
        right = dealt(asked, "anchor_block", many, "row_block", blocks)
        right = right.toDF(*right.columns)  # columns of its own, for the cogroup

        def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
            both = pa.chunked_array(
                rows["label"].chunks + asked["label"].chunks, pa.string()
            ).combine_chunks().dictionary_encode().indices.to_numpy()
            ids, nums = rows["id"].combine_chunks(), rows["num"].to_numpy()
            lists = asked["windows"].combine_chunks()
            window = lists.flatten()
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            anchor = asked["num"].to_numpy()
            parts = list(block_search(
                {"vectors": matrix(rows["vector"], order), "labels": both[: len(nums)],
                 "ids": ids.fill_null(_LARGEST).to_numpy(), "nums": nums},
                {"vectors": matrix(asked["vector"], order), "labels": both[len(nums):],
                 "nums": anchor, "of": of, "low": window.field("low").to_numpy(),
                 "high": window.field("high").to_numpy()}, k, same_label))
            w, row, scores = (
                np.concatenate(c) if parts else np.zeros(0, np.int64) for c in
                (zip(*parts) if parts else [()] * 3))
            return pa.table({
                "anchor": anchor[of[w]], "window": window.field("window").take(pa.array(w)),
                "num": nums[row], "id": ids.take(pa.array(row)), "score": scores})

        keys = ("row_block", "anchor_block")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            search, "anchor bigint, window int, num bigint, id bigint, score bigint")
        best = Window.partitionBy("anchor", "window").orderBy(
            F.desc("score"), F.asc_nulls_last("id"), "num")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def lowered(
        self, anchors: DataFrame, windows: DataFrame, lows: list[Column], k: int, same_label: bool,
    ) -> DataFrame:
        """The first ``k`` rows of all windows, each threshold tried only for windows not full yet.

        The last of ``lows`` is the windows' own lower end.
        """
        done, waiting = [], windows
        for turn, low in enumerate(lows):
            found = stored(
                self.first(anchors, waiting.withColumn("low", low), k, same_label), "window-rows")
            last = turn == len(lows) - 1
            full = found.filter(F.col("rank") == k).select("anchor", "window")
            done.append(found if last else found.join(full, ["anchor", "window"], "left_semi"))
            if not last:
                waiting = stored(
                    waiting.join(full, ["anchor", "window"], "left_anti"), "open-windows")
                if waiting.isEmpty():
                    break
        rows = done[0]
        for more in done[1:]:
            rows = rows.unionByName(more)
        return rows


def hard_negatives(
    vectors: DataFrame, anchors: Column, rule: MiningRule = MiningRule(), *, id: str = "vec_id",
    label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` holds an integer id, a label, and vectors of whole numbers; ``anchors`` is a
    condition on its columns.  Scores are inner products.  Positives are the first rows of
    the anchor's label other than the anchor's own row; for each, negatives are the first rows of
    other labels with a score in the window, ranked from 1.  Higher scores come first,
    ties by smaller id, rows without an id last.

    Rows with a null label or vector, or with a null, infinite or undefined component, take no
    part.  Repeated rows and ids are rows of their own: each may be an anchor, a positive and
    a negative.  Vectors of different lengths are filled up with zeros, so an empty one
    scores zero.  A positive with a negative score has no negatives.  Scores beyond 64 bits are
    held at the ends of the range.  Other columns are not read; an empty table gives no rows.
    """
    usable = vectors.filter(F.col(label).isNotNull() & is_usable(F.col(vector))).select(
        F.monotonically_increasing_id().alias("num"), F.col(id).cast("bigint").alias("id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    usable = stored(usable, "vectors")
    asking, rows = usable.filter("asks").drop("asks"), usable.drop("asks")
    join = ThresholdJoin(rows, rule)
    own = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    most = F.lit(_LARGEST)
    whole = asking.select(
        F.col("num").alias("anchor"), F.lit(0).alias("window"), F.least(own, F.lit(9e18)).alias("own"),
        most.alias("high"))
    shares = [F.ceil(F.lit(s) * F.col("own")) for s in rule.positive_shares]
    # Nothing is below the lowest number; a threshold that is not above zero omits nothing.
    positives = stored(
        join.lowered(asking, whole, [*shares, -most], rule.positives, True).select(
            "anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score")), "positives")

    def percent(of: int, rounded) -> Column:
        share = F.lit(of).cast("decimal(3,0)") * F.lit("0.01").cast("decimal(2,2)")
        return rounded(F.col("positive_score").cast("decimal(20,0)") * share).cast("bigint")

    windows = positives.filter("positive_score >= 0").select(
        "anchor", "window", "positive_score", percent(rule.most_percent, F.floor).alias("high"))
    least = percent(rule.least_percent, F.ceil)
    lows = [F.greatest(least, percent(p, F.ceil)) for p in rule.negative_percents]
    negatives = join.lowered(asking, windows, [*lows, least], rule.negatives, False)
    named = asking.select(F.col("num").alias("anchor"), F.col("id").alias("anchor_id"))
    return negatives.select(
        "anchor", "window", "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    ).join(positives, ["anchor", "window"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
