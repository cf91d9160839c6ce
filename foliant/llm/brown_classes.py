"""Class-based n-gram language model with exchange clustering.

Words are put into classes so that the class bigrams of the training texts have
the largest likelihood: in each round every word looks at its neighbours' classes
and moves to the class that gains most, given the counts of the round before.
Half of the words, by a hash, may move in a round, so that words which follow
each other do not trade places forever.

A text's probability is the product, over its words and its end, of

    P(class | class before) * P(word | class),

the first smoothed towards the classes' own shares, the second by absolute
discounting: what is taken from a class's words is the chance of a word never
seen, which counts as one further entry of the vocabulary.  For each history
the probabilities of all words, the end and the unseen entry add up to one.

The vocabulary grows with the corpus, so no worker holds all of it.  Three
tiers share one model:

* the ``clustered`` most frequent words go through all rounds of the exchange;
* the words after them, up to the ``frequent`` most frequent, take one step: each
  joins the class that gains most, given the histories before it.  From then on all
  frequent words have their classes as histories;
* the rest count as one class as histories and take the same step.  They stay words,
  listed beside the numbers that texts are stored as, and meet their counts and
  classes in joins.

The driver holds the classes of the frequent words and tables of classes by classes; what a
word's step looks at is added up and judged in tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import once_per_worker, stored, words

#: Characters of text after which a task passes on what it has counted.
CHARACTERS_AT_ONCE = 1 << 23
#: Texts whose tokens are laid out in arrays at a time, and contexts scored at a time.
TEXTS_AT_ONCE, CONTEXTS_AT_ONCE = 500, 1 << 17


@dataclass(frozen=True)
class ClassRule:
    """Classes, words that are clustered and broadcast, rounds, smoothing of transitions.

    The arrays that workers and driver hold are bounded by these numbers; words
    beyond them are handled in tables, none is left out.
    """

    classes: int = 32
    clustered: int = 16_384
    frequent: int = 131_072
    rounds: int = 4
    smoothing: float = 32.0


# -- counts and numbers ------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, the words as binary; copies add up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0
        for batch in batches:
            for text in batch.column(0):
                own = words(text.as_py())
                counts.update(own)
                size += sum(map(len, own)) + len(own)
                if size > CHARACTERS_AT_ONCE:
                    yield _counted(counts)
                    counts, size = Counter(), 0
        if counts:
            yield _counted(counts)

    return texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
        ["word", "n"],
    )


def numbered(texts: DataFrame, frequent: Broadcast, name: tuple) -> DataFrame:
    """``texts``, a row, a flag, the other columns in one and a text, with ``numbers`` and ``others``.

    Frequent words have their ranks; any other word has the number after the
    last rank and is listed, in order, among the others.
    """

    def ranks() -> dict[bytes, int]:
        return once_per_worker(name, lambda: {w: i for i, w in enumerate(frequent.value)})

    @F.arrow_udf("struct<numbers:array<int>,others:array<binary>>")
    def number(column: pa.Array) -> pa.Array:
        known, rare = ranks(), len(ranks())
        parts, others, ends, other_ends = [], [], [0], [0]
        for text in column:
            own = words(text.as_py())
            found = np.array([known.get(word, rare) for word in own], dtype=np.int32)
            others += [own[i] for i in np.flatnonzero(found == rare).tolist()]
            parts.append(found)
            ends.append(ends[-1] + len(found))
            other_ends.append(len(others))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                pa.ListArray.from_arrays(
                    pa.array(other_ends, pa.int32()), pa.array(others, pa.binary())
                ),
            ],
            ["numbers", "others"],
        )

    return texts.withColumn("found", number(F.col("text"))).select(
        "row", "learnt", "own", "found.numbers", "found.others")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and where each begins and the last ends."""
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    return np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(lengths)])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into ones of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def _with_ends(lists: pa.Array, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in a row, each text followed by its end (``rare`` + 1).

    Also the texts' ends.  The end before a text is its first word's history,
    and one stands before the first text.
    """
    values, stops = _flat(lists)
    tokens = np.full(len(values) + len(stops), rare + 1, dtype=np.int64)
    text_of = np.repeat(np.arange(len(stops) - 1), np.diff(stops))
    tokens[np.arange(len(values)) + text_of + 1] = values
    return tokens, np.arange(1, len(stops)) + stops[1:]


# -- exchange ----------------------------------------------------------------


def _sums(numbers: DataFrame, size: int, keys_of, *columns: str) -> DataFrame:
    """(key, n): counts of keys below ``size`` over all rows, added up in tasks, then by key.

    ``keys_of`` gives the keys of a batch; ``size`` is a fixed number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in _parts(batches):
            for keys, weights in keys_of(batch):
                np.add.at(total, keys, 1 if weights is None else weights)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["key", "n"])

    return numbers.select(*columns).mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(
        F.sum("n").alias("n"))


def _summed(numbers: DataFrame, size: int, keys_of, *columns: str) -> np.ndarray:
    """The same counts as an array of ``size`` numbers."""
    summed = _sums(numbers, size, keys_of, *columns).toArrow()
    result = np.zeros(size, dtype=np.int64)
    result[summed.column("key").to_numpy()] = summed.column("n").to_numpy()
    return result


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _change(cells: np.ndarray, more: np.ndarray) -> np.ndarray:
    return _xlogx(cells + more) - _xlogx(cells)


def exchanged(
    left: np.ndarray, right: np.ndarray, own: np.ndarray, pairs: np.ndarray, k: int
) -> np.ndarray:
    """The class in which each word's likelihood gains most.

    ``left`` and ``right`` hold, per word, the counts of the history classes
    before and of the classes after it; ``pairs`` counts (history, class).  The
    gain is the change of the sum of x log x over the cells of ``pairs``, less
    that over its margins, once the word's counts are taken out of its own class.
    """
    result = own.copy()
    for w in np.flatnonzero(left.sum(axis=1) > 0).tolist():
        table = pairs.astype(np.float64)
        table[:, own[w]] -= left[w]
        table[own[w], :] -= right[w]
        np.maximum(table, 0, out=table)
        before, after = np.flatnonzero(left[w]), np.flatnonzero(right[w])
        gain = (
            _change(table[before, :k], left[w][before, None]).sum(axis=0)
            + _change(table[:k, after], right[w][None, after]).sum(axis=1)
            - _change(table.sum(axis=0)[:k], left[w].sum())
            - _change(table.sum(axis=1)[:k], right[w].sum())
        )
        result[w] = int(np.argmax(gain))
    return result


def joining_class(
    starts: np.ndarray, histories: np.ndarray, counts: np.ndarray, pairs: np.ndarray, k: int
) -> np.ndarray:
    """The class that gains most when words join it; word i has the cells from ``starts[i]`` on."""
    best = np.empty(len(starts), dtype=np.int64)
    stops = np.append(starts[1:], len(counts))
    margins = pairs.sum(axis=0)[None, :k].astype(np.float64)
    first = 0
    while first < len(starts):
        # Whole words, as many as have a bounded number of cells.
        last = max(first + 1, int(np.searchsorted(stops, starts[first] + CONTEXTS_AT_ONCE, "right")))
        low, high = starts[first], stops[last - 1]
        histories_here, counts_here = histories[low:high], counts[low:high].astype(np.float64)
        gains = _change(pairs[histories_here, :k].astype(np.float64), counts_here[:, None])
        inside = starts[first:last] - low
        gain = np.add.reduceat(gains, inside, axis=0)
        total = np.add.reduceat(counts_here, inside)
        best[first:last] = np.argmax(gain - _change(margins, total[:, None]), axis=1)
        first = last
    return best


# -- the model ---------------------------------------------------------------


@dataclass(frozen=True)
class Tables:
    """What scores numbered texts; every array has a size fixed by the rule."""

    history: np.ndarray  # class of each number as a history: words, other words, the end
    predicted: np.ndarray  # class of each number as a word
    counts: np.ndarray  # training count of each number
    transition: np.ndarray  # log10 P(class | history)
    emission: np.ndarray  # log10 of what a class's counts are divided by
    unseen: np.ndarray  # log10 P(never seen | history)
    discount: float
    tokens: int
    types: int


@dataclass(frozen=True)
class ClassModel:
    """The arrays, and two written tables: all texts numbered, and the other words."""

    rule: ClassRule
    tables: Tables
    numbers: DataFrame  # row, learnt, own (the texts' other columns), numbers, others
    others: DataFrame  # word, n, class


def train(texts: DataFrame, training: str, rule: ClassRule = ClassRule()) -> ClassModel:
    """Learn from the rows for which the boolean column ``training`` is true.

    ``texts`` has a column ``text`` and any others, whatever their names; null texts are empty
    and consist of their end.  All counts cover all training rows.
    """
    spark, k = texts.sparkSession, rule.classes
    learnt = texts.filter(training).select("text")
    words_n = stored(word_counts(learnt), "word-counts")
    total, types, once, twice = words_n.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("n"), F.count_if(F.col("n") == 1),
        F.count_if(F.col("n") == 2),
    ).first()
    top = words_n.orderBy(F.col("n").desc(), "word").limit(rule.frequent).toArrow()
    frequent, of_frequent = top["word"].to_pylist(), top["n"].to_numpy()
    rare, end = len(frequent), len(frequent) + 1
    name = ("brown-words", hash(tuple(frequent)))
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(training), F.lit(False)).alias("learnt"),
        F.struct(*[c for c in texts.columns if c != "text"]).alias("own"), "text")
    numbers = stored(
        numbered(rows, spark.sparkContext.broadcast(frequent), name), "numbered-texts")
    learnt = numbers.filter("learnt")
    ends = learnt.count()
    counts = np.append(of_frequent.astype(np.int64), [0, ends])

    # Histories: clustered words by class, then all frequent ones; all other words; the end.
    clustered = min(rule.clustered, rare)
    history = np.full(rare + 2, k, dtype=np.int64)
    history[:clustered] = np.arange(clustered) % k
    history[end] = k + 1
    for turn in range(rule.rounds):
        history = _round(learnt, history, clustered, rare, k, turn)
    if rare > clustered:
        pairs = _pairs(learnt, history, clustered, rare, k)
        history = _frequent_classes(learnt, history, pairs, clustered, rare, k)
    pairs, predicted = _pairs(learnt, history, rare, rare, k), history
    others = _other_classes(words_n, learnt, history, pairs, rare, k)
    sums = others.groupBy("class").agg(F.sum("n"), F.count("n")).collect()  # a row for each class
    class_total, class_types = np.zeros(k + 2), np.zeros(k + 2)
    np.add.at(class_total, predicted, counts)
    np.add.at(class_types, predicted[:rare], 1)
    for row in sums:
        class_total[row[0]] += row[1]
        class_types[row[0]] += row[2]
    pairs = pairs + _other_pairs(others, k)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    share = class_total / max(1, class_total.sum())
    chance = (pairs + rule.smoothing * share) / (
        pairs.sum(axis=1, keepdims=True) + rule.smoothing)
    left_over = discount * class_types / np.maximum(class_total, 1)
    unseen = chance @ left_over if class_total.any() else np.ones(k + 2)
    tables = Tables(
        history, predicted, counts, _log10(chance), _log10(class_total), _log10(unseen),
        discount, int(total) + ends, int(types) + (ends > 0),
    )
    return ClassModel(rule, tables, numbers, others.select("word", "n", "class"))


def _log10(x: np.ndarray) -> np.ndarray:
    """Logarithms, with a floor for zero."""
    return np.log10(np.maximum(x, 1e-300))


def _round(learnt, history, clustered, rare, k, turn) -> np.ndarray:
    """Classes after the words of one parity have moved."""
    width = k + 2
    size = clustered * 2 * width
    sent = learnt.sparkSession.sparkContext.broadcast(history)

    def keys(batch):
        of = sent.value
        tokens, _ = _with_ends(batch.column(0), rare)
        now, before = tokens[1:], tokens[:-1]
        left, right = now < clustered, before < clustered
        yield now[left] * 2 * width + of[before[left]], None
        yield before[right] * 2 * width + width + of[now[right]], None

    found = _summed(learnt, size, keys, "numbers").reshape(clustered, 2, width)
    left, right = found[:, 0], found[:, 1]
    own = history[:clustered]
    pairs = np.zeros((width, width), dtype=np.int64)
    np.add.at(pairs, own, right)
    outside = np.zeros((width, width), dtype=np.int64)  # histories that are not clustered
    np.add.at(outside.T, own, left)
    pairs[k:, :] = outside[k:, :]
    moving = np.arange(clustered) % 2 == turn % 2
    best = exchanged(left[moving], right[moving], own[moving], pairs, k)
    result = history.copy()
    result[:clustered][moving] = best
    return result


def _pairs(learnt, history, clustered, rare, k) -> np.ndarray:
    """Bigrams (history, class) whose word is clustered or the end."""
    width = k + 2
    sent = learnt.sparkSession.sparkContext.broadcast(history)

    def keys(batch):
        of = sent.value
        tokens, _ = _with_ends(batch.column(0), rare)
        now, before = tokens[1:], tokens[:-1]
        inside = (now < clustered) | (now > rare)
        yield of[before[inside]] * width + of[now[inside]], None

    return _summed(learnt, width * width, keys, "numbers").reshape(width, width)


def _frequent_classes(learnt, history, pairs, clustered, rare, k) -> np.ndarray:
    """Histories in which the frequent words that are not clustered have their classes, too.

    Each joins the class that gains most, given its histories before; they are judged in tasks.
    """
    width = k + 2
    sent = learnt.sparkSession.sparkContext.broadcast(history)

    def keys(batch):
        tokens, _ = _with_ends(batch.column(0), rare)
        now, before = tokens[1:], tokens[:-1]
        inside = (now >= clustered) & (now < rare)
        yield (now[inside] - clustered) * width + sent.value[before[inside]], None

    cells = _sums(learnt, (rare - clustered) * width, keys, "numbers")
    contexts = cells.groupBy(F.expr(f"key div {width}").alias("word")).agg(
        F.collect_list(F.expr(f"cast(key % {width} as int)")).alias("histories"),
        F.collect_list("n").alias("counts"))
    found = _joined(contexts, pairs, k, "word bigint").select("word", "class").toArrow()
    result = history.copy()
    result[clustered + found["word"].to_numpy()] = found["class"].to_numpy()
    # Words that no training text holds cannot be frequent, but all have a class.
    result[clustered:rare][result[clustered:rare] == k] = 0
    return result


def _joined(contexts: DataFrame, pairs: np.ndarray, k: int, names: str) -> DataFrame:
    """``contexts`` (names, then histories and counts, as lists) with the class each word joins."""
    sent = contexts.sparkSession.sparkContext.broadcast(pairs)
    columns = [n.split()[0] for n in names.split(", ")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            histories, stops = _flat(batch.column(len(columns)))
            counts, _ = _flat(batch.column(len(columns) + 1))
            best = (
                joining_class(stops[:-1], histories.astype(np.int64), counts, sent.value, k)
                if batch.num_rows else np.zeros(0, np.int64)
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best.astype(np.int32))],
                [*columns, "histories", "counts", "class"],
            )

    return contexts.select(*columns, "histories", "counts").mapInArrow(
        join, f"{names}, histories array<int>, counts array<bigint>, class int")


def _other_rows(numbers: DataFrame, history: np.ndarray, rare: int, *columns: str) -> DataFrame:
    """(columns, word, history) for each word that is not broadcast."""
    sent = numbers.sparkSession.sparkContext.broadcast(history)
    chosen = numbers.select("numbers", "others", *columns)
    types = "".join(f"{chosen.schema[c].dataType.simpleString()} " for c in columns).split()
    schema = ", ".join([*(f"{c} {t}" for c, t in zip(columns, types)),
                        "word binary, history int"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            tokens, ends = _with_ends(batch.column(0), rare)
            at = np.flatnonzero(tokens == rare)
            text_of = pa.array(np.searchsorted(ends, at))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(2 + i).take(text_of) for i in range(len(columns))),
                 batch.column(1).flatten(),
                 pa.array(sent.value[tokens[at - 1]].astype(np.int32))],
                [*columns, "word", "history"],
            )

    return chosen.mapInArrow(rows, schema)


def _other_classes(words_n, learnt, history, pairs, rare, k) -> DataFrame:
    """(word, n, class, contexts) of the words that are not broadcast."""
    contexts = _other_rows(learnt, history, rare).groupBy("word", "history").agg(
        F.count(F.lit(1)).alias("n")
    ).groupBy("word").agg(
        F.sum("n").alias("n"), F.collect_list("history").alias("histories"),
        F.collect_list("n").alias("counts"),
    )
    return stored(_joined(contexts, pairs, k, "word binary, n bigint"), "other-words")


def _other_pairs(others: DataFrame, k: int) -> np.ndarray:
    """Bigrams (history, class) whose word is not broadcast."""
    width = k + 2

    def keys(batch):
        histories, stops = _flat(batch.column(1))
        counts, _ = _flat(batch.column(2))
        of = np.repeat(np.asarray(batch.column(0)), np.diff(stops))
        yield histories.astype(np.int64) * width + of, counts

    return _summed(
        others, width * width, keys, "class", "histories", "counts"
    ).reshape(width, width)


# -- scoring -----------------------------------------------------------------


def scores(model: ClassModel, *columns: str) -> DataFrame:
    """``columns`` of the texts with the model's and the base's log10 probabilities.

    ``n_tokens`` counts words and the end, ``n_known`` those seen in training.
    ``base_score`` adds one to each count over all types and one unseen.
    """
    tables, numbers = model.tables, model.numbers
    rare = len(tables.counts) - 2
    scale = math.log10(tables.tokens + tables.types + 1)
    # Arrays and numbers alone: an instance would need this module on the executors.
    sent = numbers.sparkSession.sparkContext.broadcast(
        tuple(getattr(tables, f.name) for f in fields(Tables)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(*sent.value)
        word_logs = _log10(t.counts - t.discount) - t.emission[t.predicted]
        word_logs[rare + 1] = 0.0  # the end is its class's only word
        known = t.counts > 0
        base_logs = np.log10(t.counts + 1.0) - scale
        for batch in _parts(batches):
            tokens, ends = _with_ends(batch.column(1), rare)
            now, before = tokens[1:], tokens[:-1]
            of_text = np.searchsorted(ends, np.arange(1, len(tokens)))
            inside = now != rare
            now, before, of_text = now[inside], before[inside], of_text[inside]
            h = t.history[before]
            seen = known[now]
            logs = np.where(
                seen, t.transition[h, t.predicted[now]] + word_logs[now], t.unseen[h]
            )
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(of_text, minlength=n)),
                 pa.array(np.bincount(of_text, seen, minlength=n).astype(np.int64)),
                 pa.array(np.bincount(of_text, base_logs[now], minlength=n)),
                 pa.array(np.bincount(of_text, logs, minlength=n))],
                ["row", "n_tokens", "n_known", "base_score", "score"],
            )

    parts = "row bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    first = numbers.select("row", "numbers").mapInArrow(partial, parts)
    met = _other_rows(numbers, tables.history, rare, "row").join(model.others, "word", "left")
    lookup = numbers.sparkSession.createDataFrame(
        [(h, row.tolist(), float(u))
         for h, (row, u) in enumerate(zip(tables.transition, tables.unseen))],
        "history int, transition array<double>, unseen double",
    )  # a row for each class
    emission = F.array(*[F.lit(float(x)) for x in tables.emission])
    seen = F.col("n").isNotNull()
    second = met.join(F.broadcast(lookup), "history").select(
        "row", F.lit(1).cast("bigint").alias("n_tokens"),
        seen.cast("bigint").alias("n_known"),
        (F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(scale)).alias("base_score"),
        F.when(seen, F.element_at("transition", F.col("class") + 1)
               + F.log10(F.col("n") - F.lit(tables.discount))
               - F.element_at(emission, F.col("class") + 1))
        .otherwise(F.col("unseen")).alias("score"),
    )
    added = first.unionByName(second).groupBy("row").agg(
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )
    return numbers.select("row", "own").join(added, "row").select(
        *(F.col("own").getField(c).alias(c) for c in columns),
        "n_tokens", "n_known", "base_score", "score",
    ).withColumns({
        "train_tokens": F.lit(tables.tokens).cast("bigint"),
        "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")),
    })
