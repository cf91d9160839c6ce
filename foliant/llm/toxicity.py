"""Toxicity by multiple-instance learning.

Only documents are labelled, but sentences offend.  A sentence's score is a
logistic function of the weights of its distinct words, and a document's score
is the noisy-or of its sentences: one minus the product of their chances to be
harmless.  The weights are fitted to document labels through the noisy-or, so
sentences of a toxic document share its blame by how much each explains.  The
same sentence scores then locate the offending sentences.

A word's features are itself and its beginnings, hashed, so that inflected or
compounded words share weights.  The model is fitted on a bounded sample of
labelled rows; every document is scored, whole.
"""

from __future__ import annotations

import re
import warnings
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.shared import once_per_worker

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
KEPT_WORDS = 100_000


@dataclass(frozen=True)
class FitRule:
    """The sample's bounds and the fit.

    ``rows_per_label`` and ``characters_per_label`` bound the sample of labelled keys that
    the classifier is fitted on.  Their texts are taken whole; nothing else is bounded.
    """

    rows_per_label: int = 3000
    characters_per_label: int = 40_000_000
    dimensions: int = 1 << 16
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7)
    epochs: int = 90
    rate: float = 0.1
    decay: float = 1e-4
    first_bias: float = -6.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    rule: FitRule


def features(word: str, rule: FitRule) -> list[int]:
    """Hashed features of a lower-case word."""
    import xxhash

    parts = {f"^{word}$"} | {f"^{word[:n]}" for n in rule.beginnings if len(word) >= n}
    return sorted({xxhash.xxh32_intdigest(part.encode()) % rule.dimensions for part in parts})


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of each sentence that has words."""
    for found in SENTENCE.finditer(text):
        words = set(WORD.findall(found.group().lower()))
        if words:
            yield found.start(), found.end(), words


def _noisy_or(harmless_logs: np.ndarray) -> np.ndarray:
    return -np.expm1(harmless_logs)


def fit(rows: Iterable[tuple], rule: FitRule, totals: tuple[int, int]) -> Model:
    """Fit on (text, label) rows; ``totals`` are all labelled rows by label, for their weights.

    A third value says how many rows the text stands for.

    Without rows of one label there is nothing to tell apart: the weights stay
    zero, and the bias leaves texts harmless.
    """
    rows = list(rows)
    weights = np.zeros(rule.dimensions)
    labels = np.array([row[1] for row in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(weights.astype(np.float32), -30.0, rule)
    # Words are kept once with their features, and sentences as words.
    known: dict[str, int] = {}
    at, of_word = array("i"), array("i")
    word_at, of_sentence, of_document = array("i"), array("i"), array("i")
    for document, row in enumerate(rows):
        for _, _, words in sentences(row[0] or ""):
            for word in sorted(words):
                if word not in known:
                    own = features(word, rule)
                    at.extend(own)
                    of_word.extend([len(known)] * len(own))
                    known[word] = len(known)
                word_at.append(known[word])
                of_sentence.append(len(of_document))
            of_document.append(document)
    at, of_word, word_at, of_sentence, of_document = (
        np.asarray(a) for a in (at, of_word, word_at, of_sentence, of_document))
    copies = np.array([row[2] if len(row) > 2 else 1 for row in rows])
    share = np.array([totals[y] / max(1, int(copies[labels == y].sum())) for y in (0, 1)])[labels]
    share = share * copies
    share = share / share.sum()
    bias, first, second = rule.first_bias, np.zeros(rule.dimensions + 1), np.zeros(
        rule.dimensions + 1)
    positive = labels[of_document] == 1
    for step in range(1, rule.epochs + 1):
        of_words = np.bincount(of_word, weights[at], minlength=len(known))
        logits = bias + np.bincount(of_sentence, of_words[word_at], minlength=len(of_document))
        chance = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        harmless = np.log1p(-np.minimum(chance, 1 - 1e-9))
        toxic = np.maximum(
            _noisy_or(np.bincount(of_document, harmless, minlength=len(rows))), 1e-9
        )
        blame = np.where(positive, -chance * ((1 - toxic) / toxic)[of_document], chance)
        blame *= share[of_document]
        word_blame = np.bincount(word_at, blame[of_sentence], minlength=len(known))
        slope = np.append(
            np.bincount(at, word_blame[of_word], minlength=rule.dimensions) + rule.decay * weights,
            blame.sum(),
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = rule.rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return Model(weights.astype(np.float32), float(bias), rule)


def train(
    docs: DataFrame, labels: DataFrame, *, training: Column, rule: FitRule = FitRule(),
    key: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """Fit on a sample of the labelled documents for which ``training``, on the key, holds.

    At most ``rows_per_label`` keys per label that have a text are taken in the
    order of a hash of the key, as long as the texts before have fewer than
    ``characters_per_label`` characters; their texts are found by a scan that joins this
    bounded list.  Of repeated keys the larger label counts, and one text for
    all their rows; null
    keys and labels are left out.  A label without rows is warned of.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & training).groupBy(
        key).agg(F.max(label).cast("int").alias("_label"))
    counts = dict(marked.groupBy("_label").count().collect())  # two rows
    order = [F.xxhash64(key), F.col(key)]
    present = docs.filter(F.col(text).isNotNull()).select(key)
    usable = marked.join(present, key, "left_semi")
    chosen = None
    for value in (0, 1):
        some = usable.filter(F.col("_label") == value).orderBy(*order).limit(rule.rows_per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.filter(F.col(text).isNotNull()).select(key, text).join(F.broadcast(chosen), key)
    least = F.min(F.struct(F.xxhash64(text), F.col(text).alias("text"))).getField("text")
    grouped = rows.groupBy(key, "_label").agg(least.alias("_text"), F.count(F.lit(1)).alias("_copies"))
    before = F.sum(F.length("_text")).over(Window.partitionBy("_label").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1))
    within = grouped.withColumn("_before", F.coalesce(before, F.lit(0))).filter(
        F.col("_before") < rule.characters_per_label)
    sample = [row[1:] for row in sorted(
        tuple(row) for row in within.select(key, "_text", "_label", "_copies").collect())]
    for value in {0, 1} - {row[1] for row in sample}:
        warnings.warn(f"no text with {label} = {value} to fit on: every text will count as harmless")
    return fit(sample, rule, (counts.get(0, 0), counts.get(1, 0)))


class Scorer:
    """Sentence and document scores; a word's summed weight is kept."""

    def __init__(self, model: Model):
        self.model = model
        self.kept: dict[str, float] = {}

    def weight(self, word: str) -> float:
        known = self.kept.get(word)
        if known is None:
            known = float(self.model.weights[features(word, self.model.rule)].sum())
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = known
        return known

    def score(self, text: str | None, offending: float) -> tuple[float, list[dict]]:
        found, logits = [], []
        for start, end, words in sentences(text or ""):
            # In sorted order, so that the sum does not depend on the process.
            logits.append(self.model.bias + sum(map(self.weight, sorted(words))))
            found.append((start, end))
        chance = 1 / (1 + np.exp(-np.clip(np.array(logits), -30, 30)))
        total = float(_noisy_or(np.log1p(-np.minimum(chance, 1 - 1e-12)).sum()))
        return total, [
            {"start": found[i][0], "end": found[i][1], "score": float(chance[i])}
            for i in np.flatnonzero(chance >= offending).tolist()
        ]


_RESULT = "struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>"


def judge(spark: SparkSession, model: Model, *, offending: float = 0.5):
    """Column function: a text's score and offending sentences."""
    # Arrays and numbers alone: an instance would need this module on the executors.
    sent, rule = spark.sparkContext.broadcast((model.weights, model.bias)), model.rule
    name = ("toxicity", hash(model.weights.tobytes()), model.bias)
    kind = pa.struct([
        ("score", pa.float64()),
        ("sentences", pa.list_(pa.struct([
            ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
        ]))),
    ])

    @F.arrow_udf(_RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        scorer = once_per_worker(name, lambda: Scorer(Model(*sent.value, rule)))
        found = (scorer.score(t.as_py(), offending) for t in texts)
        return pa.array([{"score": s, "sentences": where} for s, where in found], type=kind)

    return judged


def toxicity(
    docs: DataFrame, model: Model, *, text: str = "text", offending: float = 0.5
) -> DataFrame:
    """``docs`` with ``toxicity``: the score from 0 to 1 and the offending sentences.

    A column of that name is replaced.  Sentences have character offsets.  Null
    and empty texts score 0.  Rows are scored one by one, so repeated rows have
    the same score.
    """
    judged = judge(docs.sparkSession, model, offending=offending)
    return docs.withColumn("toxicity", judged(F.col(text)))
