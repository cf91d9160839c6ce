"""Threshold joins and mined negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives as module
from foliant.llm.hard_negatives import MiningRule, PartialIndex, _tails, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def usable(row):
    _, label, vector = row[:3]
    return label is not None and vector is not None and all(
        x is not None and math.isfinite(x) for x in vector)


def expected(rows, anchors, rule=MiningRule()):
    rows = [(i, *r[:3]) for i, r in enumerate(rows) if usable(r)]

    def first(scored, k):
        return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]

    def score(a, b):
        return sum(int(x) * int(y) for x, y in zip(a, b))

    result = []
    for n, i, label, vector in rows:
        if not anchors(i):
            continue
        positives = first(
            [(score(vector, v), j) for m, j, l, v in rows if m != n and l == label], rule.positives)
        others = [(score(vector, v), j) for _, j, l, v in rows if l != label]
        for ps, j in positives:
            window = [(s, k) for s, k in others
                      if rule.least_percent * ps <= 100 * s <= rule.most_percent * ps]
            result += [(i, j, rank + 1, k, ps, s)
                       for rank, (s, k) in enumerate(first(window, rule.negatives))]
    return sorted(result, key=str)


def found(spark, rows, rule=MiningRule(), schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, hard_negatives(frame, F.expr("vec_id % 4 = 0"), rule).collect()), key=str)


def clustered(n, dim, seed, spread=60, labels=4):
    rng = random.Random(seed)
    centres = [[rng.randint(-99, 99) for _ in range(dim)] for _ in range(labels)]
    return [(i, label := rng.randrange(labels),
             [float(c + rng.randint(-spread, spread)) for c in centres[(label + (i % 5 == 0)) % labels]])
            for i in range(n)]


@pytest.mark.parametrize("dim,rule", [
    (3, MiningRule()), (20, MiningRule(rows_per_block=40, anchors_per_block=7)),
    (33, MiningRule(positives=2, negatives=3, positive_shares=(), negative_percents=())),
    (8, MiningRule(positives=9, negatives=40, least_percent=5, most_percent=99)),
])
def test_against_all_pairs(spark, dim, rule):
    rows = clustered(220, dim, dim)
    want = expected(rows, lambda i: i % 4 == 0, rule)
    assert len(want) > 50 and found(spark, rows, rule=rule) == want


def test_small_parts_and_ties(spark, monkeypatch):
    monkeypatch.setattr(module, "ANCHORS_AT_ONCE", 3)
    monkeypatch.setattr(module, "ROWS_AT_ONCE", 5)
    monkeypatch.setattr(module, "STEP", 2)
    rng = random.Random(2)
    # Few different vectors: scores tie, and rows are repeated.
    rows = [(rng.randrange(60), rng.randrange(3), [float(rng.randint(0, 2)) for _ in range(5)])
            for _ in range(120)]
    assert found(spark, rows) == expected(rows, lambda i: i % 4 == 0)


def test_odd_input(spark):
    nan, inf = math.nan, math.inf
    plain = [
        (0, 1, [3.0, 4.0]), (1, 1, [3.0, 4.0]), (2, 1, [-3.0, 4.0]), (3, 2, [2.0, 2.0]),
        (4, 2, [2.0, 2.0]), (4, 2, [2.0, 2.0]), (None, 2, [1.0, 2.0]), (None, 1, [5.0, 5.0]),
        (5, None, [1.0, 1.0]), (6, 1, None), (7, 1, [None, 1.0]), (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]),
        (12, 3, []), (16, 3, [0.0, 0.0]), (20, 4, [1.0]), (24, 4, [1.0, 1.0, 7.0]), (28, 5, [9.0, 0.0]),
    ]
    schema = SCHEMA + ", num long, id int, vector string, asks boolean, anchor long, window int, score int"
    more = (1, 2, "v", False, 3, 4, 5)
    want = expected(plain, lambda i: i is not None and i % 4 == 0)
    assert want and found(spark, [r + more for r in plain], schema=schema) == want
    assert found(spark, []) == []
    assert found(spark, [(0, None, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0])]) == []
    big = [(i, i % 2, [float(2**30 + i), float(-(2**29) - 7 * i), 3.0]) for i in range(12)]
    assert found(spark, big) == expected(big, lambda i: i % 4 == 0)  # beyond exact doubles


def test_a_partial_index_loses_no_pair_and_omits_dimensions():
    rng = np.random.default_rng(4)
    energy = np.r_[np.full(8, 40.0), np.full(56, 2.0)]
    rows, anchors = rng.normal(0, energy, (500, 64)), rng.normal(0, energy, (40, 64))
    scores = anchors @ rows.T
    low = np.sort(scores, axis=1)[:, -20]
    tails = _tails(anchors)
    index = PartialIndex(rows, (tails / low[:, None]).max(axis=0))
    alive = index.candidates(anchors, tails, low, 0, len(rows))
    assert (alive[scores[:, index.order] >= low[:, None]]).all()
    assert index.posted.sum() < 0.5 * rows.size / module.STEP  # over half of the index is omitted
    assert alive.mean() < 0.2
