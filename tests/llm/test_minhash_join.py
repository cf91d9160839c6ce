"""The inverted join of signatures against all pairs of sets in plain Python."""

import random

import numpy as np
import pytest

from foliant.llm.minhash_join import (
    JoinRule, _keys, candidate_links, list_links, minhash_components, signature,
)
from foliant.llm.shared import stored, table, words
from foliant.llm.simhash import hash_set

SCHEMA = "doc_id long, text string"


def shingle_set(text, size=2):
    found = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i: i + size]) for i in range(len(found) - size + 1))


def expected(rows, percent=80, size=2):
    sets = [shingle_set(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None and sets[i]:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key, len(s), least.get(root(i)) if s else key)
                   for i, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows, rule=JoinRule(), schema=SCHEMA):
    return sorted(map(tuple, minhash_components(spark.createDataFrame(rows, schema), rule).collect()),
                  key=str)


def edited(rng, tokens, edits):
    tokens = list(tokens)
    for _ in range(edits):
        tokens[rng.randrange(len(tokens))] = f"x{rng.randrange(10**6)}"
    return tokens


def families(seed, n, length, most_edits, vocabulary=300):
    """Texts around some common ones, at similarities on both sides of the threshold."""
    rng = random.Random(seed)
    stems = [rng.choices([f"w{i}" for i in range(vocabulary)], k=length) for _ in range(6)]
    return [(i, " ".join(edited(rng, rng.choice(stems), rng.randint(0, most_edits)))) for i in range(n)]


@pytest.mark.parametrize("length,most", [(6, 2), (30, 5), (120, 16)])
def test_against_all_pairs(spark, length, most):
    rows = families(length, 150, length, most)
    want = expected(rows)
    assert 10 < len({c for _, _, c in want}) < 140
    assert found(spark, rows) == want


def test_crowded_lists_in_blocks(spark):
    rows = families(8, 160, 60, 7)
    assert found(spark, rows, JoinRule(list_block=6, bucket=20)) == expected(rows)


def test_a_chain_within_a_group_of_candidates(spark):
    """Links exist only between neighbours, while all are candidates of the first."""
    tokens = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(9):
        rows.append((i, " ".join(tokens)))
        tokens = [f"n{i}.{k}" for k in range(3)] + tokens[:-3]
    want = expected(rows)
    assert {c for _, _, c in want} == {0}
    assert found(spark, rows) == want


def test_odd_input(spark):
    long_text = " ".join(f"w{i % 997} v{i % 13}" for i in range(120_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (5, "one"), (6, "two words"),
        (7, "Two  words\n"), (None, "two words"), (None, "null key alone"), (8, long_text),
        (9, long_text + " end"), (10, "é É"), (11, "É É"), (None, None), (2, ""), (12, "a a a a"),
        (13, "a a"),
    ]
    schema = SCHEMA + ", key string, own string, n int, id long, values int, root long, token long"
    more = ("k", "o", 1, 2, 3, 4, 5)
    want = expected(rows)
    assert found(spark, [r + more for r in rows], schema=schema) == want
    assert found(spark, [], schema=SCHEMA) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1)]


def test_other_sizes_and_percents(spark):
    rows = families(21, 120, 40, 12)
    rule = JoinRule(shingle=1, percent=60, coordinates=200, matches=80)
    assert found(spark, rows, rule) == expected(rows, 60, 1)


def test_no_candidate_pair_is_lost(spark):
    """All pairs that agree in enough coordinates are connected, and few others are."""
    rows = families(5, 200, 50, 10, vocabulary=40)
    rule = JoinRule(list_block=30, bucket=64)
    keys = _keys(rule)
    sets = [hash_set(words(text), 2) for _, text in rows]
    values = np.array([signature(s, keys) for s in sets])
    texts = stored(spark.createDataFrame(
        [(i, len(s), [int(x) for x in v.view(np.int32)], bytearray(v.astype(np.uint8).tobytes()))
         for i, (s, v) in enumerate(zip(sets, values))],
        "id long, n long, values array<int>, marks binary"), "test-texts")
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in candidate_links(texts, rule).collect():
        assert (values[a].astype(np.uint8) == values[b].astype(np.uint8)).sum() >= rule.matches
        parent[root(a)] = root(b)
    for i in range(len(rows)):
        for j in range(i):
            near = min(len(sets[i]), len(sets[j])) * 100 >= 80 * max(len(sets[i]), len(sets[j]))
            if near and (values[i] == values[j]).sum() >= rule.matches:
                assert root(i) == root(j)


def test_signatures_estimate_the_similarity():
    rng, keys = np.random.default_rng(3), _keys(JoinRule())
    agreed = []
    for _ in range(400):
        own = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        a, b = own[:90], own[10:]  # 80 of 100
        agreed.append(int((signature(a, keys) == signature(b, keys)).sum()))
    assert abs(np.mean(agreed) - 102.4) < 1 and 3.5 < np.std(agreed) < 5.6 and min(agreed) > 80


def test_known_rows_are_not_told_again():
    marks = np.zeros((5, 4), np.uint8)
    joined = np.array([True, True, False, False, True])
    a, b = list_links(np.zeros(5, int), np.arange(5), marks, np.ones(5, int), joined, 4, 80)
    told = {frozenset(pair) for pair in zip(a.tolist(), b.tolist())}
    assert told and not told & {frozenset(p) for p in ((0, 1), (0, 4), (1, 4))}
    assert {2, 3} <= set().union(*told)


def test_whole_table_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert found(spark, rows) == expected(rows)
