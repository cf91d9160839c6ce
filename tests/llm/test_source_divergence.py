"""The divergence of sources against its definition in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from foliant.llm import source_divergence as module
from foliant.llm.source_divergence import AuditRule, source_divergence, terms

PATTERN = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def expected(rows, least, ranks=10, scale=10**9):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = PATTERN.findall(lowered(text or ""))
        counts[lang or "", source or ""].update(found)
        langs[lang or ""].update(found)
        docs[lang or ""].update(set(found))
    result = []
    for (lang, source), own in counts.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def share(count, of):
            return 1 + scale * (count + 2) // (sum(of[t] for t in kept) + 2 * len(kept))

        def value(p, q):
            return (p - q) ** 2 // (p + q)

        pairs = [
            (-sum(value(share(own[t], own), share(other[t], other)) for t in kept), name.encode())
            for (its, name), other in counts.items() if its == lang and name != source
        ]
        listed = []
        for t in kept:
            p, q = share(own[t], own), share(langs[lang][t], langs[lang])
            if own[t] and p > q:
                listed.append((-value(p, q), t.encode()))
        for part, found, most in (("pair", pairs, None), ("term", listed, ranks)):
            result += [(lang, source, part, item.decode(), -v, i + 1)
                       for i, (v, item) in enumerate(sorted(found)[:most])]
    return sorted(result)


def found(spark, rows, schema=SCHEMA, **rule):
    docs = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, source_divergence(docs, AuditRule(**rule)).collect()))


def random_rows(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{a}{b}" for a in "abcdeé" for b in "fghijkü日"] + ["Zed", "zed", "ÄÖ", "a_b", "x1y"]
    rows = []
    for i in range(n):
        source = rng.choice(["s1", "s2", "s3", "S3", "é", None, "s1", "s1"])
        words = rng.choices(vocabulary[: rng.choice([5, 20, 60])], k=rng.randint(0, 40))
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words),
                     rng.choice(["en", "fr", None]), source))
    return rows


@pytest.mark.parametrize("least,ranks", [(1, 3), (4, 10), (10, 1), (1000, 10)])
def test_against_the_definition(spark, least, ranks):
    rows = random_rows(150)
    assert found(spark, rows, least_documents=least, ranks=ranks) == expected(rows, least, ranks)


def test_many_sources_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "SOURCES_PER_BLOCK", 3)
    monkeypatch.setattr(module, "COUNTS_PER_GROUP", 40)
    monkeypatch.setattr(module, "SHARES_AT_ONCE", 50)
    rng = random.Random(5)
    rows = [(i, t, lang, f"s{rng.randint(0, 10)}") for i, t, lang, _ in random_rows(200, 6)]
    assert found(spark, rows, least_documents=2) == expected(rows, 2)


def test_terms_held_are_given_out_in_between(spark, monkeypatch):
    monkeypatch.setattr(module, "TERMS_HELD", 7)
    monkeypatch.setattr(module, "TEXT_AT_ONCE", 5)
    monkeypatch.setattr(module, "ROWS_AT_ONCE", 3)
    rows = random_rows(60, 9)
    assert found(spark, rows, least_documents=3) == expected(rows, 3)


def test_odd_input(spark):
    schema = SCHEMA + ", n long, docs string, term string, slot long, v long, c string, value long, rank int"
    more = (1, "x", "y", 2, 3, "z", 4, 5)
    plain = [
        (1, None, None, None), (2, "", "", ""), (3, "a b", "en", "s"), (3, "a b", "en", "s"),
        (None, "b " * 300_000 + "é", "en", "t"), (5, "12 _ \x00\x7f", "en", "only signs"),
        (6, "tie tied", "en", "u"), (7, "tied tie", "en", "u"), (8, "A", "fr", "alone"),
    ]
    assert found(spark, [r + more for r in plain], schema, least_documents=1) == expected(plain, 1)
    assert found(spark, [], SCHEMA) == []
    # Groups whose language keeps no term have pairs of value zero, in the order of their names.
    assert found(spark, [(1, "a", "en", "y"), (2, "b", "en", "x"), (3, None, "en", "Z")]) == [
        ("en", "Z", "pair", "x", 0, 1), ("en", "Z", "pair", "y", 0, 2),
        ("en", "x", "pair", "Z", 0, 1), ("en", "x", "pair", "y", 0, 2),
        ("en", "y", "pair", "Z", 0, 1), ("en", "y", "pair", "x", 0, 2),
    ]


def test_terms_are_the_pattern_s():
    rng = random.Random(1)
    signs = [chr(c) for c in range(0x82)] + ["é", "İ", "日", " ", "😀", " "]
    for _ in range(300):
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        own = [t.decode() for part in terms(text.encode()) for t in part]
        assert own == PATTERN.findall(lowered(text))


def test_scale_is_bounded():
    with pytest.raises(ValueError):
        AuditRule(scale=10**10)
