"""Byte-level BPE, token files, toxicity and decontamination against the libraries and brute force."""

import os
import random
import struct
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import byte_bpe, token_files, toxicity
from foliant.llm import decontamination as leaks
from foliant.llm.byte_bpe import WORD_WISE, Coder, coding, parse_ranks
from foliant.llm.shared import words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "don't  it's\n\n\tx", "é́ ñ ß 漢字 🙂\x1c\x85 y", "<|endoftext|> a", "3.14,15;x!?",
    "KELVIN K İ Σ ΣΑΣ.", "word " * 3000, "a" * 5000, "-" * 700 + "ab" * 900,
]


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(i, t, f"n{i}", i) for i, t in enumerate(ODD)] + [(None, "null key", "x", 0), (1, "", "x", 1)],
        "doc_id long, text string, tokens string, part int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe_is_the_librarys(spark):
    with open(RANKS, "rb") as file:
        ranks = parse_ranks(file.read())
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coders = [Coder(ranks, public_tokenizers.PATTERN, s) for s in (None, WORD_WISE)]
    draw = random.Random(5)
    texts = [t or "" for t in ODD] + [
        "".join(draw.choice("ab \n\t-—éßñ漢🙂'sst12\x1c\x85  ") for _ in range(draw.randrange(50)))
        for _ in range(1500)
    ]
    for text in texts:
        for coder in coders:
            packed = coder.encode(text)
            assert ids_of(packed) == library.encode_ordinary(text)
            assert coder.decode(packed) == text.encode()


def test_bpe_with_another_vocabulary():
    ranks = {bytes([i]): i for i in range(256)}
    for token in (b"ab", b"bc", b"abc", b"cd", b"abcd", b"aa", b"aaa", b"bcd"):
        ranks[token] = len(ranks)
    library = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    coder, draw = Coder(ranks, r".+"), random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choice("abcd") for _ in range(draw.randrange(1, 14)))
        assert ids_of(coder.encode(text)) == library.encode_ordinary(text)


def test_new_short_pieces_are_walked_together(monkeypatch):
    """Of many texts at a time, stepping back included; only long pieces are walked alone."""
    ranks = {bytes([i]): i for i in range(256)}
    for token in (b"ab", b"bc", b"abc", b"cd", b"abcd", b"aa", b"aaa", b"bcd", "é".encode()):
        ranks[token] = len(ranks)
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    coder, draw, alone = Coder(ranks, r"\S+|\s+"), random.Random(2), []
    monkeypatch.setattr(
        Coder, "piece", lambda self, data, f=Coder.piece: alone.append(data) or f(self, data))
    texts = [None, "", *(
        " ".join("".join(draw.choice("abcdé") for _ in range(draw.randrange(14))) for _ in range(9))
        for _ in range(900)), "abcd" * 200]
    for _ in range(2):
        for text, packed in zip(texts, coder.encode_all(texts), strict=True):
            assert ids_of(packed) == library.encode_ordinary(text or "")
    assert alone == [b"abcd" * 200] * 2
    with pytest.raises(ValueError, match="lacks a byte"):
        list(Coder({b"a": 0, b"b": 1}, r".+").encode_all(["abc"]))


def test_pieces_are_split_and_looked_up_in_arrays(monkeypatch):
    """The pattern is matched against no short text, and a piece that is kept not walked again."""
    with open(RANKS, "rb") as file:
        ranks = parse_ranks(file.read())
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, draw, walked = Coder(ranks, public_tokenizers.PATTERN, WORD_WISE), random.Random(3), []
    monkeypatch.setattr(coder, "pattern", None)
    monkeypatch.setattr(
        coder.walk, "pieces",
        lambda *own, f=coder.walk.pieces: walked.append(len(own[1])) or f(*own))
    signs = [*"abst  \n\t'--éß漢٣²\x00\x1c\x85\u2028\u3000\u0301ſ🙂", "'re", "'ll", "'s't", "!!", "\r\n"]
    texts = [None, "", " ", *(
        "".join(draw.choice(signs) for _ in range(draw.randrange(80))) for _ in range(800))]
    for _ in range(2):
        for text, packed in zip(texts, coder.encode_all(texts), strict=True):
            assert ids_of(packed) == library.encode_ordinary(text or "")
    assert walked[1] < walked[0] / 5


def test_long_texts_and_crowded_places(monkeypatch):
    """Parts of a long text, a word longer than a part, and pieces of one place or one hash."""
    for name, value in (
        ("CHARACTERS_AT_ONCE", 40), ("AT_ONCE", 7), ("KEPT_IDS", 2), ("KEPT_PLACES", {1: 2, 2: 1, 4: 1})
    ):
        monkeypatch.setattr(byte_bpe, name, value)
    monkeypatch.setattr(
        byte_bpe.Kept, "mixed", staticmethod(lambda keys: keys[:, 0] << np.uint64(61)))
    with open(RANKS, "rb") as file:
        ranks = parse_ranks(file.read())
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdeé  \r\n'1-") for _ in range(n)) for n in range(0, 400, 7)]
    texts += ["verylongword" * 30, " \n" * 90 + "x", "漢字" * 60 + " ab " * 40]
    for stretches in (None, WORD_WISE):
        coder = Coder(ranks, public_tokenizers.PATTERN, stretches)
        for text, packed in zip(texts, coder.encode_all(texts), strict=True):
            assert ids_of(packed) == library.encode_ordinary(text)


def test_bpe_columns(spark, odd, empty):
    to_ids, to_bytes = coding(spark, RANKS, public_tokenizers.PATTERN, WORD_WISE)
    rows = odd.select("text", to_bytes(to_ids(F.col("text"))).alias("back")).collect()
    assert all(bytes(r.back) == (r.text or "").encode() for r in rows)
    assert empty.select(to_ids(F.col("text"))).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, tmp_path, encoding):
    path = str(tmp_path / "tokens")
    layout = token_files.FileLayout(encoding=encoding, row_group_bytes=1 << 16, page_rows=5)
    token_files.write_tokens(odd, path, WORDS, end_id=2, layout=layout)
    rows = token_files.with_start(spark, path).withColumn(
        "crc", token_files.ids_crc32()("tokens")).orderBy("start").collect()
    keys = [r.doc_id for r in rows]
    assert keys == [None, 0, 1, 1, *range(2, len(ODD))]
    library, start = Tokenizer.from_file(WORDS), 0
    for row in rows:
        text = "null key" if row.doc_id is None else ODD[row.doc_id] or ""
        if row.doc_id == 1:
            text = ""
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (row.tokens, row.n_tokens, row.start) == (ids, len(ids), start)
        assert row.crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = token_files.read_tokens(spark, path).filter("doc_id = 3").select("n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,3)" in plan and "tokens:array" not in plan


def test_token_files_of_an_empty_table(spark, empty, tmp_path):
    token_files.write_tokens(empty, str(tmp_path / "t"), WORDS, end_id=2)
    assert token_files.with_start(spark, str(tmp_path / "t")).count() == 0


def labelled(spark, n=240):
    draw, rows = random.Random(3), []
    for i in range(n):
        parts = [" ".join(f"w{draw.randrange(60)}" for _ in range(6)) for _ in range(5)]
        if i % 4 == 0:
            parts[draw.randrange(5)] += " " + draw.choice(["nastiness", "nasty", "vile"])
        rows.append((i, ". ".join(parts) + ".", int(i % 4 == 0)))
    return rows


def test_toxicity_finds_held_out_documents_and_their_sentences(spark):
    rows = labelled(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), training=F.col("doc_id") % 3 != 1)
    found = toxicity.toxicity(docs, model).filter("doc_id % 3 = 1").collect()
    right = [r for r in found if (r.toxicity.score >= 0.7) == bool(r.toxic)]
    assert len(right) >= 0.95 * len(found)
    for row in found:
        for sentence in row.toxicity.sentences:
            assert any(w in row.text[sentence.start : sentence.end] for w in ("nast", "vile"))


def test_toxicity_of_odd_input(spark, odd, empty):
    none = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"), training=F.lit(True))
    clash = odd.withColumn("toxicity", F.lit("old"))
    rows = toxicity.toxicity(clash, none).collect()
    assert len(rows) == len(ODD) + 2 and all(r.toxicity.score < 1e-6 for r in rows)
    one = spark.createDataFrame([(2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.train(odd, one, training=F.lit(True)).bias == -30.0
    assert toxicity.toxicity(empty, none).count() == 0


def brute_leaks(text, items, rule):
    tokens, found = words(text), {}
    for item, own in items:
        own = words(own)
        target = Counter(leaks.shingle_list(own, rule.shingle))
        if not own or not tokens:
            continue
        best = max(
            (leaks.weighted_jaccard(
                Counter(leaks.shingle_list(tokens[s : s + len(own)], rule.shingle)), target), -s)
            for s in range(max(1, len(tokens) - len(own) + 1)))
        if best[0] >= rule.similarity:
            found[item] = (-best[1], best[0])
    return found


def test_leaks_are_those_of_all_windows(spark):
    draw = random.Random(8)
    word = lambda: f"v{draw.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 15, 30, 55])))) for i in range(30)]
    items += [(90, ""), (91, None), (92, items[3][1])]
    texts = [None, "", "one", items[0][1]]
    for _ in range(120):
        own = draw.choice(items[:30])[1].split()
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = word()
        if draw.random() < 0.3 and len(own) > 20:
            own.insert(10, word())
        texts.append(" ".join([word() for _ in range(draw.randrange(40))] + own
                              + [word() for _ in range(draw.randrange(40))]).title())
    texts.append("filler " * 4000 + items[1][1])
    docs = spark.createDataFrame(
        [(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, contaminations string")
    rule = leaks.WindowRule(items_per_slice=7)
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = leaks.contaminations(docs, table, rule).collect()
    for row in rows:
        got = {m.item: (m.start, m.similarity) for m in row.contaminations}
        assert got == brute_leaks(row.text, [(i, t or "") for i, t in items], rule)
    assert sum(bool(r.contaminations) for r in rows) > 20
    assert leaks.contaminations(docs, table.limit(0), rule).filter("size(contaminations) > 0").count() == 0
    assert leaks.contaminations(docs.limit(0), table, rule).count() == 0


def test_multi_index_gives_all_within_the_radius():
    draw = random.Random(4)
    items = [(i, " ".join(f"x{draw.randrange(9)}" for _ in range(20))) for i in range(200)]
    index = leaks.ItemIndex(items, leaks.WindowRule(radius=15))
    for _ in range(200):
        number = index.prints[draw.randrange(200)]
        for bit in draw.sample(range(64), draw.randrange(25)):
            number ^= 1 << bit
        assert index.within_radius(number, 20) == [
            i for i, own in enumerate(index.prints) if (own ^ number).bit_count() <= 15]


def test_long_labelled_texts_take_part_in_the_fit(spark):
    clean = " ".join(f"Sentence {i} of a long report." for i in range(3000))
    rows = [(i, clean + " Quite nasty words." * 300 * (i % 2)) for i in range(12)]
    docs = spark.createDataFrame(rows + [rows[1]] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, training=F.lit(True))
    scorer = toxicity.Scorer(model)
    assert scorer.score(rows[1][1], 0.5)[0] > 0.7 > scorer.score(rows[0][1], 0.5)[0]


def test_texts_fill_the_sample_and_an_empty_label_is_warned_of(spark):
    docs = spark.createDataFrame([(5, "nasty words."), (6, "kind words.")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "doc_id long, toxic int")
    rule = toxicity.FitRule(rows_per_label=1)
    assert toxicity.train(docs, labels, training=F.lit(True), rule=rule).bias > -30
    with pytest.warns(UserWarning, match="toxic = 0"):
        toxicity.train(docs, labels.filter("toxic = 1"), training=F.lit(True))


def test_the_sample_is_bounded_by_whole_texts(spark):
    rows = [(i, ("nasty " if i % 2 else "fine ") * 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for characters, texts in ((1, 1), (250, 3), (10**6, 20)):
        seen, fit = [], toxicity.fit

        def watched(sample, rule, totals):
            seen.extend(sample)
            return fit(sample, rule, totals)

        toxicity.fit = watched
        try:
            toxicity.train(docs, labels, training=F.lit(True),
                           rule=toxicity.FitRule(characters_per_label=characters, epochs=1))
        finally:
            toxicity.fit = fit
        counts = Counter(row[1] for row in seen)
        assert all(row[0] == rows[row[1]][1] for row in seen)
        assert counts[1] == texts and texts <= counts[0] <= texts + 1


def test_ids_before_signs_are_the_tokenizers():
    """Characters whose lower case has more than one code point, before every sign."""
    with open(WORDS) as file:
        coder = token_files.WordIds(file.read())
    several = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) > 1]
    marked = ["e\u0301", "ÉCOLE", "ΣΑΣ", "ǰ", "İSTANBUL", "DİYARBAKIR"]
    texts = [f"{a}{c}{b}{sign}" for c in [*several, *marked] for sign in ".,;:!?"
             for a, b in (("", ""), ("ab", ""), ("", "cd"), ("É", "é"))]
    assert several
    library = Tokenizer.from_file(WORDS)
    for text in texts + [" ".join(texts)]:
        assert ids_of(coder.encode([text.encode()])[0]) == library.encode(text, add_special_tokens=False).ids


def test_new_words_go_to_the_tokenizer_many_in_a_call():
    """Digits, signs and marks as well as letters; blanks of all kinds, and words that come again."""
    with open(WORDS) as file:
        coder = token_files.WordIds(file.read())
    library, calls = coder.tokenizer, []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(library, name)

    coder.tokenizer = Counted()
    draw = random.Random(6)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["".join(
        draw.choice(["don't", "ÉTÉ", "İ", "x", "3.14", "--", f"w{draw.randrange(999)}", "漢字", "z" * 60])
        + draw.choice(["", ".", "?!", "'s", "\u0301", "\u0338"]) + draw.choice(blanks)
        for _ in range(draw.randrange(60))) for _ in range(400)]
    for some in (texts, texts[::-1], ["", " ", *texts[:9]]):
        for text, packed in zip(some, coder.encode(some), strict=True):
            assert ids_of(packed) == library.encode(text, add_special_tokens=False).ids
    assert len(calls) < 60


def test_executors_need_no_package(tmp_path):
    """Operators that send a model run from another folder, without the package on the workers' path."""
    root = str(Path(toxicity.__file__).resolve().parent.parent.parent)
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
from foliant.llm import brown_classes, toxicity
docs = spark.createDataFrame([(i, "some nasty words." if i % 2 else "fine words.") for i in range(12)],
                             "doc_id long, text string")
labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
model = toxicity.train(docs, labels, training=F.lit(True))
assert toxicity.toxicity(docs, model).filter("toxicity.score > 0.5").count() == 6
texts = docs.withColumns({{"training": F.lit(True), "numbers": F.lit(1), "row": F.lit("r"), "others": F.lit(2)}})
scored = brown_classes.scores(brown_classes.train(texts, "training"), "doc_id", "row", "numbers")
assert {{(r.row, r.numbers, r.n_tokens) for r in scored.collect()}} == {{("r", 1, 3), ("r", 1, 4)}}
print("all well")
"""
    (tmp_path / "run.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300)
    assert "all well" in done.stdout, done.stderr[-3000:]
