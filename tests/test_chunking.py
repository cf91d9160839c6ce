"""Spans and chunks: golden cases, properties, positions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.config import DEFAULT_SEPARATORS, MARKDOWN_SEPARATORS, ChunkingConfig
from foliant.functions import text as tx
from foliant.functions.spans import iter_spans
from foliant.operators import chunking

# The 115-line sample document.
PROSE = """\
The quick brown fox jumps over the lazy dog.
A fast brown fox leaps over a sleepy dog.
Quantum mechanics is a fundamental theory in physics.
Artificial intelligence is transforming the world.
Deep learning enables powerful models for vision and language.
The mitochondria is the powerhouse of the cell.
To be or not to be, that is the question.
In the beginning, the universe was created. This has made a lot of people very angry and been widely regarded as a bad move.
The rain in Spain stays mainly in the plain.
All work and no play makes Jack a dull boy.
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
"""
SAMPLE = PROSE + "".join(
    f"This is line {i} of the large test document. The quick brown fox jumps over the lazy dog.\n"
    for i in range(1, 101)
)


def spans(text, size=1000, overlap=200, separators=DEFAULT_SEPARATORS):
    return list(iter_spans(text, size, overlap, separators))


def test_g1_sample_document():
    text = SAMPLE.rstrip("\n")
    assert len(SAMPLE) == 9897
    expected = [(0, 894), (683, 1621), (1400, 2331)]
    expected += [(2108 + 712 * i, 3043 + 712 * i) for i in range(10)] + [(9228, 9896)]
    assert spans(text) == expected


def test_g1_sample_document_markdown():
    found = spans(SAMPLE.rstrip("\n"), separators=MARKDOWN_SEPARATORS)
    assert [s for s, _ in found] == [0, 141, 894, 1621, 2331] + [2331 + 712 * i for i in range(1, 11)]
    assert [e for _, e in found][:5] == [389, 1136, 1841, 2553, 3265] and found[-1][1] == 9896


def test_g1_guard_cases():
    text = "Title\n\n" + "word " * 400
    assert spans(text) == [(0, 7), (7, 1007), (807, 1807), (1607, 2007)]
    assert spans("a" * 2500) == [(0, 1000), (1000, 2000), (2000, 2500)]


def test_g1_short_and_empty_texts():
    assert spans("") == [(0, 0)]
    assert spans("x" * 1000) == [(0, 1000)]


ALPHABET = st.text(alphabet="ab é.!?,\n\t -#*", min_size=0, max_size=400)


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.integers(1, 60), st.integers(0, 40),
       st.sampled_from([DEFAULT_SEPARATORS, MARKDOWN_SEPARATORS]))
def test_g1_properties(text, size, overlap, separators):
    found = spans(text, size, overlap, separators)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(found, found[1:]):
        assert s < s2 <= e < len(text)
        assert e2 > s2
    if len(text) > size:
        assert all(e - s <= size + max(map(len, separators)) for s, e in found)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=300), st.integers(1, 40), st.integers(0, 30))
def test_g1_bytes_equal_characters_on_ascii(text, size, overlap):
    as_bytes = list(iter_spans(
        text.encode(), size, overlap, [s.encode() for s in DEFAULT_SEPARATORS]))
    assert as_bytes == spans(text, size, overlap)


def chunk(spark, texts, config=ChunkingConfig(), **options):
    docs = spark.createDataFrame(
        [(f"d{i}", t) for i, t in enumerate(texts)], "source_file string, content string"
    )
    return chunking.chunk_documents(docs, config, **options)


def test_g2_sample_document(spark):
    rows = chunk(spark, [SAMPLE.rstrip("\n")]).orderBy("chunk_index").collect()
    assert [len(r.content) for r in rows] == [893, 937, 930] + [934] * 10 + [668]
    assert sum(r.token_count for r in rows) == 3186
    assert [r.chunk_index for r in rows] == list(range(14))
    assert rows[0].overlap_previous is None


@pytest.mark.parametrize("unit", ["chars", "bytes"])
def test_g2_positions_point_at_the_content(spark, unit):
    texts = [
        SAMPLE.rstrip("\n"),
        ("Déjà vu. (an aside) [note] été " * 120).strip(),
        (". the end, of it ( " * 150).strip(),
    ]
    config = ChunkingConfig(chunk_size=200, chunk_overlap=50, unit=unit)
    for row in chunk(spark, texts, config).collect():
        text = texts[int(row.source_file[1:])]
        if unit == "bytes":
            part = text.encode()[row.start_position:row.end_position].decode("utf-8", "replace")
        else:
            part = text[row.start_position:row.end_position]
        if "�" not in row.content:
            assert part == row.content


def test_g2_blank_document_gives_one_empty_chunk(spark):
    docs = spark.createDataFrame([("d", " \n\t ")], "source_file string, content string")
    cleaned = docs.withColumn("content", tx.clean_text("content"))
    assert [tuple(r) for r in chunking.chunk_documents(cleaned).select(
        "content", "chunk_index", "start_position", "end_position").collect()] == [("", 0, 0, 0)]
    dropped = chunking.chunk_documents(cleaned, ChunkingConfig(drop_empty=True))
    assert dropped.count() == 0


def test_g2_empty_pieces_are_dropped_and_not_counted(spark):
    text = "word " * 10 + "\n" * 60 + "tail " * 10
    config = ChunkingConfig(chunk_size=30, chunk_overlap=0)
    rows = chunk(spark, [text], config).orderBy("chunk_index").collect()
    assert all(r.content for r in rows)
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert len(rows) < len(list(iter_spans(text, 30, 0, DEFAULT_SEPARATORS)))


def test_g2_null_text_gives_no_chunks(spark):
    assert chunk(spark, [None]).count() == 0


def test_g3_positions_drift(spark):
    docs = spark.createDataFrame(
        [("d", SAMPLE.rstrip("\n"))], "source_file string, content string"
    )
    rows = chunking.with_drifting_positions(docs).orderBy("chunk_index").collect()
    assert rows[0].start_position == rows[0].true_position
    assert rows[1].start_position != rows[1].true_position


def test_g2_runs_without_a_shuffle_on_a_spread_input(spark):
    docs = spark.createDataFrame([("d", "x")], "source_file string, content string")
    plan = chunk(spark, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1
    spread = docs.repartition(4, "source_file")
    again = chunking.chunk_documents(spread)._jdf.queryExecution().executedPlan().toString()
    assert again.count("Exchange") == 1


def test_a2_summary(spark):
    rows = chunking.chunk_summary(chunk(spark, ["abcd", "éé"])).orderBy("source_file").collect()
    assert [(r.n_chunks, r.n_chars, r.n_tokens) for r in rows] == [(1, 4, 1), (1, 2, 1)]


def test_j3_asof_table_equals_list_lookup(spark):
    text = "".join(f"\n{i}. Heading number {i}\n" + "some words here. " * 40 for i in range(1, 8))
    docs = spark.createDataFrame([("d", "intro " * 30 + text)], "source_file string, content string")
    located = chunking.located_chunks(docs).select("id", "section")
    from foliant.functions import structure
    heads = docs.select("source_file", F.inline(structure.sections(F.col("content"))))
    joined = chunking.asof_sections(chunking.chunk_documents(docs), heads).select("id", "section")
    assert sorted(map(tuple, located.collect())) == sorted(map(tuple, joined.collect()))
    assert located.filter("section = 'Unknown'").count() >= 1
