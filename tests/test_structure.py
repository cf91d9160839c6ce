"""Offsets of sentences, paragraphs, pages, sections against Python regexes."""

import bisect
import random
import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import structure


def run(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r.out for r in df.select("i", fn(F.col("c")).alias("out")).orderBy("i").collect()]


def boundaries(text):
    """T9 as it is defined, one character at a time."""
    out = []
    for i in range(len(text) - 1):
        if text[i] in ".!?" and text[i + 1] in " \n\t":
            listed = text[i] == "." and i >= 2 and text[i - 2:i + 1] in ("Dr.", "Mr.", "Ms.", "vs.")
            upper = text[i] == "." and i >= 2 and "A" <= text[i - 1] <= "Z"
            if not (listed or upper):
                out.append(i + 1)
    return out


def test_t9_sentence_boundaries(spark):
    texts = ["", "No end", "One. Two! Three? ", "Dr. No met Mr. X. Then", "USA. Next etc. And e.g. so",
             ". start", "A. b", "xA. b", "Tab.\tNew.\nLine"]
    assert run(spark, texts, structure.sentence_boundaries) == [boundaries(t) for t in texts]


def test_t9_intended_abbreviations(spark):
    fixed = run(spark, ["etc. And Prof. X said i.e. this. Done."],
                lambda c: structure.sentence_boundaries(c, fixed_abbreviations=True))
    assert fixed == [[len("etc. And Prof. X said i.e. this.")]]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aA.!? \n\tDrMs1-", max_size=120), min_size=20, max_size=40))
def test_t9_t10_random_texts(spark, texts):
    assert run(spark, texts, structure.sentence_boundaries) == [boundaries(t) for t in texts]
    assert run(spark, texts, structure.paragraph_boundaries) == [
        [m.end() for m in re.finditer("\n\n+", t)] for t in texts
    ]


PAGE = re.compile(r"\n[ \t\n\x0b\f\r]*---[ \t\n\x0b\f\r]*Page[ \t\n\x0b\f\r]+\d+[ \t\n\x0b\f\r]*---[ \t\n\x0b\f\r]*\n")
HEAD = re.compile(
    r"(?:\A|(?<=[\n\r]))[ \t\n\x0b\f\r]*\d+\.[ \t\n\x0b\f\r]+[A-Z][^\n]{5,50}[ \t\n\x0b\f\r]*(?=[\n\r]|\Z)")
PARTS = ["\n\n--- Page 1 ---\n\n", "\n---Page 2---\n", "1. Heading here\n", "\n2. Second heading",
         "text ", "\n", " ", "\r", "3. Abcdefg", "--- Page x ---", "\t12. Zzzzzz zz\n\n"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=20, max_size=40))
def test_t11_t12_random_texts(spark, texts):
    assert run(spark, texts, structure.page_breaks) == [
        [m.start() for m in PAGE.finditer(t)] for t in texts
    ]
    found = run(spark, texts, structure.sections)
    assert [[(s.title, s.start_position, s.level) for s in row] for row in found] == [
        [(m.group(), m.start(), 1) for m in HEAD.finditer(t)] for t in texts
    ]


def test_running_total_of_long_arrays(spark):
    row = spark.range(1).select(
        structure.running_total(F.sequence(F.lit(1).cast("bigint"), F.lit(5000).cast("bigint"))).alias("t"),
        structure.running_total(F.array().cast("array<bigint>")).alias("none"),
    ).first()
    assert row.t == [n * (n + 1) // 2 for n in range(1, 5001)] and row.none == []


def test_t13_tie_goes_to_the_earliest(spark):
    def end(boundaries, length, start=0):
        df = spark.createDataFrame([(boundaries, length, start)], "b array<bigint>, n bigint, s bigint")
        return df.select(structure.optimal_chunk_end(
            F.col("n"), F.col("s"), F.col("b"), 1000).alias("e")).first().e

    assert end([400, 950, 1050], 2000) == 950
    assert end([400, 1600], 2000) == 1000       # none in range: the ideal end
    assert end([500], 2000) == 500
    assert end([950], 900) == 900               # text ends before the ideal end
    assert end([], 2000, 500) == 1500


def test_j3_j4_lookup(spark):
    df = spark.sql(
        "SELECT array(named_struct('title', 'A', 'start_position', 5L)) AS s, array(10L, 20L) AS b")
    row = df.select(
        structure.section_at(F.col("s"), F.lit(4)).alias("none"),
        structure.section_at(F.col("s"), F.lit(5)).alias("a"),
        structure.page_at(F.col("b"), F.lit(9)).alias("p1"),
        structure.page_at(F.col("b"), F.lit(20)).alias("p3"),
        structure.locator(F.lit("A"), F.lit(3)).alias("l"),
    ).first()
    assert tuple(row) == ("Unknown", "A", 1, 3, "section:A;page:3")


def test_t13_j3_j4_for_arrays_equal_the_single_ones(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        marks = sorted(rng.sample(range(6000), rng.choice([0, 1, 5, 60])))
        starts = sorted(rng.sample(range(6000), rng.choice([0, 1, 7])))
        rows.append((i, 6000 + rng.randrange(900), starts, marks, [(f"h{m}", m) for m in marks]))
    df = spark.createDataFrame(
        rows, "i int, n bigint, starts array<bigint>, marks array<bigint>, "
        "heads array<struct<title: string, start_position: bigint>>")
    both = df.select("i", F.explode(F.arrays_zip(
        "starts", structure.optimal_chunk_ends(F.col("n"), F.col("starts"), F.col("marks"), 1000).alias("e"),
        structure.sections_at(F.col("heads"), F.col("starts")).alias("s"),
        structure.pages_at(F.col("marks"), F.col("starts")).alias("p"))).alias("x"), "n", "marks", "heads")
    start = F.col("x.starts")
    wrong = both.filter(
        (F.col("x.e") != structure.optimal_chunk_end(F.col("n"), start, F.col("marks"), 1000))
        | (F.col("x.s") != structure.section_at(F.col("heads"), start))
        | (F.col("x.p") != structure.page_at(F.col("marks"), start)))
    assert both.count() > 100 and wrong.count() == 0


def test_t17_time_is_linear_in_a_document(spark):
    """Eight times the marks and chunks; a filter over all marks for each would take 64 times as long."""
    def seconds(n):
        row = spark.range(1).select(
            F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint")).alias("marks"),
            F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint")).alias("starts"))
        begin = time.perf_counter()
        row.select(F.size(structure.pages_at(F.col("marks"), F.col("starts")))).collect()
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(800_000) < 16 * max(seconds(100_000), 0.25)


def test_t17_a_long_document(spark):
    from foliant.operators import chunking

    page = "1. Heading\n" + "word " * 190 + ".\n\n--- Page 1 ---\n\n"
    text = page * 4000  # four million characters, thousands of marks and chunks
    df = spark.createDataFrame([("a.txt", text)], "source_file string, content string")
    rows = chunking.located_chunks(df).select("start_position", "page", "section").collect()
    breaks = [m.start() for m in PAGE.finditer(text)]
    assert len(rows) > 4000
    assert all(r.page == 1 + bisect.bisect_right(breaks, r.start_position) for r in rows)
