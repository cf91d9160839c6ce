"""Type detection, cleaning, ids and prompts on literal rows."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r.out for r in df.select("i", fn(F.col("c")).alias("out")).orderBy("i").collect()]


def test_t1_detect_file_type(spark):
    cases = {
        "./dir/file": "unknown", "X.HTM": "html", "a.tar.PDF": "pdf", "a.text": "txt",
        "a.markdown": "md", "noext": "unknown", "a.": "unknown", "a.csv": "csv",
        "b.json": "json", "c.xml": "xml", "d.docx": "unknown", "": "unknown",
    }
    assert values(spark, cases, tx.detect_file_type) == list(cases.values())


def test_t2_clean_text(spark):
    cases = {
        "a\n\r\n\r\nb": "a\n\n\nb",      # line feeds kept apart by carriage returns survive
        "a  b   c": "a b c", "a\n\n\n\nb": "a\n\nb", " \t\n": "", "": "", "\ta\t\tb\n": "a\t\tb",
        "x\r\ny": "x\ny",
    }
    assert values(spark, cases, tx.clean_text) == list(cases.values())


def test_t2_without_whitespace_rules(spark):
    out = values(spark, ["  a  b\r\n "], lambda c: tx.clean_text(c, remove_extra_whitespace=False))
    assert out == ["a  b\r"]


def test_t3_clean_pdf_text(spark):
    cases = {
        "exam-\n  ple": "example", "end\n  12 \nnext": "end\n\nnext",
        "stop.\n go on": "stop. go on", "stop.\nGo on": "stop.\nGo on",
        "bell\x07 and\x7f": "bell and", "\x0b a \x0c": "a", "a    b": "a b", "well - known": "well - known",
    }
    assert values(spark, cases, tx.clean_pdf_text) == list(cases.values())


def test_t4_clean_chunk(spark):
    cases = {
        "  . hello (": "hello", ") [": "", "the quick": "quick", "... x": ".. x",
        "ary tools here": "tools here", "a bcd": "bcd", "A b": "A b", " \n ": "", "an": "an",
        "Été au": "Été au", "of ,x": ",x", " to be [{": "be [", "": "", "! x": "! x",
        ".\nx": "\nx", "é b c": "é b c", "aéé word": "aéé word",
    }
    assert values(spark, cases, tx.clean_chunk) == list(cases.values())


def test_t5_tokens_count_bytes(spark):
    assert values(spark, ["", "abc", "abcd", "éééé"], tx.estimate_tokens) == [0, 0, 1, 2]


def test_t6_chunk_id(spark):
    (one,) = values(spark, ["docs/a.txt"], lambda c: tx.chunk_id(c, F.lit(3)))
    assert one.startswith("chunk_") and one.endswith("_3") and len(one) == 6 + 32 + 2


def test_t7_metadata_without_status(spark):
    none = F.lit(None).cast("bigint")
    assert values(spark, ["txt"], lambda c: tx.file_metadata(none, none, c)) == [",type:txt"]
    known = values(spark, ["md"], lambda c: tx.file_metadata(F.lit(5), F.lit(9), c))
    assert known == ["size:5,modified:9,type:md"]


def test_t8_prompt_mode_is_checked():
    with pytest.raises(ValueError):
        tx.with_prompt("c", "other")


def test_s11_session_name(spark):
    cases = {"a_b_2024-01-01-000000": "a_b", "plain": "plain", "x_": "x", "_y": ""}
    assert values(spark, cases, tx.session_name) == list(cases.values())


def test_t16_message_id(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00.123456' AS ts, 7 AS turn")
    row = df.select(
        tx.message_id(F.col("ts")).alias("a"), tx.message_id(F.col("ts"), F.col("turn")).alias("b"),
        tx.format_timestamp("ts").alias("c"),
        tx.new_session_id(F.lit("s"), F.col("ts")).alias("d"),
    ).first()
    assert tuple(row) == (
        "id_1704067200123", "id_1704067200123_7", "2024-01-01 00:00:00", "s_2024-01-01-000000",
    )
