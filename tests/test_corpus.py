"""Joins, ordered positions and session operators on literal rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.config import SavePolicy, SessionConfig
from foliant.operators import corpus, ordered


def hot_rows(spark):
    """One group holds most of the rows, with gaps in its order column."""
    rng = random.Random(5)
    rows = [("hot", n, f"h{n}") for n in rng.sample(range(100_000), 600)]
    rows += [(f"g{n % 9}", n, f"v{n}") for n in range(300)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, o bigint, v string").repartition(7)


def test_with_position_equals_the_plain_window(spark):
    df = hot_rows(spark)
    plain = df.withColumn(
        "position", (F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1).cast("bigint"))
    expected = sorted(map(tuple, plain.select("g", "o", "v", "position").collect()))
    for size in (10**6, 50, 7):
        found = ordered.with_position(df, "g", "o", rows_per_range=size)
        assert sorted(map(tuple, found.select("g", "o", "v", "position").collect())) == expected


def test_with_next_equals_the_plain_window(spark):
    df = hot_rows(spark)
    window = Window.partitionBy("g").orderBy("o")
    plain = df.withColumns({"n": F.lead("v").over(window), "m": F.lead("o").over(window)})
    expected = sorted(map(str, plain.select("g", "o", "v", "n", "m").collect()))
    for size in (10**6, 50, 7):
        found = ordered.with_next(
            df, "g", "o", {"n": F.col("v"), "m": F.col("o")}, rows_per_range=size)
        assert sorted(map(str, found.select("g", "o", "v", "n", "m").collect())) == expected


def test_with_next_keeps_null_values(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, None), ("g", 3, "c")], "g string, o int, v string")
    for size in (10, 1):
        rows = ordered.with_next(df, "g", "o", {"n": F.col("v")}, rows_per_range=size)
        assert [r.n for r in rows.orderBy("o").collect()] == [None, "c", None]


def test_j1_last_duplicate_wins_and_unmatched_stay(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "id string")
    vectors = spark.createDataFrame(
        [("a", 1, [1.0]), ("a", 2, [2.0]), ("x", 1, [9.0])], "id string, n int, embedding array<float>")
    rows = {r.id: r.embedding for r in corpus.attach_embeddings(chunks, vectors, "n").collect()}
    assert rows == {"a": [2.0], "b": None}


def test_j2_and_a6(spark):
    incoming = spark.createDataFrame(
        [("s", "a", 2, "x"), ("s", "a", 1, "y"), ("s", "b", 3, "z"), ("t", "b", 3, "w"),
         ("t", "b", 3, "w"), (None, "b", 1, "v")],
        "session string, source_file string, n int, content string")
    stored = spark.createDataFrame(
        [("s", "b"), ("s", "b"), ("s", "q")], "session string, source_file string")
    fresh = corpus.first_by_path(corpus.new_documents(incoming, stored), "n")
    found = [tuple(r) for r in fresh.select("session", "source_file", "content").collect()]
    assert sorted(found, key=str) == sorted(
        [("s", "a", "y"), ("t", "b", "w"), (None, "b", "v")], key=str)


def test_a6_equal_orders_leave_one_row(spark):
    rows = spark.createDataFrame(
        [("s", "a", 1, "x"), ("s", "a", 1, "y")], "session string, source_file string, n int, c string")
    assert corpus.first_by_path(rows, "n").count() == 1
    assert corpus.first_by_path(rows).count() == 1


def test_v9_documents_of_two_sessions(spark):
    rows = spark.createDataFrame(
        [("s", "a", "1", None), ("s", "a", "2", [1.0]), ("t", "a", "3", [1.0])],
        "session string, source_file string, id string, embedding array<float>")
    assert [r.id for r in corpus.fully_embedded(rows).collect()] == ["3"]


def test_u3_modified_documents_come_again(spark):
    kind = "session string, source_file string, modified int"
    incoming = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "a", 1)], kind)
    stored = spark.createDataFrame([("s", "a", 1), ("s", "b", 1)], kind)
    changed = corpus.changed_documents(incoming, stored).collect()
    assert sorted((r.session, r.source_file) for r in changed) == [("s", "b"), ("t", "a")]


def test_a1_sessions_of_either_table(spark):
    chunks = spark.createDataFrame([("s", "f"), ("s", "f"), ("s", "g")], "session string, source_file string")
    chat = spark.sql("SELECT 't' AS session, timestamp'2024-01-01 00:00:00' AS timestamp")
    rows = {r.session: r for r in corpus.session_totals(chunks, chat).collect()}
    assert (rows["s"].n_documents, rows["s"].total_chunks, rows["s"].total_messages) == (2, 3, 0)
    assert (rows["t"].n_documents, rows["t"].total_chunks, rows["t"].total_messages) == (0, 0, 1)


def test_a3_coverage(spark):
    chunks = spark.createDataFrame(
        [("s", [1.0]), ("s", []), ("t", [1.0]), ("u", None)], "session string, embedding array<float>")
    rows = {r.session: (r.n_embedded, r.complete) for r in corpus.embedding_coverage(chunks).collect()}
    assert rows == {"s": (1, False), "t": (1, True), "u": (0, False)}


def test_w2_last_message(spark):
    chat = spark.createDataFrame(
        [("s", "1", "q1", "a1", 10), ("s", "2", "q2", "a2", 20), ("t", "3", "q3", "a3", 5)],
        "session string, id string, question string, answer string, timestamp int")
    rows = {r.session: r.id for r in corpus.last_message(chat, ["timestamp", "id"]).collect()}
    assert rows == {"s": "2", "t": "3"}


def test_w3_listing_without_an_active_session(spark):
    names = spark.createDataFrame([("b",), ("a",)], "name string")
    assert [r.label for r in corpus.session_listing(names).collect()] == ["a", "b"]
    assert [r.label for r in corpus.session_listing(names, "b").collect()] == ["a", "b (active)"]


def test_w6_retention(spark):
    rows = [(f"s{n}", f"2024-01-{n:02d} 00:00:00") for n in range(1, 21)]
    sessions = spark.createDataFrame(rows, "name string, t string").withColumn(
        "last_modified", F.col("t").cast("timestamp"))
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    kept = corpus.retained_sessions(sessions, as_of, SessionConfig(max_sessions=5, max_session_age_days=3))
    assert [r.name for r in kept.collect()] == ["s20", "s19", "s18", "s17"]
    few = corpus.retained_sessions(sessions, as_of, SessionConfig(max_sessions=2, max_session_age_days=9))
    assert [r.name for r in few.collect()] == ["s20", "s19"]


def test_t14_reuses_the_latest_directory(spark):
    asked = spark.sql(
        "SELECT * FROM VALUES ('a', timestamp'2024-05-06 07:08:09'), "
        "('b_c', timestamp'2024-05-06 07:08:09') AS t(name, created_at)")
    listing = spark.createDataFrame(
        [("b_c_2024-01-01-000000",), ("b_c_2024-02-01-000000",), ("a",)], "directory string")
    rows = {r.name: (r.session_id, r.existed) for r in corpus.session_ids(asked, listing).collect()}
    assert rows == {"a": ("a_2024-05-06-070809", False), "b_c": ("b_c_2024-02-01-000000", True)}


def test_k7_tables_per_operation():
    policy = SavePolicy()
    assert policy.tables("document_add") == ("metadata", "chunks")
    assert policy.tables("chat_message") == ()
    assert policy.tables("close") == policy.tables("manual_save") == (
        "metadata", "chat", "chunks", "index")


def test_top_k_windows_limit_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = corpus.ranked(df, "g", [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
