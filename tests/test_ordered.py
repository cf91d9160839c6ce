"""Positions and neighbours: the same rows however groups are cut."""

import collections

import pytest
from pyspark.sql import functions as F

from foliant.operators import ordered
from foliant.operators.ordered import with_next, with_position

ROWS = (
    [("a", i // 2, f"a{i}") for i in range(30)]  # repeated orders
    + [("b", i, f"b{i}") for i in range(3)]
    + [(None, i, f"n{i}") for i in range(9)]
    + [("a", None, "x"), ("a", None, "y"), (None, None, "z"), ("c", None, "c")]
    + [("d", 1, "same")] * 5
)


def counted(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, o int, v string")


@pytest.mark.parametrize("rows_per_range", [1, 2, 7])
def test_position(rows, rows_per_range):
    whole = counted(with_position(rows, "g", "o", rows_per_range=10**6))
    assert counted(with_position(rows, "g", "o", rows_per_range=rows_per_range)) == whole
    assert sum(whole.values()) == len(ROWS)
    by_group = collections.defaultdict(list)
    for g, _, _, position in whole.elements():
        by_group[g].append(position)
    assert all(sorted(p) == list(range(len(p))) for p in by_group.values())


@pytest.mark.parametrize("rows_per_range", [1, 2, 7])
def test_next(rows, rows_per_range):
    values = {"next_v": F.col("v"), "next_o": F.col("o")}
    whole = counted(with_next(rows, "g", "o", values, rows_per_range=10**6))
    assert counted(with_next(rows, "g", "o", values, rows_per_range=rows_per_range)) == whole
    assert sum(whole.values()) == len(ROWS)


def test_one_exchange_where_no_group_is_large(rows):
    plan = with_position(rows, "g", "o")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_many_ranges_in_few_partitions(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "MOST_PARTITIONS", 4)
    _, ranged = ordered._split(rows, "g", "o", 2)
    assert len(ranged.inputFiles()) <= 8  # of the shuffle that cuts groups, not one per range
    sizes = ranged.groupBy("g", "_range").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("orders")).collect()
    assert len(sizes) > 8 and all(s.n <= 2 or s.orders <= 1 for s in sizes)
    values = {"next_v": F.col("v"), "next_o": F.col("o")}
    whole = counted(with_next(rows, "g", "o", values, rows_per_range=10**6))
    assert counted(with_next(rows, "g", "o", values, rows_per_range=1)) == whole
    whole = counted(with_position(rows, "g", "o", rows_per_range=10**6))
    assert counted(with_position(rows, "g", "o", rows_per_range=1)) == whole
