"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import stored


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b), b being the smallest vertex that a is connected with, for each a that is not it.

    ``edges`` has two integer columns, a and b.  Large and small stars in turn
    hang every vertex under its smallest neighbour until only stars are left, in
    a number of rounds that grows with the logarithm of the size.  Minima are
    taken before the shuffle, and joins read written tables, so that a star with
    very many leaves is split by adaptive execution.
    """
    edges = stored(
        edges.filter("a != b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(),
        "edges",
    )
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least")
        large = stored(
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), "least")
            .withColumnRenamed("least", "b").distinct(), "edges",
        )
        least = stored(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        edges = stored(
            large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .filter("a != b").unionByName(least.withColumnRenamed("least", "b")).distinct(),
            "edges",
        )
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges
