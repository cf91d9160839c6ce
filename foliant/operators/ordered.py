"""Positions and neighbours inside groups that may be very large.

A window over ``partitionBy(group)`` puts a whole group into one task.  That is
what happens here to groups of up to ``rows_per_range`` rows.  Larger groups are
dealt into ranges of their order column: windows then run per (group, range),
and a second, small window over one row per (group, range) carries counts or
boundary rows across.  Both ways give the same rows: NULL is a group and an
order like any other, and rows with equal orders follow each other by a hash of
their columns.

Finding the large groups takes one count over the group column alone; where
there is none, nothing else is run or added to the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.runtime import fresh_path

ROWS_PER_RANGE = 2_000_000
#: Most partitions of the range exchange: the driver samples their bounds and hears of each task.
MOST_PARTITIONS = 512


def _order(df: DataFrame, order: str) -> list[Column]:
    """The order column, then a tie-breaker; rows equal in both are alike."""
    comparable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.col(order), F.xxhash64(*comparable)]


def _same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    condition = F.lit(True)
    for column in columns:
        condition = condition & left[column].eqNullSafe(right[column])
    return condition


def _split(df: DataFrame, group: str, order: str, rows_per_range: int):
    """Rows of ordinary groups, and those of large groups with their ``_range``, or None.

    Ranges are those of a range exchange, so equal orders share one; they are
    written, since bounds are sampled anew by each evaluation.  Where more ranges are
    wanted than the exchange has partitions, each group is cut again within a partition.
    """
    large = df.groupBy(group).count().filter(F.col("count") > rows_per_range)
    rows = large.agg(F.sum("count")).first()[0]
    if not rows:
        return df, None
    spark = df.sparkSession
    large = large.select(F.col(group).alias("_group"))
    inside = F.col(group).eqNullSafe(F.col("_group"))
    path = fresh_path(spark, "ranges")
    wanted = -(-rows // rows_per_range) + 1
    ranged = df.join(large, inside, "left_semi").repartitionByRange(
        min(wanted, MOST_PARTITIONS), group, order
    ).withColumn("_range", F.spark_partition_id())
    if wanted > MOST_PARTITIONS:
        # By rank, so equal orders still share a range.
        place = F.rank().over(Window.partitionBy("_range", group).orderBy(order)) - 1
        cut = F.floor(place / rows_per_range).cast("bigint")
        ranged = ranged.withColumn("_range", F.shiftleft(F.col("_range").cast("bigint"), 32) + cut)
    ranged.write.parquet(path)
    return df.join(large, inside, "left_anti"), spark.read.schema(ranged.schema).parquet(path)


def with_position(
    df: DataFrame, group: str, order: str, *, name: str = "position",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """0-based position of each row in its group by an order column."""
    small, ranged = _split(df, group, order, rows_per_range)
    number = F.row_number().over(Window.partitionBy(group).orderBy(*_order(df, order)))
    numbered = small.withColumn(name, (number - 1).cast("bigint"))
    if ranged is None:
        return numbered
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = ranged.groupBy(group, "_range").count().select(
        group, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(group, "_range").orderBy(*_order(df, order))
    local = ranged.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = local.join(offsets, _same(local, offsets, group, "_range")).select(
        *(local[c] for c in df.columns),
        (F.col("_offset") + F.col("_inside")).cast("bigint").alias(name),
    )
    return numbered.unionByName(joined)


def with_next(
    df: DataFrame, group: str, order: str, values: dict[str, Column], *,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add values of the next row of the group by an order column.

    ``values`` maps new column names to expressions over the next row; they
    are NULL at the end of a group.
    """
    row = F.struct(*[expression.alias(name) for name, expression in values.items()])
    small, ranged = _split(df, group, order, rows_per_range)
    following = F.lead(row).over(Window.partitionBy(group).orderBy(*_order(df, order)))
    after = small.withColumn("_next", following).withColumns(
        {name: F.col("_next")[name] for name in values}
    ).drop("_next")
    if ranged is None:
        return after
    inside = Window.partitionBy(group, "_range").orderBy(*_order(df, order))
    across = Window.partitionBy(group).orderBy("_range")
    heads = ranged.groupBy(group, "_range").agg(
        F.min_by(F.struct(row.alias("row")), F.struct(*_order(df, order))).alias("_head")
    ).select(group, "_range", F.lead("_head").over(across)["row"].alias("_following"))
    local = ranged.withColumn("_next", F.lead(row).over(inside))
    joined = local.join(heads, _same(local, heads, group, "_range")).select(
        *(local[c] for c in df.columns),
        *(F.coalesce("_next", "_following")[name].alias(name) for name in values),
    )
    return after.unionByName(joined)
