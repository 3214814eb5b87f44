"""Numbers in order for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df and `name`: each row's number from 0 in its group, in the order of the columns `order`, which tell all rows of a group apart.

    A group may hold all rows: they are dealt by ranges of (group, order), written, and numbered within
    their range; one row per group and range says how many lie in the ranges before. So no task has more
    than a range. Rows that `order` cannot tell apart get numbers in any order.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")  # numbers and counts must see the same ranges
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)) - 1
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_range"]]
    met = ranged.withColumn("_inside", inside).alias("a").join(counts.alias("b"), [*same])
    number: Column = (F.col("a._inside") + F.col("b._before")).cast("int")
    return met.select(*[F.col(f"a.{c}") for c in df.columns if c != name], number.alias(name))
