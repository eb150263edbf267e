"""Row numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.shared import checkpointed


def numbered(df: DataFrame, *order: str | Column, name: str = "rn") -> DataFrame:
    """df with `name`: 1, 2, ... in the given order, which must tell all rows apart.

    Rows are dealt out by ranges of the order; each range is numbered by itself and moved by the number of
    rows in the ranges before it, a table of one row for each range.
    """
    # The ranges come from a sample: they are drawn once, for the counts and for the rows.
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(moved), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
