"""Global positions and running sums without a global sort in one task.

Rows are range-partitioned on the order, sorted in their tasks and written with
their position there; a task's offset is a running sum over one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicscope.staging import staged

#: ``monotonically_increasing_id``: partition number above, row in the partition below.
ROW_BITS = 33


def placed(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` in order as a written table, with ``_part`` (in order) and ``_row`` (from 0 in its part)."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return (staged(rows, name).withColumn("_part", F.shiftright("_at", ROW_BITS))
            .withColumn("_row", F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)).drop("_at"))


def offsets(rows: DataFrame, amount: Column | None = None) -> DataFrame:
    """(_part, _offset, _total): the sum of ``amount`` (rows by default) in the parts before, and in all; one row a part."""
    amount = F.lit(1) if amount is None else amount
    parts = rows.groupBy("_part").agg(F.sum(amount).cast("bigint").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"), F.sum("_c").over(Window.partitionBy()).alias("_total"))


def ranked(df: DataFrame, *order: Column, name: str = "ranked", rank: str = "rank", total: str = "total") -> DataFrame:
    """Add the 1-based position in ``order`` (a total order) and the number of rows."""
    rows = placed(df, *order, name=name)
    return (rows.join(F.broadcast(offsets(rows)), "_part").withColumn(rank, F.col("_offset") + F.col("_row") + 1)
            .withColumnRenamed("_total", total).drop("_part", "_row", "_offset"))
