"""Exact quantiles (type 7, linear interpolation) of a distributed column, any number in one scan.

``percentile``/``median`` merge every distinct value into one aggregation
buffer.  Here the input is read once for its value histogram (ties collapse
into counts), which is range-partitioned by value; running counts come from
sums within parts and offsets of parts, and all requested ranks are looked up
in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicscope.functions import ranks


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> list[Column]:
    """Scalar Columns with the type-7 quantiles of ``col`` (NULLs ignored; NULL when there are no values)."""
    hist = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull()).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    rows = ranks.placed(hist, F.col("x"), name="value-histogram")
    upto = F.sum("c").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    cum = (rows.withColumn("_in", upto).join(F.broadcast(ranks.offsets(rows, F.col("c"))), "_part")
           .select("x", (F.col("_offset") + F.col("_in")).alias("_end"), F.col("_total").alias("n")))   # _end: number of values <= x
    h = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_end") > rank, F.col("x")))

    found = cum.agg(F.max("n").alias("n"), *[at(F.floor(x)).alias(f"a{i}") for i, x in enumerate(h)],
                    *[at(F.least(F.floor(x) + 1, F.col("n") - 1)).alias(f"b{i}") for i, x in enumerate(h)])
    values = [F.col(f"a{i}") + (x - F.floor(x)) * (F.col(f"b{i}") - F.col(f"a{i}")) for i, x in enumerate(h)]
    all_of_them = found.select(F.array(*values)).scalar()
    return [all_of_them[i] for i in range(len(qs))]


def exact_quantile(df: DataFrame, col: str, q: float) -> Column:
    return exact_quantiles(df, col, [q])[0]
