"""Multiple-comparison adjustment of p-values.

``adjust`` runs the step procedures as window functions over one family (a
partition of at most k topic rows); ``adjust_single`` reproduces an
adjustment applied to one p-value at a time with a fixed family size n.
Hommel works on the family's sorted p-value array (k values) with
higher-order functions; ``hommel_sql`` renders the same rule for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The interface's names.
METHODS = ("holm", "hochberg", "hommel", "bonferroni", "BH", "BY", "fdr", "none")


def _check(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"p-adjust method must be one of {METHODS}")
    return "BH" if method == "fdr" else method


def harmonic(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda acc, j: acc + 1.0 / j)


def adjust_single(p: Column, n: int | Column, method: str) -> Column:
    """One p-value with family size n: every method but none/BY gives min(1, n p)."""
    method = _check(method)
    n = F.lit(n) if isinstance(n, int) else n
    if method == "none":
        return p
    scaled = n * p * harmonic(n) if method == "BY" else n * p
    return F.when(n <= 1, p).otherwise(F.least(F.lit(1.0), scaled))


def hommel_array(ps: Column) -> Column:
    """Hommel-adjusted values for an ascending-sorted array of p-values."""
    n = F.size(ps)
    at = lambda i: F.element_at(ps, i)  # noqa: E731 (1-based)
    init = F.array_min(F.transform(F.sequence(F.lit(1), n), lambda j: n * at(j) / j))
    q1 = F.transform(F.sequence(F.lit(1), n), lambda m: F.when(m >= 2, F.array_min(
        F.transform(F.sequence(F.lit(2), F.greatest(m, F.lit(2))), lambda k: m * at(n - m + k) / k))))

    def pa(i):
        qs = F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))),
                         lambda m: F.least(m * at(F.least(i, n - m + 1)), F.element_at(q1, m)))
        inner = F.when(n >= 3, F.greatest(init, F.array_max(qs))).otherwise(init)
        return F.greatest(inner, at(i))

    return F.transform(F.sequence(F.lit(1), n), pa)


def adjust(df: DataFrame, method: str, p_col: str = "p_value", family: list[str] | None = None,
           order_tie: str = "topic", out: str = "p_adjusted", m: Column | None = None) -> DataFrame:
    """Add ``out``: p-values adjusted within each family (default: whole table).

    i = row_number over (p, tie column); cumulative windows run over i, so tied
    p-values are handled exactly like a sort-based implementation.  NULL p-values
    are kept and not counted.
    """
    method = _check(method)
    family = family or []
    fam = Window.partitionBy(*family)
    base = df.withColumn("_valid", F.col(p_col).isNotNull())
    order = Window.partitionBy(*family, "_valid").orderBy(F.col(p_col), F.col(order_tie))
    base = base.withColumn("_i", F.row_number().over(order))
    mm = m if m is not None else F.count(p_col).over(fam)
    base = base.withColumn("_m", mm)
    p = F.col(p_col)
    i = F.col("_i")
    mcol = F.col("_m")
    asc = Window.partitionBy(*family, "_valid").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    desc = Window.partitionBy(*family, "_valid").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    if method == "none":
        val = p
    elif method == "bonferroni":
        val = F.least(F.lit(1.0), mcol * p)
    elif method == "holm":
        val = F.least(F.lit(1.0), F.max((mcol - i + 1) * p).over(asc))
    elif method == "hochberg":
        val = F.least(F.lit(1.0), F.min((mcol - i + 1) * p).over(desc))
    elif method == "BH":
        val = F.least(F.lit(1.0), F.min(mcol / i * p).over(desc))
    elif method == "BY":
        val = F.least(F.lit(1.0), F.min(mcol / i * p).over(desc) * harmonic(mcol))
    else:  # hommel
        arr = F.array_sort(F.collect_list(p).over(Window.partitionBy(*family, "_valid")))
        val = F.element_at(hommel_array(arr), i)
        val = F.when(mcol == 2, F.least(F.lit(1.0), F.min((mcol - i + 1) * p).over(desc))).otherwise(val)
    val = F.when(mcol <= 1, p).otherwise(val)
    return base.withColumn(out, F.when(p.isNull(), F.lit(None).cast("double")).otherwise(val)).drop("_valid", "_i", "_m")
