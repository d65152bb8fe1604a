import duckdb
import pytest

from topicscope.functions.dist import t_pvalue_sql

# FIXTURES.md t_points: (t, df, two-sided p)
POINTS = [(-2.0, 10.0, 0.0733880348), (4.74, 618.0, 2.654968e-6), (9.95, 618.0, 9.805985e-22),
          (1.0, 1.0, 0.5), (0.0, 5.0, 1.0)]


@pytest.mark.parametrize("t,df,p", POINTS)
def test_t_pvalue_spark(spark, t, df, p):
    got = spark.sql(f"SELECT {t_pvalue_sql(f'CAST({t} AS DOUBLE)', f'CAST({df} AS DOUBLE)', 'spark')} AS p").collect()[0][0]
    assert got == pytest.approx(p, rel=1e-6)


@pytest.mark.parametrize("t,df,p", POINTS)
def test_t_pvalue_duckdb_twin(t, df, p):
    got = duckdb.sql(f"SELECT {t_pvalue_sql(f'CAST({t} AS DOUBLE)', f'CAST({df} AS DOUBLE)', 'duckdb')}").fetchall()[0][0]
    assert got == pytest.approx(p, rel=1e-6)


def test_t_pvalue_nulls(spark):
    got = spark.sql(f"SELECT {t_pvalue_sql('CAST(NULL AS DOUBLE)', 'CAST(3 AS DOUBLE)', 'spark')} AS p").collect()[0][0]
    assert got is None


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, -2.5, 4.0])
def test_normal_two_sided(spark, z):
    import math

    from pyspark.sql import functions as F

    from topicscope.operators.stats import normal_two_sided
    got = spark.range(1).select(normal_two_sided(F.lit(z)).alias("p")).collect()[0].p
    assert got == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-7)


def quantile_by_integration(df):
    """The point up to which the density holds 0.475 from 0 on: Simpson's rule and bisection."""
    import math

    import numpy as np
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def area(t, n=20_000):
        x = np.linspace(0, t, 2 * n + 1)
        y = front * np.exp(-(df + 1) / 2 * np.log1p(x * x / df))
        return t / (6 * n) * (y[0] + y[-1] + 4 * y[1::2].sum() + 2 * y[2:-1:2].sum())
    low, high = 1.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < 0.475 else (low, mid)
    return low


def test_t_quantile(spark):
    from topicscope.functions.dist import t_quantile, t_quantile_sql
    dfs = [1.0, 2.0, 5.0, 30.5, 618.0, 1e6]
    want = [quantile_by_integration(v) for v in dfs]
    assert want[:3] == pytest.approx([12.706204736432095, 4.302652729911275, 2.5705818366147395], rel=1e-9)   # known points
    rows = spark.createDataFrame([(v,) for v in dfs] + [(None,), (0.5,)], "df double")
    got = [r.t for r in rows.coalesce(1).select(t_quantile(0.05, "df").alias("t")).collect()]
    assert got[:-2] == pytest.approx(want, rel=1e-8) and got[-2:] == [None, None]
    sql = ", ".join(t_quantile_sql(0.05, f"{v}::DOUBLE", "duckdb") for v in dfs)
    assert list(duckdb.sql(f"SELECT {sql}").fetchall()[0]) == pytest.approx(want, rel=1e-8)
