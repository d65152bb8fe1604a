"""p-adjust against an independent step-by-step implementation of the eight rules."""
import math

import pytest
from pyspark.sql import functions as F

from topicscope.functions import padjust

PVALS = [0.001, 0.01, 0.02, 0.04, 0.04, 0.5]


def reference(p, method):
    n = len(p)
    o = sorted(range(n), key=lambda i: (p[i], i))
    ps = [p[i] for i in o]
    if method == "bonferroni":
        adj = [min(1, n * x) for x in ps]
    elif method == "holm":
        adj, run = [], 0
        for i, x in enumerate(ps, 1):
            run = max(run, (n - i + 1) * x)
            adj.append(min(1, run))
    elif method in ("hochberg", "BH", "BY"):
        q = sum(1 / j for j in range(1, n + 1)) if method == "BY" else 1
        adj, run = [0] * n, math.inf
        for i in range(n, 0, -1):
            f = (n - i + 1) if method == "hochberg" else n / i * q
            run = min(run, f * ps[i - 1])
            adj[i - 1] = min(1, run)
    elif method == "hommel":
        q = pa = [min(n * ps[j] / (j + 1) for j in range(n))] * n
        pa = list(pa)
        for m in range(n - 1, 1, -1):
            i1 = list(range(0, n - m + 1))
            i2 = list(range(n - m + 1, n))
            q1 = min(m * ps[i] / (k + 2) for k, i in enumerate(i2))
            q = [0.0] * n
            for i in i1:
                q[i] = min(m * ps[i], q1)
            for i in i2:
                q[i] = q[n - m]
            pa = [max(a, b) for a, b in zip(pa, q)]
        adj = [max(a, b) for a, b in zip(pa, ps)]
    else:
        adj = ps
    out = [0] * n
    for rank, i in enumerate(o):
        out[i] = adj[rank]
    return out


@pytest.mark.parametrize("method", ["bonferroni", "holm", "hochberg", "BH", "fdr", "BY", "hommel", "none"])
def test_adjust_matches_reference(spark, method):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PVALS)], "topic int, p_value double")
    got = {r.topic: r.p_adjusted for r in padjust.adjust(df, method).collect()}
    want = reference(PVALS, "BH" if method == "fdr" else method)
    for i in range(len(PVALS)):
        assert got[i] == pytest.approx(want[i], abs=1e-12)
        assert got[i] >= PVALS[i] - 1e-15


def test_adjust_single_family_size(spark):
    df = spark.createDataFrame([(0.01,)], "p double")
    r = df.select(padjust.adjust_single(F.col("p"), 4, "holm").alias("a"),
                  padjust.adjust_single(F.col("p"), 4, "BY").alias("b"),
                  padjust.adjust_single(F.col("p"), 1, "bonferroni").alias("c")).collect()[0]
    assert r.a == pytest.approx(0.04)
    assert r.b == pytest.approx(0.04 * (1 + 1 / 2 + 1 / 3 + 1 / 4))
    assert r.c == pytest.approx(0.01)


def test_unknown_method():
    with pytest.raises(ValueError):
        padjust.adjust_single(F.lit(0.1), 2, "nope")
