"""Closed-form and brute-force checks of the topic tests on the `loadings` fixture."""
import math
import random

import numpy as np
import pytest

from topicscope.operators import stats


@pytest.fixture(scope="module")
def loadings(spark):
    rnd = random.Random(7)
    rows = []
    for d in range(30):
        g = "a" if d < 14 else ("b" if d < 29 else "c")        # group c has one document
        y1 = rnd.gauss(0, 1)
        y2 = rnd.gauss(0, 1)
        for t in (1, 2, 3):
            w = 0.5 if t == 3 else rnd.random() + (0.3 if g == "a" and t == 1 else 0)   # topic 3: zero variance
            rows.append((d, t, w, g, y1 + (w if t == 1 else 0), y2))
    return spark.createDataFrame(rows, "doc_id int, topic int, weight double, g string, y1 double, y2 double")


def welch_np(x, y):
    m1, m2 = np.mean(x), np.mean(y)
    v1, v2 = np.var(x, ddof=1), np.var(y, ddof=1)
    se2 = v1 / len(x) + v2 / len(y)
    t = (m1 - m2) / math.sqrt(se2)
    df = se2 ** 2 / ((v1 / len(x)) ** 2 / (len(x) - 1) + (v2 / len(y)) ** 2 / (len(y) - 1))
    sp = math.sqrt(((len(x) - 1) * v1 + (len(y) - 1) * v2) / (len(x) + len(y) - 2))
    return t, df, (m1 - m2) / sp


def test_welch_against_numpy(spark, loadings):
    res = {(r.pair, r.topic): r for r in stats.welch_ttest(loadings, "g", "fdr").collect()}
    pdf = loadings.toPandas()
    x = pdf[(pdf.g == "a") & (pdf.topic == 1)].weight.values
    y = pdf[(pdf.g == "b") & (pdf.topic == 1)].weight.values
    t, df, d = welch_np(x, y)
    r = res[("a_b", 1)]
    assert r.t_stat == pytest.approx(t, rel=1e-9)
    assert r.df == pytest.approx(df, rel=1e-9)
    assert r.cohen_d == pytest.approx(d, rel=1e-9)
    assert 0 < r.p_value < 1
    assert r.p_adjusted == pytest.approx(min(1.0, 3 * r.p_value))   # one p at a time, n = 3 groups


def test_welch_null_rules(spark, loadings):
    res = {(r.pair, r.topic): r for r in stats.welch_ttest(loadings, "g", "fdr").collect()}
    assert res[("a_c", 1)].t_stat is None          # group of size 1
    assert res[("a_b", 3)].t_stat is None          # both variances 0
    assert res[("a_b", 3)].p_value is None


def test_correlation_against_numpy(spark, loadings):
    res = {r.topic: r for r in stats.correlation_test(loadings, "y1", "bonferroni").collect()}
    pdf = loadings.toPandas()
    sub = pdf[pdf.topic == 1]
    r = np.corrcoef(sub.weight, sub.y1)[0, 1]
    n = len(sub)
    assert res[1].estimate == pytest.approx(r, rel=1e-9)
    assert res[1].t_stat == pytest.approx(r * math.sqrt((n - 2) / (1 - r * r)), rel=1e-9)
    z = math.atanh(r)
    assert res[1].conf_low == pytest.approx(math.tanh(z - 1.959963984540054 / math.sqrt(n - 3)), rel=1e-9)


def test_regression_against_lstsq(spark, loadings):
    res = {(r.topic, r.variable): r for r in stats.linear_regression(loadings, ["y1", "y2"], "fdr").collect()}
    pdf = loadings.toPandas()
    per_doc = pdf.drop_duplicates("doc_id")
    zs = {c: (pdf[c] - per_doc[c].mean()) / per_doc[c].std(ddof=1) for c in ("y1", "y2")}
    sub = pdf.topic == 1
    w = pdf.weight[sub]
    y = (w - w.mean()) / w.std(ddof=1)
    X = np.column_stack([np.ones(sub.sum()), zs["y1"][sub], zs["y2"][sub]])
    beta, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    s2 = rss[0] / (len(y) - 3)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    assert res[(1, "y1")].estimate == pytest.approx(beta[1], rel=1e-8)
    assert res[(1, "y2")].t_value == pytest.approx(beta[2] / se[2], rel=1e-8)
    multi = {(r.topic, r.variable): r for r in stats.linear_regression_multi(
        stats._z_loadings(loadings, ["y1", "y2"]), ["y1", "y2"], "fdr").collect()}
    assert multi[(1, "y1")].estimate == pytest.approx(beta[1], rel=1e-8)
    assert multi[(1, "y2")].p_value == pytest.approx(res[(1, "y2")].p_value, rel=1e-8)


def test_zscore_zero_variance(spark, loadings):
    z = stats.zscore(loadings, "weight", ["topic"], "z")
    assert {r.z for r in z.where("topic = 3").collect()} == {0.0}


def test_splits(spark, loadings):
    per_doc = loadings.where("topic = 1").select("doc_id", "y1")
    med = stats.median_split(per_doc, "y1", "grp")
    vals = sorted(r.y1 for r in per_doc.collect())
    m = float(np.median(vals))
    assert all((r.grp == "Group1") == (r.y1 >= m) for r in med.collect())
    q = stats.quartile_split(per_doc, "y1", "grp").collect()
    assert {r.grp for r in q} == {"Q1", "Q2", "Q3", "Q4"}
    mm = stats.min_max_split(per_doc, "y1", 5).collect()
    assert sorted(r.y1 for r in mm if r.split_group == "min") == vals[:5]


def test_exact_quantile_matches_numpy(spark):
    from topicscope.functions.quantile import exact_quantile
    rnd = random.Random(5)
    vals = [rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 20))]) for _ in range(20000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for q in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0):
        got = df.select(exact_quantile(df, "x", q).alias("v")).limit(1).collect()[0].v
        assert got == pytest.approx(float(np.quantile(vals, q)), abs=1e-12)


def test_quantiles_together_in_one_scan(spark):
    """All quantiles at once, with ties over a third of the rows, nulls and no rows at all."""
    import numpy as np
    from pyspark.sql import functions as F
    from topicscope.functions.quantile import exact_quantiles
    x = [7.0] * 400 + [float((i * 37) % 501) / 4 for i in range(800)]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)] * 5, "x double").repartition(6)
    qs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = spark.range(1).select(F.array(*exact_quantiles(df, "x", qs)).alias("q")).first().q
    assert got == pytest.approx(np.quantile(x, qs).tolist())
    assert spark.range(1).select(F.array(*exact_quantiles(df.limit(0), "x", qs)).alias("q")).first().q == [None] * 7


def test_exact_split(spark):
    """The number of training rows is exact, with ties of key and id over a third of the rows and null ids; the rest is as by sorting."""
    import hashlib
    from topicscope.operators import clean
    ids = [7] * 400 + list(range(100, 900)) + [None] * 30
    df = spark.createDataFrame([(i, "x") for i in ids], "id bigint, split_of string").repartition(5)
    key = lambda i: (-1 if i is None else int(hashlib.md5(f"{i}:1234".encode()).hexdigest()[:8], 16), -1 if i is None else i)
    for split in (0.0, 0.1, 0.5, 0.77, 1.0):
        got = clean.train_test_split_exact(df, "id", split, 1234).collect()
        want = sorted(ids, key=key)[:round(len(ids) * split)]
        train = sorted((r.id for r in got if r.split == "train"), key=key)
        assert len(got) == len(ids) and train == want, split
    assert clean.train_test_split_exact(df.limit(0), "id", 0.5, 1).count() == 0


def test_binomial_fit(spark):
    """Estimates and errors against dense Newton steps; separated and one-sided topics have no result."""
    import numpy as np
    from topicscope.operators import stats
    rng = np.random.default_rng(3)
    rows = [(t, d, float(rng.normal() + (t == 1) * (d % 2)), (d % 2) if t < 3 else 1) for t in range(3) for d in range(200)]
    rows = [(t, d, (10.0 if y else -10.0) + d / 1e3 if t == 2 else w, y) for t, d, w, y in rows] + [(4, d, float(d), 1) for d in range(20)]
    got = {r.topic: r for r in stats.logistic_binomial(spark.createDataFrame(rows, "topic int, doc_id int, weight double, y int"), "y").collect()}
    for t in (0, 1):
        w, y = (np.array([r[k] for r in rows if r[0] == t], "f8") for k in (2, 3))
        x = np.stack([np.ones(len(w)), (w - w.mean()) / w.std(ddof=1)], axis=1)
        b = np.zeros(2)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-x @ b))
            info = (x * (mu * (1 - mu))[:, None]).T @ x
            b = b + np.linalg.solve(info, x.T @ (y - mu))
        assert got[t].estimate == pytest.approx(b[1], rel=1e-8) and got[t].z_value == pytest.approx(b[1] / np.linalg.inv(info)[1, 1] ** 0.5, rel=1e-6)
    assert got[2].estimate is None and got[4].estimate is None and got[4].p_value is None
