"""Projection and labels over rows of documents: no document-term row is moved or repeated by topic."""
import random

import pytest
from pyspark.sql import functions as F

from topicscope.operators import stats, topics
from topicscope.sources.tables import spread


@pytest.fixture(scope="module")
def study(spark):
    rnd = random.Random(4)
    rows = sorted({(d, f"w{rnd.randint(0, 30)}"): rnd.randint(1, 4) for d in range(40) for _ in range(9)}.items())
    rows = [(d, w, n) for (d, w), n in rows] + [(None, "w1", 2), (None, "w2", 1)]
    tf = {}
    for _, w, n in rows:
        tf[w] = tf.get(w, 0) + n
    phi = {(t, w): rnd.random() for t in ("a", "b", "c") for w in tf if rnd.random() < 0.7 and w not in ("w3", "w4")}
    make = spark.createDataFrame
    return (rows, tf, phi, make(rows, "doc_id bigint, term string, n bigint").repartition(4, "doc_id"), make(list(tf.items()), "term string, tf bigint"),
            make([(t, w, x) for (t, w), x in phi.items()], "topic string, term string, phi double"))


def test_rows_equal_plain_loops(spark, study):
    """Over many blocks; terms without phi count nothing; a null id is a group of its own."""
    rows, tf, phi, dtm, totals, table = study
    want = {}
    for d, w, n in rows:
        sums = want.setdefault(d, [0.0] * 3)
        for i, t in enumerate("abc"):
            sums[i] += n / tf[w] * phi.get((t, w), 0.0)
    got = topics.project_rows(dtm, table, totals, ["a", "b", "c"], pairs=20)
    assert got.select("doc_id").distinct().count() == got.count() == len(want)
    assert all(r.weights == pytest.approx(want[r.doc_id]) for r in got.collect())
    long = topics.long_rows(got.withColumn("y", F.lit(1)), ["a", "b", "c"])
    assert long.columns == ["doc_id", "topic", "weight", "y"] and long.count() == 3 * len(want)


def test_labels_do_not_repeat_terms_by_topic(spark, study):
    """Each document's terms meet one row of its topics, also where an id has two rows; labels are those of the plain count."""
    rows, _, _, dtm, _, _ = study
    theta = [(d, t, float((d * 7 + i * 3) % 5)) for d in [*range(40), 5] for i, t in enumerate("abc")]
    frame = spark.createDataFrame(theta, "doc_id bigint, topic string, weight double")
    norm = {}
    for d, _, w in theta:
        norm[d] = norm.get(d, 0.0) + w
    assigned = [(d, t) for d, t, w in theta if norm[d] and w / norm[d] > 0.05]
    df, ct = {}, {}
    for d, w, _ in rows:
        df[w] = df.get(w, 0) + 1
        for e, t in assigned:
            if e == d:
                ct[t, w] = ct.get((t, w), 0) + 1
    want = {}
    for t in "abc":
        whole = sum(c for (u, _), c in ct.items() if u == t)
        want[t] = min((-(c / whole - df[w] / sum(df.values())), w) for (u, w), c in ct.items() if u == t)[1]
    assert {r.topic: r.label for r in topics.labels_by_assignment(dtm, frame).collect()} == want
    plan = topics.labels_by_assignment(dtm, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "_a" in plan and "posexplode(_a" in plan


def test_large_scans_are_dealt_out_by_id(spark):
    df = spark.range(1000).repartition(40).withColumnRenamed("id", "doc_id")
    assert spread(df, "doc_id", 8).rdd.getNumPartitions() == 40
    dealt = spread(df, "doc_id", 8, always=True)
    assert dealt.rdd.getNumPartitions() == 160
    plan = dealt.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1


def test_folds_read_written_features(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    names, real = [], stats.staged
    monkeypatch.setattr(stats, "staged", lambda df, name: names.append(name) or real(df, name))
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.rand(3).alias("x"), F.rand(4).alias("y"))
    got = stats.cv_regression(VectorAssembler(inputCols=["x"], outputCol="features").transform(df), "y").first()
    assert names == ["cv-features"] and got.n == 60
