from pyspark.sql import functions as F

from topicscope.plans import workflow as W
from topicscope.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_end_to_end_small(spark, tmpdir_path):
    docs = read_table(spark, SF, "documents").where("lang = 'en'").join(read_table(spark, SF, "labels"), "doc_id")
    b = W.get_dtm(spark, docs, "doc_id", "text", group_var="quality", ngram_window=(1, 2),
                  removal_mode="threshold", removal_rate_least=1, removal_rate_most=500, split=0.8, save_dir=tmpdir_path)
    tr = {r.doc_id for r in b.train_data.select("doc_id").collect()}
    te = {r.doc_id for r in b.test_data.select("doc_id").collect()}
    assert tr and te and not (tr & te)                         # disjoint split
    m = W.get_lda_model(b, "B", num_topics=3, num_iterations=5, save_dir=tmpdir_path)
    assert m.summary.count() == 3
    preds = W.get_lda_preds(m, b, outcomes=["quality", "n_chars"], pred_mode="function")
    s = preds.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-6 for r in s)
    res = W.topic_test(preds, "n_chars", m.summary, test_method="correlation", multiple_comparison="holm")
    assert res.count() == 3
    assert all(r.p_adjusted is None or r.p_adjusted >= r.p_value - 1e-15 for r in res.collect())
    lin = W.topic_test(preds, "n_chars", m.summary, test_method="linear_regression", multiple_comparison="fdr")
    table = W.plot_wordclouds(m.summary, m.phi, lin)
    assert set(table.columns) >= {"topic", "word", "phi", "sign", "max_size", "p_label"}
    custom = W.get_lda_preds(m, b, pred_mode="custom")
    assert custom.count() > 0


def test_get_dtm_variants_and_sweep(spark):
    docs = read_table(spark, SF, "documents").where("lang = 'en'").select("doc_id", "text", "n_chars")

    def build(spark, **params):
        return W.get_dtm(spark, docs, "doc_id", "text", **params)

    runs = W.sweep(spark, {
        "pct": dict(removal_mode="percent", removal_rate_most=0.01, removal_rate_least=0.1, split=0.8),
        "indep": dict(removal_mode="threshold", removal_rate_least=1, removal_rate_most=None, split=0.8,
                      independent_test=True, removal_word="the"),
    }, build)
    pct, indep = runs["pct"], runs["indep"]
    train_terms = {r.term for r in pct.train_dtm.select("term").distinct().collect()}
    test_terms = {r.term for r in pct.test_dtm.select("term").distinct().collect()}
    assert test_terms <= train_terms                      # default: test restricted to train vocabulary
    assert indep.test_dtm.count() > 0
    assert "the" not in {r.term for r in indep.train_dtm.select("term").distinct().collect()}


def test_id_column(spark):
    lo = spark.createDataFrame([(d, t, 0.1 * ((d * (t + 2)) % 7) + 0.01 * d, 1.5 * d) for d in range(12) for t in range(2)],
                               "id int, topic int, weight double, score double")
    summary = spark.createDataFrame([(0, "a b", 5.0, 0.1, "L"), (1, "c d", 9.0, 0.2, "M")], "topic int, top_terms string, prevalence double, coherence double, label string")
    for method in ("linear_regression", "logistic_regression"):
        rows = W.topic_test(lo, "score", summary, test_method=method, id_col="id").collect()
        assert len(rows) == 2 and all(0 <= r.p_value <= 1 for r in rows)


def test_split_and_family_act(spark):
    """A continuous outcome is split as asked; min_max compares the n lowest and highest documents; compat widens the family."""
    lo = spark.createDataFrame([(d, t, 0.1 * ((d * (t + 2)) % 7) + 0.01 * d * t, d + 0.5) for d in range(80) for t in range(2)],
                               "doc_id int, topic int, weight double, score double")
    summary = spark.createDataFrame([(0, "a, b", 5.0, 0.1, "L"), (1, "c, d", 0.5, 0.2, "M")], "topic int, top_terms string, prevalence double, coherence double, label string")
    run = lambda **kw: W.topic_test(lo, "score", summary, test_method="t-test", **kw).collect()
    assert {r.pair for r in run()} == {"Group1_Group2"} and {r.n_1 + r.n_2 for r in run()} == {80}
    assert len({r.pair for r in run(split="quartile")}) == 6
    got = run(split="min_max", n_min_max=7)
    assert {(r.pair, r.n_1, r.n_2) for r in got} == {("max_min", 7, 7)}
    few = lo.withColumn("score", F.col("doc_id") % 3)
    assert len({r.pair for r in W.topic_test(few, "score", summary, test_method="t-test").collect()}) == 3     # not continuous: its values
    wide, own = ({r.topic: r.p_adjusted for r in W.topic_test(lo, "score", summary, test_method="correlation", compat=c).collect()} for c in (True, False))
    p = {r.topic: r.p_value for r in W.topic_test(lo, "score", summary, test_method="correlation").collect()}
    assert all(abs(wide[t] - min(1, 3 * p[t])) < 1e-12 and abs(own[t] - min(1, 2 * p[t])) < 1e-12 for t in p)
    phi = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.2), (1, "c", 0.4)], "topic int, term string, phi double")
    cloud = W.plot_wordclouds(summary, phi, W.topic_test(lo, "score", summary, test_method="t-test"), plot_topics_idx=[2]).collect()
    assert {(r.topic, r.word, r.max_size) for r in cloud} == {(1, "c", 0.0), (1, "d", 0.0)}                    # below 1 %: size 0, not negative


def test_save_and_reload(spark, tmpdir_path):
    """Every stage reads back what it wrote, and refuses other parameters or documents."""
    import pytest
    docs = read_table(spark, SF, "documents").where("lang = 'en'").select("doc_id", "text", "n_chars")
    kw = dict(ngram_window=(1, 1), removal_mode="threshold", removal_rate_least=2, removal_rate_most=None, split=0.8)
    b = W.get_dtm(spark, docs, "doc_id", "text", save_dir=tmpdir_path, **kw)
    again = W.get_dtm(spark, docs, "doc_id", "text", load_dir=tmpdir_path, **kw)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(again.train_dtm) == rows(b.train_dtm) and rows(again.test_dtm) == rows(b.test_dtm)
    with pytest.raises(ValueError, match="least"):
        W.get_dtm(spark, docs, "doc_id", "text", load_dir=tmpdir_path, **{**kw, "removal_rate_least": 3})
    with pytest.raises(ValueError, match="corpus"):
        W.get_dtm(spark, docs.where("doc_id > 5"), "doc_id", "text", load_dir=tmpdir_path, **kw)
    m = W.get_lda_model(b, "B", num_topics=3, num_iterations=2, save_dir=tmpdir_path)
    m2 = W.get_lda_model(again, "B", num_topics=3, num_iterations=2, load_dir=tmpdir_path)
    assert rows(m2.summary) == rows(m.summary)
    with pytest.raises(ValueError, match="num_topics"):
        W.get_lda_model(again, "B", num_topics=4, num_iterations=2, load_dir=tmpdir_path)
    p = W.get_lda_preds(m, b, ["n_chars"], save_dir=tmpdir_path)
    p2 = W.get_lda_preds(m2, again, ["n_chars"], load_dir=tmpdir_path)
    key = lambda df: {(r.doc_id, r.topic): (round(r.weight, 9), r.n_chars) for r in df.collect()}
    assert key(p) == key(p2) == key(W.get_lda_preds(m2, again, ["n_chars"]))
    with pytest.raises(ValueError, match="pred_mode"):
        W.get_lda_preds(m2, again, ["n_chars"], pred_mode="custom", load_dir=tmpdir_path)
    frozen = W.get_lda_preds(m2, again, pred_mode="mallet", num_iterations=20)
    assert all(abs(r.s - 1) < 1e-6 for r in frozen.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect())
    t = W.topic_test(p, "n_chars", m.summary, save_dir=tmpdir_path)
    assert len(rows(W.topic_test(p2, "n_chars", m2.summary, load_dir=tmpdir_path))) == t.count() == 3
    with pytest.raises(ValueError, match="adjust"):
        W.topic_test(p2, "n_chars", m2.summary, multiple_comparison="holm", load_dir=tmpdir_path)


def test_one_shot_and_embedding_topics(spark):
    docs = read_table(spark, SF, "documents").where("lang = 'en'").join(read_table(spark, SF, "labels"), "doc_id").select("doc_id", "text", "quality")
    model, res = W.get_topic_test(spark, docs, "doc_id", "text", "quality", "B", num_topics=2, num_iterations=2)
    assert {r.pair for r in res.collect()} == {"0_1"} and res.count() == 2 and model.summary.count() == 2
    vec = read_table(spark, SF, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    all_docs = read_table(spark, SF, "documents").withColumn("other", F.lower("text"))
    for kw in (dict(), dict(representation="mmr", bm25_weighting=True), dict(representation="default", reduce_frequent_words=True, min_df=2, n_gram_range=(1, 2))):
        t = W.create_embedding_topics(all_docs, vec, "text", num_topics=3, top_n_words=4, **kw)
        top = t.top.where("topic <> -1").collect()
        assert {r.rank for r in top} <= {1, 2, 3, 4} and len({r.topic for r in top}) == t.summary.count() > 0
        assert sum(r.size for r in t.info.collect()) == t.assigned.join(all_docs, "doc_id").count()
    runs = W.sweep_embedding_topics(all_docs, {"given": vec}, ["text", "other"], num_topics=2, top_n_words=2)
    assert {r.run for r in runs.select("run").distinct().collect()} == {"given/text", "given/other"}
