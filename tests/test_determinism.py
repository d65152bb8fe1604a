"""Same result under 1, 4 and 7 input partitions."""
from pyspark.sql import functions as F

from topicscope.functions.stopwords import SNOWBALL_EN
from topicscope.operators import clean, stats, terms, topics, vocab

SF = "/root/testdata/sf0.001"


def pipeline(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").repartition(parts)
    spec = terms.DtmSpec(ngram=(1, 2), stopwords=SNOWBALL_EN)
    dtm = terms.dtm_long(docs, spec)
    ranked = vocab.rank_terms(terms.term_totals(dtm))
    kept = vocab.keep_by_rank(ranked, least=0.2, most=5, mode="percent")
    dtm_t = vocab.restrict(dtm, kept)
    phi = topics.class_phi(dtm_t, docs.select("doc_id", F.col("source").alias("topic")))
    theta = topics.project(vocab.relative_frequency(dtm_t, terms.term_totals(dtm_t)), phi)
    split = clean.train_test_split(docs.select("doc_id"), "doc_id", 0.7, 42)
    lo = stats.attach_outcomes(theta, docs.select("doc_id", "n_chars"), ["n_chars"])
    corr = stats.correlation_test(lo, "n_chars", "holm")
    return (sorted((r.term, r.rank) for r in ranked.collect()),
            sorted((r.doc_id, r.split) for r in split.collect()),
            sorted((r.topic, round(r.estimate, 12), round(r.p_adjusted, 12)) for r in corr.collect()))


def test_partition_invariance(spark):
    a = pipeline(spark, 1)
    for parts in (4, 7):
        assert pipeline(spark, parts) == a


def test_study_checkpoint_mode_equals_persist(spark):
    from topicscope.plans.study import Study
    a = Study(spark, SF).theta
    b = Study(spark, SF, materialize="checkpoint").theta
    ra = sorted((r.doc_id, r.topic, round(r.weight, 12)) for r in a.collect())
    rb = sorted((r.doc_id, r.topic, round(r.weight, 12)) for r in b.collect())
    assert ra == rb
