"""Documents counted into blocks where they lie: the same counts as the document-term table, without its rows."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from topicscope.operators import blocks as B
from topicscope.operators import terms

DOCS = [(1, "a", "x y x"), (1, "a", "y z"), (1, "b", "x"), (2, "b", "z z"), (3, None, "x w"), (None, "a", "y"), (None, "a", "y y"), (4, "a", ""), (5, "a", None)]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, topic string, text string")
    return terms.kept_arrays(docs.repartition(3, "doc_id").sortWithinPartitions("doc_id", "topic"), terms.DtmSpec(), ("topic",)).withColumnRenamed("doc_id", "id")


@pytest.mark.parametrize("pairs", [1, 3, 1 << 20])
def test_counts(spark, rows, pairs):
    blocks = B.block_terms(rows, pairs)
    words = spark.createDataFrame([(w,) for w in "wxyz"], "term string")
    got = Counter({(r.id, r.term): r.n for r in B.held_pairs(blocks, words).collect()})
    assert got == Counter((i, w) for i, _, t in DOCS for w in (t or "").split())
    by_class = Counter()
    for r in blocks.classes.collect():
        by_class[r.topic, r.term, "n"] += r.n
        by_class[r.topic, r.term, "df"] += r.df
    want = Counter((c, w, "n") for _, c, t in DOCS for w in (t or "").split())
    want += Counter((c, w, "df") for _, c, w in {(i, c, w) for i, c, t in DOCS for w in (t or "").split()})
    assert by_class == want
    some = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    assert {r.term: r.tf for r in B.term_totals(blocks.of(some), words.where("term <> 'y'")).collect()} == {"x": 3, "z": 3}


def test_documents_are_not_cut_by_batches():
    """Every row a batch of its own: rows of one id still are one document."""
    counter, out = B.Counter(100, 0), []
    t = pa.table({"id": [1, 1, 2], "topic": ["a", "b", "a"], "terms": [["x"], ["x", "y"], ["x"]]})
    out = [*counter.add(t.slice(0, 2)), *counter.add(t.slice(2)), *counter.end()]
    ids = [i for b in out for i, x in zip(b.column("id").to_pylist(), b.column("idx").to_pylist()) if x is not None]
    assert ids == [1, 2]


def test_phi_and_theta_read_no_document_term_table(spark, tmp_path):
    """The study's theta persists no row a document and term (nor the counts of terms that are trimmed)."""
    from topicscope.plans.study import Study
    docs = [(i, "en", f"s{i % 2}", "alpha beta " * 3 + f"rare{'x' * i}", 10) for i in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    s = Study(spark, str(tmp_path))
    weights = {(r.doc_id, r.topic): r.weight for r in s.theta.collect()}
    assert "dtm_topic" not in s.__dict__ and "class_terms" not in s.__dict__
    assert len(weights) == 40 and all(np.isclose(w, 3 / 60 * 0.5 * 2) for w in weights.values())
    assert {r.term for r in s.class_kept.collect()} == {"alpha", "beta"}


def test_topic_labels_read_no_document_term_table(spark, tmp_path):
    """Labels from blocks are those from document-term rows, also where an id is null or no topic takes a document."""
    from topicscope.operators import topics
    from topicscope.plans import q_topics
    from topicscope.plans.study import Study
    texts = ["alpha beta beta gamma", "alpha delta delta", "gamma gamma alpha", "beta delta", ""]
    docs = [(i % 31 if i % 9 else None, "en", f"s{i % 3}" if i % 7 else None, texts[i % 5], 10) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    s = Study(spark, str(tmp_path))
    assert s.again.where("doc_id IS NOT NULL").count()
    want = sorted(topics.labels_by_assignment(s.dtm, s.theta, 0.05).collect())
    got = q_topics.q_topic_labels(spark, str(tmp_path))
    assert sorted(got.collect()) == want and len(want) == 3
    ngram = Study(spark, str(tmp_path), ngram=(1, 2))
    assert sorted(topics.labels_by_blocks(ngram.packed, ngram.kept_totals, ngram.theta, ngram.topic_list, again=ngram.again).collect()) == sorted(topics.labels_by_assignment(ngram.dtm, ngram.theta).collect())
    read = []
    Study_dtm = Study.dtm_topic.func
    Study.dtm_topic.func = lambda self: read.append(1) or Study_dtm(self)
    try:
        q_topics.q_topic_labels(spark, str(tmp_path)).collect()
    finally:
        Study.dtm_topic.func = Study_dtm
    assert not read
