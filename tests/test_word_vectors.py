"""Vectors of words and documents over a grid of blocks, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicscope.operators import blocks, embed


def _rows():
    rnd = random.Random(5)
    dtm = [(d, f"w{t}", rnd.randint(1, 3)) for d in range(60) for t in rnd.sample(range(25), rnd.randint(1, 9))]
    vec = [(d, [rnd.random() for _ in range(4)]) for d in range(50)]
    vec += [(3, [1.0, 2.0, 3.0, 4.0]), (7, [0.5]), (8, [None, 1.0, None, 2.0]), (9, None), (None, [1.0] * 4), (999, [1.0] * 4)]
    return dtm, vec


def _plain(dtm, vec):
    sums, n = {}, {}
    for d, t, _ in dtm:
        for v, x in vec:
            if v == d and x is not None:
                sums[t] = sums.get(t, np.zeros(4)) + np.array([y or 0.0 for y in x] + [0.0] * (4 - len(x)))
                n[t] = n.get(t, 0) + 1
    words = {t: sums[t] / n[t] for t in sums}
    docs = {}
    for d in {d for d, *_ in dtm}:
        own = [(words[t], c) for e, t, c in dtm if e == d and t in words]
        if own:
            docs[d] = sum(w * c for w, c in own) / sum(c for _, c in own)
    return words, docs


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (2, 5)])
def test_equal_plain_loops(spark, monkeypatch, shape):
    monkeypatch.setattr(blocks, "grid_size", lambda *_: shape)
    rows, vec = _rows()
    dtm, vectors = spark.createDataFrame(rows + [(100, "alone", 1)], "doc_id bigint, term string, n bigint"), spark.createDataFrame(vec, "doc_id bigint, vector array<float>")
    words, docs = _plain(rows, [(d, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for d, x in vec])
    got = embed.word_vectors(dtm, vectors)
    assert {r.term for r in got.collect()} == set(words)
    for r in got.collect():
        assert np.allclose(r.vector, words[r.term])
    got = embed.document_vectors(dtm, got)
    found = {r.doc_id: r.vector for r in got.collect()}
    assert set(found) == set(docs) and got.count() == len(docs)
    for d, v in found.items():
        assert np.allclose(v, docs[d])


def test_arrays_move_once_a_part(spark, monkeypatch):
    monkeypatch.setattr(blocks, "grid_size", lambda *_: (3, 2))
    dtm = spark.createDataFrame(_rows()[0], "doc_id bigint, term string, n bigint")
    grid = blocks.block_grid(dtm, 4, 1 << 20)
    assert grid.uses.groupBy("term").count().agg(F.max("count")).first()[0] <= 2
    assert grid.docs.groupBy("id").count().agg(F.max("count")).first()[0] <= 3
    pairs = sum(len(r.idx) // 4 for r in grid.docs.collect())
    assert pairs == dtm.count()


def test_grid_grows_slower_than_pairs():
    def arrays(times):
        t, d = blocks.grid_size(8_000_000 * times, 300_000, 50_000 * times, 64, 1 << 23, 12)
        return t * 50_000 * times + d * 300_000
    assert arrays(60) < 60 * arrays(1) and arrays(60) < 8_000_000 * 60 / 10


def test_no_vectors(spark):
    dtm = spark.createDataFrame(_rows()[0], "doc_id bigint, term string, n bigint")
    none = spark.createDataFrame([], "doc_id bigint, vector array<float>")
    words = embed.word_vectors(dtm, none)
    assert words.count() == 0 and embed.document_vectors(dtm, words).count() == 0


def test_doc_vectors_read_no_document_term_table(spark, tmp_path, monkeypatch):
    """A grid made of packed documents gives what the grid of document-term rows gives, with several parts of both; a repeated id under one class is one document."""
    from topicscope.operators import blocks as B
    from topicscope.operators import embed
    from topicscope.plans import q_models
    from topicscope.plans.study import Study
    texts = ["alpha beta beta gamma", "alpha delta delta", "gamma gamma alpha rare", "beta delta", ""]
    docs = [(i % 30 if i % 9 else None, "en", f"s{i % 30 % 3}", texts[i % 5], 10) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0 / (i + 3), -2.5]) for i in range(0, 30, 2)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(B, "LEAST_CELLS", 8)
    s, given = Study(spark, str(tmp_path)), q_models._given_vectors(spark, str(tmp_path))
    grid = B.regrid(s.packed, s.kept_totals.select("term"), 3, 6)
    assert grid.n > 4 and {r.term for r in grid.uses.collect()} == {"alpha", "beta", "gamma", "delta", "rare"}
    words = {r.term: r.vector for r in embed.word_vectors(s.dtm, given).collect()}
    mine = {r.term: r.vector for r in embed.word_vectors(None, given, blocks=grid).collect()}
    assert words.keys() == mine.keys() and all(abs(a - b) < 1e-12 for t in words for a, b in zip(words[t], mine[t]))
    table = spark.createDataFrame(list(words.items()), "term string, vector array<double>")
    want = {(r.doc_id, i): x for r in embed.document_vectors(s.dtm, table).collect() for i, x in enumerate(r.vector)}
    monkeypatch.setattr(Study, "dtm_topic", property(lambda self: 1 / 0))
    got = {(r.doc_id, r.dim): r.value for r in q_models.q_doc_vectors(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(got) > 60 and all(abs(got[x] - want[x]) < 1e-6 for x in got)
