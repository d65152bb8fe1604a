"""A fit on documents counted where they lie equals the fit on document-term rows."""
from collections import Counter

import numpy as np

from topicscope.operators import blocks as B
from topicscope.operators import lda, terms

DOCS = [(1, "a", "x y x"), (1, "a", "y z"), (1, "b", "x"), (2, "b", "z z"), (3, None, "x w"), (4, "a", ""), (5, "a", None)]


def test_fit_on_blocks_is_the_fit_on_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, topic string, text string")
    rows = terms.kept_arrays(docs.repartition(3, "doc_id").sortWithinPartitions("doc_id", "topic"), terms.DtmSpec(), ("topic",)).withColumnRenamed("doc_id", "id")
    dtm = spark.createDataFrame([(i, w, n) for (i, w), n in Counter((i, w) for i, _, t in DOCS for w in (t or "").split()).items()], "doc_id bigint, term string, n bigint")
    cfg = lda.LdaConfig(k=2, max_iter=3)
    blocks = B.block_terms(rows, 3)
    got = lda.fit(None, cfg, blocks=blocks, totals=lda.term_sums(dtm.where("term <> 'w'")))
    want = lda.fit(dtm.where("term <> 'w'"), cfg)
    a, b = ({(r.topic, r.term): r.phi for r in m.phi().collect()} for m in (got, want))
    assert a.keys() == b.keys() and all(np.isclose(a[x], b[x], atol=1e-9) for x in a)
    assert np.allclose(got.alpha, want.alpha, atol=1e-9)
    assert np.isclose(got.quality().first().log_likelihood, want.quality().first().log_likelihood)
