"""Registered queries backed by fitted models.  LDA: L1-L5, L17, I2, I4.

A seeded fit of many rounds has no SQL equivalent and is checked by rows only;
``lda_em_fixed`` (the first rounds of a fit) and ``lda_score_fixed`` (fold-in
against the study's fixed topics) unroll their rounds in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from topicscope.operators import clean, embed, lda, stats, terms, topics
from topicscope.operators import ctfidf as C
from topicscope.operators.blocks import block_grid, regrid, term_totals
from topicscope.plans.oracle import base_ctes, with_base
from topicscope.plans.q_embed import SPEC, Model, base
from topicscope.plans.registry import register, round_doubles
from topicscope.plans.study import Study
from topicscope.sources.tables import read_table, spread
from topicscope.staging import staged

K = 10
ITER = 20


def _fit(spark, sf, config=None):
    s = Study(spark, sf)
    cfg = config or lda.LdaConfig(k=K, max_iter=ITER)
    return s, lda.fit(None, cfg, s.docs, blocks=s.packed, totals=s.kept_totals)


def _summary(s, m):
    top = m.top_terms(10)
    theta = m.theta()
    return topics.summary(top, topics.prevalence(theta), topics.coherence(s.held(top), top, s.n_docs))


@register("lda_fit")
def q_lda_fit(spark, sf):
    """Config A (alpha 0.1 optimised, beta 0.05): topic summary table."""
    s, m = _fit(spark, sf)
    return _summary(s, m)


@register("lda_fit_b")
def q_lda_fit_b(spark, sf):
    """Config B (sum alpha = 5, beta 0.01), label = first top word."""
    s, m = _fit(spark, sf, lda.LdaConfig(k=K, max_iter=ITER, alpha=None, beta=0.01, optimize_alpha=False))
    return _summary(s, m)


@register("lda_phi")
def q_lda_phi(spark, sf):
    return round_doubles(_fit(spark, sf)[1].phi())


@register("lda_theta")
def q_lda_theta(spark, sf):
    return round_doubles(_fit(spark, sf)[1].theta())


@register("lda_quality")
def q_lda_quality(spark, sf):
    return _fit(spark, sf)[1].quality()


@register("lda_score")
def q_lda_score(spark, sf):
    """Fit on the train split, re-infer theta for the held-out documents."""
    s = Study(spark, sf)
    sp = clean.train_test_split(s.docs, "doc_id", 0.8, 1234)
    train = sp.where(F.col("split") == "train").drop("split")
    test = sp.where(F.col("split") == "test").drop("split")
    blocks = s.packed.of(train)
    m = lda.fit(None, lda.LdaConfig(k=K, max_iter=ITER), train, blocks=blocks, totals=term_totals(blocks, s.kept_totals))
    return round_doubles(m.theta(docs=test, blocks=s.packed.of(test)))


@register("lda_score_new_docs")
def q_lda_score_new_docs(spark, sf):
    """Score unseen texts (conversation turns) against the frozen vocabulary and topics."""
    s, m = _fit(spark, sf)
    conv = spread(read_table(spark, sf, "conversations"))
    conv = conv.select((F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"), "text")
    return round_doubles(m.theta(terms.dtm_long(conv, s.spec), conv))


EM_K, EM_ROUNDS, EM_DOC_ROUNDS, EM_ALPHA, EM_BETA, EM_SEED = 4, 2, 3, 0.1, 0.05, 7


def _doc_rounds_sql(phi: str, labels: str, k: str, alpha: float, rounds: int, tag: str) -> str:
    """CTEs {tag}t0..: theta (doc_id, topic, w) of each document round against a table (topic, term, phi)."""
    out = [f"{tag}n AS MATERIALIZED (SELECT doc_id, sum(n) AS n FROM dtm WHERE term IN (SELECT term FROM {phi}) GROUP BY doc_id)",
           f"{tag}t0 AS (SELECT doc_id, topic, 1.0 / {k} AS w FROM {tag}n CROSS JOIN {labels})"]
    for i in range(1, rounds + 1):
        out.append(f"""{tag}t{i} AS MATERIALIZED (
  SELECT t.doc_id, t.topic, (coalesce(m, 0) + {alpha}) / (d.n + {k} * {alpha}) AS w FROM {tag}t0 t JOIN {tag}n d USING (doc_id) LEFT JOIN (
    SELECT doc_id, topic, sum(n * x / s) AS m FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id, term) AS s FROM (
      SELECT d.doc_id, d.term, p.topic, d.n, t.w * p.phi AS x FROM dtm d JOIN {phi} p USING (term) JOIN {tag}t{i - 1} t ON t.doc_id = d.doc_id AND t.topic = p.topic))
    WHERE s > 0 GROUP BY 1, 2) r ON r.doc_id = t.doc_id AND r.topic = t.topic)""")
    return ",\n".join(out)


def _em_sql() -> str:
    u = "-ln((('0x' || substr(md5('%d:' || term || ':' || topic), 1, 8))::BIGINT::DOUBLE + 1) / 4294967296.0) + 1e-3" % EM_SEED
    parts = [f"ks AS (SELECT unnest(range(1, {EM_K + 1}))::INTEGER AS topic)",
             "vt AS MATERIALIZED (SELECT term, sum(n)::DOUBLE AS tf FROM dtm GROUP BY term)",
             f"""c0 AS MATERIALIZED (SELECT topic, term, tf * u / sum(u) OVER (PARTITION BY term) AS c FROM (SELECT topic, term, tf, {u} AS u FROM vt CROSS JOIN ks))"""]
    for i in range(EM_ROUNDS + 1):
        parts.append(f"""p{i} AS MATERIALIZED (SELECT topic, term, (c + {EM_BETA}) / (sum(c) OVER (PARTITION BY topic) + (SELECT count(*) FROM vt) * {EM_BETA}) AS phi FROM c{i})""")
        if i == EM_ROUNDS:
            break
        parts.append(_doc_rounds_sql(f"p{i}", "ks", str(EM_K), EM_ALPHA, EM_DOC_ROUNDS, f"e{i}"))
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT topic, term, sum(n * x / s) AS c FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id, term) AS s FROM (
      SELECT d.doc_id, d.term, p.topic, d.n, t.w * p.phi AS x FROM dtm d JOIN p{i} p USING (term) JOIN e{i}t{EM_DOC_ROUNDS} t ON t.doc_id = d.doc_id AND t.topic = p.topic))
    GROUP BY 1, 2)""")
    # the study's tables are read in every round: kept once
    base = re.sub(r"(?m)^(dtm|phi|dtm_full|totals_full|kept) AS \(", r"\1 AS MATERIALIZED (", base_ctes())
    return f"WITH {base},\n" + ",\n".join(parts) + f"\nSELECT topic, term, round(phi, 6) AS phi FROM p{EM_ROUNDS}"


@register("lda_em_fixed", _em_sql())
def q_lda_em_fixed(spark, sf):
    """phi after the first rounds of a fit."""
    cfg = lda.LdaConfig(k=EM_K, max_iter=EM_ROUNDS, alpha=EM_ALPHA, beta=EM_BETA, optimize_alpha=False, seed=EM_SEED, doc_rounds=EM_DOC_ROUNDS)
    s = Study(spark, sf)
    return round_doubles(lda.fit(None, cfg, blocks=s.packed, totals=s.kept_totals).phi())


def _fold_in_sql() -> str:
    base = re.sub(r"(?m)^(dtm|phi|dtm_full|totals_full|kept) AS \(", r"\1 AS MATERIALIZED (", base_ctes())
    return (f"WITH {base},\nnk AS (SELECT count(*) AS k FROM topics),\n" + _doc_rounds_sql("phi", "topics", "(SELECT k FROM nk)", EM_ALPHA, EM_DOC_ROUNDS, "f") +
            f"""
SELECT d.doc_id, t.topic, round(coalesce(w, 1.0 / (SELECT k FROM nk)), 6) AS weight
FROM docs d CROSS JOIN topics t LEFT JOIN ft{EM_DOC_ROUNDS} f ON f.doc_id = d.doc_id AND f.topic = t.topic""")


@register("lda_score_fixed", _fold_in_sql())
def q_lda_score_fixed(spark, sf):
    """Fold-in of every document against the study's fixed topics."""
    s = Study(spark, sf)
    return round_doubles(lda.fold_in(None, s.phi, EM_ALPHA, EM_DOC_ROUNDS, s.docs, blocks=s.packed))


# ------------------------------------------------------------ embedding topics

N_CLUSTERS = 10


def _embedding_model(spark, sf):
    e = read_table(spark, sf, "embeddings")
    vec = embed.vectors_from_array(e, "vec_id", "embedding")
    red = embed.reduce_dims(vec, 5)
    assigned = embed.cluster(red, N_CLUSTERS, 1234)
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang").join(assigned, "doc_id")
    docs = spread(docs)
    ct = C.class_term_counts(docs, SPEC)
    scores = C.ctfidf(ct)
    return vec, red, assigned, docs, ct, scores


EV_SQL = "ev AS MATERIALIZED (SELECT vec_id AS doc_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _given_vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@register("doc_vectors", "WITH " + re.sub(r"(?m)^(dtm|dtm_full|totals_full|kept) AS \(", r"\1 AS MATERIALIZED (", base_ctes()) + f""",
{EV_SQL},
wv AS MATERIALIZED (SELECT term, i, avg(x) AS x FROM dtm JOIN ev USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, (i - 1)::INTEGER AS dim, round(sum(n * x) / sum(n), 6) AS value FROM dtm JOIN wv USING (term) GROUP BY 1, 2""")
def q_doc_vectors(spark, sf):
    """Vectors of all documents from their words, a word's being the mean of the given vectors of its documents."""
    s, given = Study(spark, sf), _given_vectors(spark, sf)
    dims, dtm = embed.dimensions(given, "vector"), None
    if s.again is not None and not s.again.where("doc_id IS NOT NULL").isEmpty():      # an id's rows count by class: packed documents are one an id
        dtm = s.dtm
    # dealt out once for both steps
    blocks = block_grid(dtm, dims, embed.BLOCK_CELLS) if dtm is not None else regrid(s.packed, s.kept_totals.select("term"), dims, embed.BLOCK_CELLS)
    words = staged(embed.word_vectors(dtm, given, blocks=blocks), "word-vectors")
    out = embed.document_vectors(dtm, words, blocks=blocks)
    return out.select("doc_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))


@register("reduce_dims")
def q_reduce_dims(spark, sf):
    from pyspark.ml.functions import vector_to_array
    red = embed.reduce_dims(embed.vectors_from_array(read_table(spark, sf, "embeddings"), "vec_id", "embedding"), 5)
    return red.select("doc_id", vector_to_array("reduced").alias("reduced"))


@register("cluster_topics")
def q_cluster_topics(spark, sf):
    return _embedding_model(spark, sf)[2]


@register("embed_topics")
def q_embed_topics(spark, sf):
    """Whole embedding pipeline: vectors -> reduce -> cluster -> c-TF-IDF -> summary."""
    *_, scores = _embedding_model(spark, sf)
    return C.summary_embed(C.top_words(scores, 10))


@register("document_info")
def q_document_info(spark, sf):
    vec, red, assigned, docs, ct, scores = _embedding_model(spark, sf)
    names = C.topic_info(C.topic_sizes(docs), C.top_words(scores, 10))
    return embed.document_info(assigned, names)


N_CANDIDATES, N_RERANKED, N_CENTRAL, DIVERSITY = 30, 10, 3, 0.3


def _rerank_inputs(spark, sf):
    """Candidate words of the class topics, their vectors, and the topics' vectors from central documents."""
    m = Model(spark, sf)
    vectors = _given_vectors(spark, sf)
    cands = staged(C.top_words(m.scores, N_CANDIDATES).select("topic", "term"), "candidates")
    dtm = terms.dtm_long(m.docs, SPEC).join(cands.select("term").distinct(), "term", "left_semi")
    words = staged(embed.word_vectors(dtm, vectors), "word-vectors")
    return cands, words, embed.topic_vectors(vectors, embed.central_docs(vectors, m.docs, N_CENTRAL))


RELEVANCE_SQL = base() + f""",
{EV_SQL},
cand AS MATERIALIZED (SELECT topic, term FROM sc QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) <= {N_CANDIDATES}),
dt AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(t) AS term FROM ctoks) WHERE term IN (SELECT term FROM cand)),
wv AS MATERIALIZED (SELECT term, i, avg(x) AS x FROM dt JOIN ev USING (doc_id) GROUP BY 1, 2),
cm AS (SELECT topic, i, avg(x) AS x FROM ev JOIN cd USING (doc_id) GROUP BY 1, 2),
near AS (SELECT cd.topic, ev.doc_id, sum(ev.x * cm.x) / sqrt(sum(ev.x * ev.x)) / sqrt(sum(cm.x * cm.x)) AS s
         FROM ev JOIN cd USING (doc_id) JOIN cm ON cm.topic = cd.topic AND cm.i = ev.i GROUP BY 1, 2),
rep AS (SELECT topic, doc_id FROM near WHERE topic <> -1 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY s DESC, doc_id) <= {N_CENTRAL}),
tv AS (SELECT topic, i, avg(x) AS x FROM rep JOIN ev USING (doc_id) GROUP BY 1, 2),
rel AS MATERIALIZED (SELECT cand.topic, term, round(sum(wv.x * tv.x) / sqrt(sum(wv.x * wv.x)) / sqrt(sum(tv.x * tv.x)), 9) AS rel
        FROM cand JOIN wv USING (term) JOIN tv ON tv.topic = cand.topic AND tv.i = wv.i GROUP BY 1, 2)"""


@register("rerank_terms", RELEVANCE_SQL + f"""
SELECT topic, term, round(rel, 6) AS similarity, (row_number() OVER (PARTITION BY topic ORDER BY rel DESC, term))::INTEGER AS rank
FROM rel QUALIFY rank <= {N_RERANKED}""")
def q_rerank_terms(spark, sf):
    return round_doubles(embed.rerank(*_rerank_inputs(spark, sf), N_RERANKED))


def _mmr_sql() -> str:
    steps = ["""
m1 AS (SELECT topic, term, rel, 1 AS rank FROM rel QUALIFY row_number() OVER (PARTITION BY topic ORDER BY rel DESC, term) = 1)"""]
    for i in range(2, N_RERANKED + 1):
        steps.append(f"""
m{i} AS MATERIALIZED (SELECT * FROM m{i - 1} UNION ALL SELECT topic, term, rel, {i} AS rank FROM (
  SELECT r.topic, r.term, r.rel, round({1 - DIVERSITY}::DOUBLE * r.rel - {DIVERSITY}::DOUBLE * max(p.s), 9) AS score
  FROM rel r JOIN m{i - 1} c ON c.topic = r.topic JOIN pair p ON p.a = r.term AND p.b = c.term
  WHERE (r.topic, r.term) NOT IN (SELECT (topic, term) FROM m{i - 1}) GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, rel DESC, term) = 1)""")
    return RELEVANCE_SQL + """,
couple AS (SELECT DISTINCT x.term AS a, y.term AS b FROM rel x JOIN rel y ON x.topic = y.topic),
pair AS MATERIALIZED (SELECT a, b, round(sum(u.x * v.x) / sqrt(sum(u.x * u.x)) / sqrt(sum(v.x * v.x)), 9) AS s
         FROM couple JOIN wv u ON u.term = a JOIN wv v ON v.term = b AND v.i = u.i GROUP BY 1, 2),""" + ",".join(steps) + f"""
SELECT topic, rank::INTEGER AS rank, term, round(rel, 6) AS relevance FROM m{N_RERANKED}"""


@register("mmr_terms", _mmr_sql())
def q_mmr_terms(spark, sf):
    return round_doubles(embed.mmr(*_rerank_inputs(spark, sf), N_RERANKED, DIVERSITY))


# ------------------------------------------------------------ model-based tests

IRLS_ROUNDS = 14


def _binomial_sql() -> str:
    """Newton steps for all topics, unrolled; one more set of sums gives the standard error."""
    parts = ["""zr AS MATERIALIZED (SELECT t.topic, coalesce((t.weight - avg(t.weight) OVER w) / nullif(stddev_samp(t.weight) OVER w, 0), 0) AS x, l.quality::DOUBLE AS y
  FROM theta t JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL WINDOW w AS (PARTITION BY t.topic))""",
             "b0 AS (SELECT DISTINCT topic, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS se FROM zr)"]
    for i in range(1, IRLS_ROUNDS + 1):
        parts.append(f"""b{i} AS MATERIALIZED (SELECT topic, b0 + (h11 * g0 - h01 * g1) / det AS b0, b1 + (h00 * g1 - h01 * g0) / det AS b1, sqrt(h00 / det) AS se
  FROM (SELECT *, h00 * h11 - h01 * h01 AS det FROM (SELECT topic, b0, b1, sum(y - mu) AS g0, sum((y - mu) * x) AS g1, sum(mu * (1 - mu)) AS h00,
    sum(mu * (1 - mu) * x) AS h01, sum(mu * (1 - mu) * x * x) AS h11
    FROM (SELECT zr.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS mu FROM zr JOIN b{i - 1} USING (topic)) GROUP BY topic, b0, b1)))""")
    t = "(1 / (1 + 0.5 * v))"
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + {c})"
    return with_base(", " + ",\n".join(parts) + f""",
pv AS (SELECT topic, b1 AS estimate, z AS z_value, {t} * exp(-v * v + {poly}) AS p_value
       FROM (SELECT topic, b1, b1 / se AS z, abs(b1 / se) / sqrt(2.0::DOUBLE) AS v FROM b{IRLS_ROUNDS}))
SELECT topic, round(estimate, 6) AS estimate, round(z_value, 6) AS z_value, round(p_value, 6) AS p_value, round(least(1, min(q) OVER (ORDER BY p_value DESC, topic)), 6) AS p_adjusted
FROM (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, topic) AS q FROM pv)""")


@register("logistic_binomial", _binomial_sql())
def q_logistic_binomial(spark, sf):
    s = Study(spark, sf)
    return round_doubles(stats.logistic_binomial(s.loadings_with(["quality"]), "quality"))


@register("cv_regression")
def q_cv_regression(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from topicscope.sources import sinks
    s = Study(spark, sf)
    wide = sinks.theta_wide(s.theta).join(s.docs.select("doc_id", F.col("n_chars").cast("double").alias("y")), "doc_id")
    cols = [c for c in wide.columns if c.startswith("t_")]
    feats = VectorAssembler(inputCols=cols, outputCol="features").transform(wide).select("doc_id", "features", "y")
    return round_doubles(stats.cv_regression(feats, "y"))
