"""User-facing workflow: the original study's entry points as Spark functions.

    bundle  = get_dtm(spark, "data.csv", id_col="id", data_col="text", group_var="g", ...)
    fitted  = get_lda_model(bundle, num_topics=20)
    preds   = get_lda_preds(fitted, bundle, outcomes=["g"])
    results = topic_test(preds, "g", fitted.summary, test_method="t-test")
    cloud   = plot_wordclouds(fitted.summary, fitted.phi, results)

Everything returned is a DataFrame (long form, keyed by document id and topic);
stages can be saved and reloaded as parquet under <save_dir>/seed_<seed>/.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicscope.functions import text as tx
from topicscope.functions.stopwords import SNOWBALL_EN
from topicscope.operators import clean, cloud, ctfidf, embed, lda, stats, terms, topics, vocab
from topicscope.sources import sinks
from topicscope.sources.tables import scan_corpus, spread
from topicscope.staging import staged

#: The interface's names.
TEST_METHODS = ("correlation", "t-test", "linear_regression", "logistic_regression", "textTrain_regression")
SPLITS = ("median", "quartile", "min_max")


@dataclass
class DtmBundle:
    train_dtm: DataFrame
    test_dtm: DataFrame
    train_data: DataFrame
    test_data: DataFrame
    split_stats: DataFrame | None
    spec: terms.DtmSpec
    id_col: str = "doc_id"


def hash_words(words) -> str:
    return hashlib.sha256("\n".join(sorted(words)).encode()).hexdigest()[:16]


def _trim(dtm: DataFrame, n_docs, occ_rate, mode, most, least) -> DataFrame:
    tot = vocab.keep_by_occurrence(terms.term_totals(dtm), n_docs, occ_rate)
    if mode == "threshold":
        kept = vocab.keep_by_threshold(tot, least, most)
    else:
        kept = vocab.keep_by_rank(vocab.rank_terms(tot), least=least or 0, most=most or 0, mode=mode)
    return vocab.restrict(dtm, kept)


def get_dtm(spark: SparkSession, data, id_col: str, data_col: str, group_var: str | None = None,
            ngram_window=(1, 3), stopwords=SNOWBALL_EN, removal_word: str = "", occ_rate: float = 0.0,
            removal_mode: str = "absolute", removal_rate_most: float = 1, removal_rate_least: float = 0,
            split: float = 1.0, seed: int = 1234, save_dir: str | None = None,
            independent_test: bool = False, drop_incomplete: bool = True, fmt: str = "csv", load_dir: str | None = None) -> DtmBundle:
    """Read, clean, split and vectorise a corpus; trim the training vocabulary.

    The test table is restricted to the training vocabulary (a model can only
    score known terms); ``independent_test=True`` instead gives it its own
    vocabulary and trimming with the English Snowball list, as the original did.
    ``load_dir``: read the tables saved there instead, if they were made with
    these parameters from this corpus.
    """
    if removal_mode not in ("absolute", "percent", "threshold"):
        raise ValueError("removal_mode must be 'absolute', 'percent' or 'threshold'")
    df = data if isinstance(data, DataFrame) else scan_corpus(spark, data, fmt)
    df = spread(clean.complete_cases(df) if drop_incomplete else df)
    if removal_word:
        df = df.withColumn(data_col, tx.remove_word(data_col, removal_word))
    df = clean.train_test_split(df, id_col, split, seed)
    train = df.where(F.col("split") == "train") if split < 1 else df
    test = df.where(F.col("split") == "test") if split < 1 else df
    spec = terms.DtmSpec(id_col=id_col, text_col=data_col, ngram=tuple(ngram_window), stopwords=tuple(stopwords))
    split_stats = clean.split_stats(df, group_var) if group_var else None
    params = None
    if save_dir or load_dir:
        params = dict(ngram=list(ngram_window), stopwords=hash_words(stopwords), occ_rate=occ_rate, mode=removal_mode, most=removal_rate_most,
                      least=removal_rate_least, split=split, independent_test=independent_test, corpus=sinks.signature(df.select(id_col, data_col)))
    if load_dir:
        saved = [sinks.load_stage(spark, load_dir, seed, f"dtms/{name}", params) for name in ("train_dtm", "test_dtm")]
        return DtmBundle(*saved, train.drop("split"), test.drop("split"), split_stats, spec, id_col)
    n_train = train.select(F.count(F.lit(1))).scalar()
    train_dtm = _trim(terms.dtm_long(train, spec), n_train, occ_rate, removal_mode, removal_rate_most, removal_rate_least)
    if independent_test:
        tspec = terms.DtmSpec(id_col=id_col, text_col=data_col, ngram=tuple(ngram_window), stopwords=SNOWBALL_EN)
        n_test = test.select(F.count(F.lit(1))).scalar()
        test_dtm = _trim(terms.dtm_long(test, tspec), n_test, occ_rate, removal_mode, removal_rate_most, removal_rate_least)
    else:
        test_dtm = vocab.restrict(terms.dtm_long(test, spec), train_dtm.select("term").distinct())
    bundle = DtmBundle(train_dtm, test_dtm, train.drop("split"), test.drop("split"), split_stats, spec, id_col)
    if save_dir:
        for name in ("train_dtm", "test_dtm"):
            sinks.save_stage(getattr(bundle, name), save_dir, seed, f"dtms/{name}", params=params)
    return bundle


@dataclass
class TopicModel:
    fitted: lda.FittedLda | None
    phi: DataFrame
    summary: DataFrame
    extra: dict = field(default_factory=dict)


def get_lda_model(bundle: DtmBundle, model_type: str = "A", num_topics: int = 20, num_top_words: int = 10,
                  num_iterations: int = 100, seed: int = 1234, save_dir: str | None = None, load_dir: str | None = None) -> TopicModel:
    """Fit LDA (A: alpha 0.1 optimised, beta 0.05, labels from assignments;
    B: sum alpha 5, beta 0.01, label = first top word) and summarise it.

    ``load_dir``: read the model saved there instead, if it was fitted with these
    parameters on these documents.
    """
    if model_type == "A":
        cfg = lda.LdaConfig(k=num_topics, max_iter=num_iterations, seed=seed)
    elif model_type == "B":
        cfg = lda.LdaConfig(k=num_topics, max_iter=num_iterations, seed=seed, alpha=None, beta=0.01, optimize_alpha=False)
    else:
        raise ValueError("model_type must be 'A' or 'B'")
    params = None
    if save_dir or load_dir:
        params = dict(model_type=model_type, num_topics=num_topics, num_top_words=num_top_words, num_iterations=num_iterations,
                      dtm=sinks.signature(bundle.train_dtm.select(bundle.id_col, "term", "n")))
    if load_dir:
        spark = bundle.train_dtm.sparkSession
        summary = sinks.load_stage(spark, load_dir, seed, "summary", params)
        m = lda.load(spark, sinks.stage_path(load_dir, seed, "model"))
        return TopicModel(m, m.phi(), summary)
    m = lda.fit(bundle.train_dtm, cfg, bundle.train_data, bundle.id_col)
    top = m.top_terms(num_top_words)
    theta = m.theta()
    n_docs = bundle.train_data.select(F.count(F.lit(1))).scalar()
    coh = topics.coherence(bundle.train_dtm, top, n_docs, bundle.id_col, num_top_words)
    labels = topics.labels_by_assignment(bundle.train_dtm, theta, 0.05, bundle.spec.sep, bundle.id_col) \
        if model_type == "A" else None
    summary = topics.summary(top, topics.prevalence(theta), coh, labels)
    if save_dir:
        m.save(sinks.stage_path(save_dir, seed, "model"))
        sinks.save_stage(summary, save_dir, seed, "summary", params=params)
    return TopicModel(m, m.phi(), summary)


PRED_MODES = ("function", "custom", "mallet")   # fixed values: the interface's names


def get_lda_preds(model: TopicModel, bundle: DtmBundle, outcomes: list[str] | None = None,
                  pred_mode: str = "function", use_test: bool = True, num_iterations: int = 200, seed: int = 1234,
                  save_dir: str | None = None, load_dir: str | None = None) -> DataFrame:
    """Document-topic loadings (doc, topic, weight) joined with outcome columns.

    function: fold-in with the fitted model's topics and priors; custom: theta =
    sum_w relative frequency(d, w) * phi(t, w), unnormalised; mallet: inference
    against the frozen topics alone (alpha 5 / k, ``num_iterations`` rounds a
    document).  ``load_dir``: read the loadings saved there instead, if mode,
    outcomes and documents are these.
    """
    if pred_mode not in PRED_MODES:
        raise ValueError(f"pred_mode must be one of {PRED_MODES}")
    docs = bundle.test_data if use_test else bundle.train_data
    dtm = bundle.test_dtm if use_test else bundle.train_dtm
    params = None
    if save_dir or load_dir:
        params = dict(pred_mode=pred_mode, outcomes=outcomes, use_test=use_test, num_iterations=num_iterations if pred_mode == "mallet" else None,
                      dtm=sinks.signature(dtm.select(bundle.id_col, "term", "n")))
    if load_dir:
        return sinks.load_stage(dtm.sparkSession, load_dir, seed, "preds", params)
    if pred_mode == "function":
        theta = model.fitted.theta(dtm, docs)
    elif pred_mode == "custom":
        theta = topics.project(vocab.relative_frequency(dtm, terms.term_totals(dtm), bundle.id_col), model.phi, bundle.id_col)
    else:
        k = model.summary.count()
        theta = lda.fold_in(dtm, model.phi, 5.0 / k, num_iterations, docs, bundle.id_col)
    if outcomes:
        theta = stats.attach_outcomes(theta, docs, outcomes, bundle.id_col, complete=False)
    if save_dir:
        sinks.save_stage(theta, save_dir, seed, "preds", params=params)
        return sinks.load_stage(theta.sparkSession, save_dir, seed, "preds")
    return theta


def split_groups(loadings: DataFrame, variable: str, split: str, n_min_max: int, id_col: str) -> DataFrame:
    """Loadings with the documents' groups by a continuous variable in ``split_group``; min_max keeps its documents only."""
    docs = loadings.select(id_col, variable).dropDuplicates([id_col])
    if split == "median":
        groups = stats.median_split(docs, variable)
    elif split == "quartile":
        groups = stats.quartile_split(docs, variable)
    else:
        groups = stats.min_max_split(docs, variable, n_min_max, id_col)
    return loadings.join(groups.select(id_col, "split_group"), id_col)


def topic_test(loadings: DataFrame, grouping_variable: str, summary: DataFrame, control_vars: list[str] | None = None,
               test_method: str = "correlation", split: str = "median", n_min_max: int = 20,
               multiple_comparison: str = "bonferroni", id_col: str = "doc_id", compat: bool = False,
               save_dir: str | None = None, load_dir: str | None = None, seed: int = 1234) -> DataFrame:
    """Test every topic against an outcome; results joined with the topic summary.

    A t-test on a variable with more than 50 values compares the groups that
    ``split`` makes of it (median, quartile, or the ``n_min_max`` lowest and
    highest documents), otherwise its values.  compat: each correlation's p is
    adjusted alone for a family of topics + 1, as the original does.  ``load_dir``:
    read the results saved there, if they are of the same test of the same loadings.
    """
    if test_method not in TEST_METHODS:
        raise ValueError(f"test_method must be one of {TEST_METHODS}")
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    params = None
    if save_dir or load_dir:
        params = dict(variable=grouping_variable, controls=control_vars, method=test_method, split=split, n_min_max=n_min_max, adjust=multiple_comparison,
                      compat=compat, loadings=sinks.signature(loadings.select(id_col, "topic", F.round("weight", 9).alias("weight"))))
    if load_dir:
        return sinks.load_stage(loadings.sparkSession, load_dir, seed, "test", params)
    out = _topic_test(loadings, grouping_variable, summary, control_vars, test_method, split, n_min_max, multiple_comparison, id_col, compat)
    if save_dir:
        sinks.save_stage(out, save_dir, seed, "test", params=params)
    return out


def _topic_test(loadings, variable, summary, controls, method, split, n_min_max, adjust, id_col, compat) -> DataFrame:
    lo = loadings.dropna("any", subset=["weight", variable])
    if method == "correlation":
        family = lo.select(F.count_distinct("topic") + 1).scalar() if compat else None
        return stats.sort_stats(stats.join_summary(stats.correlation_test(lo, variable, adjust, family), summary, "left"))
    if method == "t-test":
        group = variable
        if stats.is_continuous(lo, variable).first().is_continuous:
            lo, group = split_groups(lo, variable, split, n_min_max, id_col), "split_group"
        # a few rows with long expressions: written, so that filters and joins on them do not repeat the expressions
        return stats.sort_stats(stats.join_summary(staged(stats.welch_ttest(lo, group, adjust, compat=True), "t-tests"), summary, "left"))
    if method == "linear_regression":
        res = stats.linear_regression(lo, controls or [variable], adjust, id_col)
        return stats.join_summary(res, summary.select("topic", "top_terms"), "left")
    if method == "logistic_regression":
        res = stats.logistic_regression_compat(lo, (controls or [variable])[0], adjust, id_col)
        return stats.join_summary(res, summary.select("topic", "top_terms"), "left")
    from pyspark.ml.feature import VectorAssembler
    wide = sinks.theta_wide(lo, id_col=id_col, name="Dim{}_texts").join(lo.select(id_col, variable).dropDuplicates([id_col]), id_col)
    cols = [c for c in wide.columns if c.startswith("Dim")]
    feats = VectorAssembler(inputCols=cols, outputCol="features").transform(wide)
    return stats.cv_regression(feats.withColumn(variable, F.col(variable).try_cast("double")), variable, id_col=id_col)


def get_topic_test(spark: SparkSession, data, id_col: str, data_col: str, diagnose: str, model_type: str = "A", num_topics: int = 20,
                   num_top_words: int = 10, num_iterations: int = 100, seed: int = 1234, fmt: str = "csv",
                   save_dir: str | None = None) -> tuple[TopicModel, DataFrame]:
    """One-shot study: complete rows -> 1-3 grams with total > 2 -> LDA -> loadings -> Welch tests of ``diagnose``, fdr-adjusted."""
    bundle = get_dtm(spark, data, id_col, data_col, group_var=None, ngram_window=(1, 3), removal_mode="threshold", removal_rate_least=2,
                     removal_rate_most=None, seed=seed, fmt=fmt, save_dir=save_dir)
    model = get_lda_model(bundle, model_type, num_topics, num_top_words, num_iterations, seed, save_dir)
    preds = get_lda_preds(model, bundle, [diagnose], use_test=False, seed=seed, save_dir=save_dir)
    return model, topic_test(preds, diagnose, model.summary, test_method="t-test", multiple_comparison="fdr", id_col=id_col, save_dir=save_dir, seed=seed)


def plot_wordclouds(summary: DataFrame, phi: DataFrame, results: DataFrame, p_threshold: float | None = None,
                    scale_size: bool = True, plot_topics_idx: list[int] | None = None) -> DataFrame:
    """The word-cloud table of any test's results (rendering images is left to the caller)."""
    words = cloud.assign_phi(cloud.explode_top_terms(summary), phi)
    return cloud.wordcloud_table(words, results, summary, p_threshold, scale_size, plot_topics_idx)


def sweep(spark: SparkSession, runs: dict, build) -> dict:
    """Parameter sweep: one independent Spark job per configuration, keyed by run name."""
    return {key: build(spark, **params) for key, params in runs.items()}


@dataclass
class EmbeddingTopics:
    assigned: DataFrame       # (doc_id, topic, distance)
    scores: DataFrame         # (topic, term, tf, score)
    top: DataFrame            # (topic, rank, term, score)
    summary: DataFrame
    info: DataFrame


REPRESENTATIONS = ("scores", "default", "mmr")   # c-TF-IDF alone, re-ranked by similarity, maximal marginal relevance


def create_embedding_topics(docs: DataFrame, vectors: DataFrame, data_var: str, id_col: str = "doc_id", num_topics: int = 10, reduced_dims: int = 5,
                            top_n_words: int = 10, n_gram_range=(1, 1), min_df: int = 1, stop_words=SNOWBALL_EN, bm25_weighting: bool = False,
                            reduce_frequent_words: bool = False, representation: str = "scores", diversity: float = 0.3, min_cluster_size: int = 5,
                            seed: int = 1234, save_dir: str | None = None) -> EmbeddingTopics:
    """Embedding topics: reduce the documents' vectors (id, vector), cluster them, describe the clusters by c-TF-IDF words.

    ``min_df``: clusters that must hold a term.  ``representation``: which words
    describe a topic; the two others choose among its 30 best.
    """
    if representation not in REPRESENTATIONS:
        raise ValueError(f"representation must be one of {REPRESENTATIONS}")
    red = embed.reduce_dims(embed.vectors_from_array(vectors, id_col, "vector"), reduced_dims)
    assigned = staged(embed.cluster(red, num_topics, seed, min_cluster_size), "clusters")
    spec = terms.DtmSpec(id_col="doc_id", text_col="text", ngram=tuple(n_gram_range), stopwords=tuple(stop_words), sep=" ", min_token_len=2)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(data_var).alias("text")).join(assigned.select("doc_id", "topic"), "doc_id")
    ct = staged(ctfidf.class_term_counts(texts, spec), "class-terms")
    if min_df > 1:
        ct = ct.join(ctfidf.min_class_freq(ct, min_df).select("term"), "term", "left_semi").select("topic", "term", "tf")
    scores = ctfidf.ctfidf(ct, bm25_weighting, reduce_frequent_words)
    if representation == "scores":
        top = ctfidf.top_words(scores, top_n_words)
    else:
        cands = staged(ctfidf.top_words(scores, 3 * top_n_words).where(F.col("topic") != ctfidf.OUTLIER).select("topic", "term"), "candidates")
        dtm = terms.dtm_long(texts, spec).join(cands.select("term").distinct(), "term", "left_semi")
        given = vectors.select(F.col(id_col).alias("doc_id"), "vector")
        words = staged(embed.word_vectors(dtm, given), "word-vectors")
        tvecs = embed.topic_vectors(given, embed.representative_docs(assigned))
        top = embed.rerank(cands, words, tvecs, top_n_words).withColumnRenamed("similarity", "score") if representation == "default" \
            else embed.mmr(cands, words, tvecs, top_n_words, diversity).withColumnRenamed("relevance", "score")
        top = top.select("topic", "rank", "term", "score")
    out = EmbeddingTopics(assigned, scores, top, ctfidf.summary_embed(top), ctfidf.topic_info(ctfidf.topic_sizes(texts), top))
    if save_dir:
        for name in ("assigned", "top", "summary"):
            sinks.save_stage(getattr(out, name), save_dir, seed, f"embedding/{name}")
    return out


def sweep_embedding_topics(docs: DataFrame, encoders: dict[str, DataFrame], data_vars: list[str], **kw) -> DataFrame:
    """(run, encoder, data_var, topic_name, words): topics of every vector source x text column, keyed by run ``<encoder>/<column>``."""
    out = None
    for encoder, vectors in encoders.items():
        for column in data_vars:
            one = create_embedding_topics(docs, vectors, column, **kw).summary
            one = one.select(F.lit(f"{encoder}/{column}").alias("run"), F.lit(encoder).alias("encoder"), F.lit(column).alias("data_var"), "topic_name", "words")
            out = one if out is None else out.unionByName(one)
    return out
