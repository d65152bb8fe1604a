"""Registered queries: scans, cleaning, tokens, document-term table, vocabulary
(S1, P1-P11, D1-D12, V1-V13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicscope.functions import text as tx
from topicscope.functions.stopwords import SNOWBALL_EN, get_stopwords
from topicscope.operators import clean, terms, vocab
from topicscope.plans.oracle import ngrams_sql, rounded, sql_list, tokens_sql, with_base
from topicscope.plans.registry import r6, register, round_doubles
from topicscope.plans.study import Study
from topicscope.sources.tables import documents, read_table, scan_corpus, spread, table_path

# Fixed parameters of the registered queries.
SEED = 1234
SPLIT = 0.8
REMOVE = "le"
NGRAM_STOP = ("t_ex", "https_www", "de_la", "et_le")
RECODE = {"user": "1", "assistant": "2", "system": "3"}


def conv_docs(spark, sf):
    """Conversation turns as documents keyed by (conv_id, turn)."""
    return spread(read_table(spark, sf, "conversations"))


# ---------------------------------------------------------------- scans / rows

@register("scan_corpus", "SELECT doc_id, lang, source, n_chars, length(text)::BIGINT AS text_chars FROM documents")
def q_scan_corpus(spark, sf):
    df = scan_corpus(spark, table_path(sf, "documents"))
    return df.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("text_chars"))


@register("select_columns", "SELECT conv_id, turn, role FROM conversations")
def q_select_columns(spark, sf):
    return clean.select_columns(read_table(spark, sf, "conversations"), ["conv_id", "turn", "role"])


@register("complete_cases", """
SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL
  AND quality IS NOT NULL AND toxic IS NOT NULL""")
def q_complete_cases(spark, sf):
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return clean.complete_cases(d).select("doc_id", "lang", "quality", "toxic")


@register("strip_digits", r"""
SELECT doc_id, md5(regexp_replace(text, '\p{Nd}', '', 'g')) AS text_md5,
       length(regexp_replace(text, '\p{Nd}', '', 'g'))::BIGINT AS n_chars_clean FROM documents""")
def q_strip_digits(spark, sf):
    d = spread(read_table(spark, sf, "documents")).select("doc_id", tx.strip_digits("text").alias("t"))
    return d.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars_clean"))


_W = r"[^\p{L}\p{N}\p{M}_]"
_RM = f"regexp_replace(text, '(^|{_W}){REMOVE}({_W}|$)', '\\1\\2', 'g')"
_RM2 = _RM.replace("text", _RM, 1)


@register("remove_word", f"SELECT doc_id, md5({_RM2}) AS text_md5 FROM documents")
def q_remove_word(spark, sf):
    d = spread(read_table(spark, sf, "documents"))
    return d.select("doc_id", F.md5(tx.remove_word("text", REMOVE)).alias("text_md5"))


SPLIT_SQL = f"CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 8))::BIGINT < {SPLIT} * 4294967296 THEN 'train' ELSE 'test' END"


@register("train_test_split", f"SELECT doc_id, {SPLIT_SQL} AS split FROM documents")
def q_train_test_split(spark, sf):
    return clean.train_test_split(read_table(spark, sf, "documents").select("doc_id"), "doc_id", SPLIT, SEED)


KEY_SQL = f"('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 8))::BIGINT"


@register("train_test_split_exact", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {KEY_SQL}, doc_id) <= (SELECT round_even(count(*) * {SPLIT}, 0) FROM documents)
       THEN 'train' ELSE 'test' END AS split FROM documents""")
def q_train_test_split_exact(spark, sf):
    return clean.train_test_split_exact(read_table(spark, sf, "documents").select("doc_id"), "doc_id", SPLIT, SEED)


@register("split_stats", rounded(f"""
SELECT CASE WHEN split = 'train' THEN 'Training' ELSE 'Test' END AS set,
       count_if(quality = 0)::BIGINT AS count_0, count_if(quality = 1)::BIGINT AS count_1,
       count_if(quality = 0) / count(quality) AS ratio_0, count_if(quality = 1) / count(quality) AS ratio_1
FROM (SELECT doc_id, {SPLIT_SQL} AS split FROM documents) JOIN labels USING (doc_id) GROUP BY split""",
                                  ["ratio_0", "ratio_1"]))
def q_split_stats(spark, sf):
    d = clean.train_test_split(read_table(spark, sf, "documents").select("doc_id"), "doc_id", SPLIT, SEED)
    d = d.join(read_table(spark, sf, "labels"), "doc_id")
    return round_doubles(clean.split_stats(d, "quality"))


@register("recode_labels", """
SELECT conv_id, turn, TRY_CAST(CASE role WHEN 'user' THEN '1' WHEN 'assistant' THEN '2' WHEN 'system' THEN '3' ELSE role END AS DOUBLE) AS role_code
FROM conversations""")
def q_recode_labels(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", clean.recode("role", RECODE).alias("role_code"))


@register("hour_category", """
SELECT event_id, hour(ts)::INTEGER AS hour, CASE WHEN hour(ts) < 7 OR hour(ts) > 22 THEN 1 ELSE 2 END AS night FROM events""")
def q_hour_category(spark, sf):
    h, night = clean.hour_category("ts")
    return read_table(spark, sf, "events").select("event_id", h.alias("hour"), night.alias("night"))


@register("describe_outcome", rounded("""
SELECT avg(value) AS mean, min(value) AS min, max(value) AS max, count_if(value IS NULL)::BIGINT AS n_missing, count(*) AS n
FROM events""", ["mean", "min", "max"]))
def q_describe_outcome(spark, sf):
    return round_doubles(clean.describe(read_table(spark, sf, "events"), "value"))


@register("describe_frequency", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_describe_frequency(spark, sf):
    return clean.frequency(read_table(spark, sf, "events"), "event_type")


# ---------------------------------------------------------------- tokens

@register("tokenize", f"""
SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {tokens_sql(stop=False)} AS t FROM documents)""")
def q_tokenize(spark, sf):
    d = spread(read_table(spark, sf, "documents")).select("doc_id", tx.tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def _ngram_stop_spec():
    return terms.DtmSpec(ngram=(1, 2), stopwords=tuple(get_stopwords()) + NGRAM_STOP)


@register("stopwords_ngrams", f"""
WITH toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda x: x NOT IN ({sql_list(get_stopwords())})) AS t
              FROM documents),
g AS (SELECT doc_id, unnest({ngrams_sql('t', 1, 2)}) AS term FROM toks)
SELECT term, count(*)::BIGINT AS tf FROM g WHERE term NOT IN ({sql_list(NGRAM_STOP)}) GROUP BY term""")
def q_stopwords_ngrams(spark, sf):
    s = Study(spark, sf)
    return terms.explode_terms(s.docs, _ngram_stop_spec()).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


@register("ngrams", f"""
SELECT conv_id, turn, len(g)::INT AS n_grams, md5(array_to_string(g, '|')) AS grams_md5
FROM (SELECT conv_id, turn, {ngrams_sql(tokens_sql(), 1, 3)} AS g FROM conversations)""")
def q_ngrams(spark, sf):
    spec = terms.DtmSpec(ngram=(1, 3), stopwords=SNOWBALL_EN)
    g = conv_docs(spark, sf).select("conv_id", "turn", "text")
    g = terms.term_arrays(g.withColumnRenamed("conv_id", "_cid").select(
        F.struct("_cid", "turn").alias("doc_id"), "text"), spec)
    return g.select(F.col("doc_id._cid").alias("conv_id"), F.col("doc_id.turn").alias("turn"),
                    F.size("terms").alias("n_grams"), F.md5(F.array_join("terms", "|")).alias("grams_md5"))


@register("dtm_long", with_base("SELECT doc_id, term, n FROM dtm_full"))
def q_dtm_long(spark, sf):
    return Study(spark, sf).dtm_full


@register("dtm_test_split", with_base(f"""
, sp AS (SELECT doc_id, {SPLIT_SQL} AS split FROM docs),
tr_tot AS (SELECT term, sum(n) AS tf FROM dtm_full JOIN sp USING (doc_id) WHERE split = 'train' GROUP BY term),
tr_kept AS (SELECT term FROM tr_tot WHERE tf > 4)
SELECT doc_id, term, n FROM dtm_full JOIN sp USING (doc_id) WHERE split = 'test' AND term IN (SELECT term FROM tr_kept)"""))
def q_dtm_test_split(spark, sf):
    s = Study(spark, sf)
    sp = clean.train_test_split(s.docs.select("doc_id"), "doc_id", SPLIT, SEED)
    d = s.dtm_full.join(sp.hint("shuffle_hash"), "doc_id")   # the ids are the small side: no sort of the document-term rows
    train = d.where(F.col("split") == "train").drop("split")
    test = d.where(F.col("split") == "test").drop("split")
    kept = vocab.keep_by_threshold(terms.term_totals(train), 4, None)
    return vocab.restrict(test, kept)


@register("dtm_test_split_independent", with_base(f"""
, sp AS (SELECT doc_id, {SPLIT_SQL} AS split FROM docs),
te AS (SELECT dtm_full.* FROM dtm_full JOIN sp USING (doc_id) WHERE split = 'test'),
te_tot AS (SELECT term, sum(n) AS tf FROM te GROUP BY term)
SELECT doc_id, term, n FROM te WHERE term IN (SELECT term FROM te_tot WHERE tf > 4)"""))
def q_dtm_test_split_independent(spark, sf):
    """Original behaviour: the test table gets its own vocabulary and trimming
    (English Snowball stop words, same thresholds)."""
    s = Study(spark, sf)
    sp = clean.train_test_split(s.docs.select("doc_id"), "doc_id", SPLIT, SEED)
    test = s.dtm_full.join(sp.where(F.col("split") == "test").select("doc_id"), "doc_id", "left_semi")
    return vocab.restrict(test, vocab.keep_by_threshold(terms.term_totals(test), 4, None))


MIN_DF = 3


@register("count_vectorizer_min_df", f"""
WITH tok AS MATERIALIZED (SELECT doc_id, source AS label, {tokens_sql(min_len=2)} AS t FROM documents),
cls AS (SELECT doc_id, label, {ngrams_sql('t', 1, 3, ' ')} AS g FROM tok),
x AS (SELECT label, unnest(g) AS term FROM cls)
SELECT term, count(DISTINCT label) AS n_classes, count(*)::BIGINT AS tf FROM x GROUP BY term
HAVING count(DISTINCT label) >= {MIN_DF}""")
def q_count_vectorizer_min_df(spark, sf):
    from topicscope.operators import ctfidf
    docs = documents(spark, sf)
    spec = terms.DtmSpec(ngram=(1, 3), stopwords=SNOWBALL_EN, sep=" ", min_token_len=2)
    return ctfidf.min_class_freq(ctfidf.class_term_counts_from(docs, spec, "source", MIN_DF), MIN_DF)


@register("dtm_to_docs", with_base("""
SELECT doc_id, md5(string_agg(rtrim(repeat(term || ' ', n::INT)), ' ' ORDER BY term)) AS pseudo_md5,
       sum(n)::BIGINT AS n_tokens FROM dtm_full GROUP BY doc_id"""))
def q_dtm_to_docs(spark, sf):
    d = terms.dtm_to_docs(Study(spark, sf).dtm_full)
    n = Study(spark, sf).dtm_full.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))
    return d.join(n, "doc_id").select("doc_id", F.md5("pseudo_text").alias("pseudo_md5"), "n_tokens")


@register("tokenize_import", r"""
SELECT conv_id, turn, len(t)::INT AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5
FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[\p{P}]+ ') AS t FROM conversations)""")
def q_tokenize_import(spark, sf):
    c = conv_docs(spark, sf).select("conv_id", "turn", tx.import_tokens("text").alias("t"))
    return c.select("conv_id", "turn", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


@register("doc_length", r"""
SELECT conv_id, turn, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '\s+$', ''), '\s+')) END::INT AS doc_length
FROM conversations""")
def q_doc_length(spark, sf):
    return read_table(spark, sf, "conversations").select("conv_id", "turn", tx.doc_length("text").alias("doc_length"))


@register("instance_lengths", with_base("""
SELECT docs.doc_id, coalesce(sum(dtm.n), 0)::BIGINT AS n_tokens FROM docs LEFT JOIN dtm USING (doc_id) GROUP BY docs.doc_id"""))
def q_instance_lengths(spark, sf):
    s = Study(spark, sf)
    return terms.instance_lengths(s.docs, s.dtm)


@register("frozen_vocab_dtm", with_base(f"""
, cterms AS (SELECT conv_id, turn, unnest({tokens_sql()}) AS term FROM conversations)
SELECT conv_id, turn, term, count(*)::BIGINT AS n FROM cterms WHERE term IN (SELECT term FROM kept) GROUP BY ALL"""))
def q_frozen_vocab_dtm(spark, sf):
    s = Study(spark, sf)
    c = conv_docs(spark, sf).select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    d = terms.frozen_vocab_dtm(c, s.spec, s.kept)
    return d.select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"), "term", "n")


@register("vocab_doc_freq", with_base("""
SELECT term, df FROM totals_full WHERE df >= 5 AND df <= 0.5 * (SELECT n FROM n_docs)"""))
def q_vocab_doc_freq(spark, sf):
    s = Study(spark, sf)
    return vocab.keep_by_doc_freq(s.totals_full, s.n_docs, 5, 0.5).select("term", "df")


@register("tfidf", with_base("""
SELECT doc_id, term, n, round(n * ln(((SELECT n FROM n_docs) + 1) / (df + 1)), 6) AS tfidf
FROM dtm_full JOIN totals_full USING (term)"""))
def q_tfidf(spark, sf):
    s = Study(spark, sf)
    return terms.tfidf(s.dtm_full, s.n_docs).withColumn("tfidf", r6("tfidf"))


# ---------------------------------------------------------------- vocabulary

RANKED = """, ranked AS (SELECT term, tf, df, row_number() OVER (ORDER BY tf DESC, term) AS rank,
                         count(*) OVER () AS vocab_size FROM totals_full)"""


@register("term_frequency", with_base("SELECT term, tf, df FROM totals_full"))
def q_term_frequency(spark, sf):
    return Study(spark, sf).totals_full


@register("term_frequency_sorted", with_base(RANKED + " SELECT term, tf, rank FROM ranked"))
def q_term_frequency_sorted(spark, sf):
    return vocab.rank_terms(Study(spark, sf).totals_full).select("term", "tf", "rank")


@register("relative_frequency", with_base("""
SELECT doc_id, term, round(n / tf, 6) AS rel FROM dtm_full JOIN totals_full USING (term)"""))
def q_relative_frequency(spark, sf):
    s = Study(spark, sf)
    return vocab.relative_frequency(s.dtm_full, s.totals_full).select("doc_id", "term", r6("rel").alias("rel"))


@register("occ_cutoff", with_base("""
SELECT count(*) AS vocab_size, round_even(count(*) * 0.01, 0)::BIGINT AS cutoff_1pct,
       round_even(count(*) * 0.05, 0)::BIGINT AS cutoff_5pct FROM totals_full"""))
def q_occ_cutoff(spark, sf):
    t = Study(spark, sf).totals_full.agg(F.count(F.lit(1)).alias("vocab_size"))
    return t.select("vocab_size", vocab.occ_cutoff(F.col("vocab_size"), 0.01).alias("cutoff_1pct"),
                    vocab.occ_cutoff(F.col("vocab_size"), 0.05).alias("cutoff_5pct"))


@register("trim_occurrence", with_base("""
SELECT term, tf FROM totals_full WHERE tf > round_even((SELECT n FROM n_docs) * 0.01, 0) - 1"""))
def q_trim_occurrence(spark, sf):
    s = Study(spark, sf)
    return vocab.keep_by_occurrence(s.totals_full, s.n_docs, 0.01).select("term", "tf")


@register("removal_terms", with_base(RANKED + """
SELECT 'most' AS kind, term, tf, rank FROM ranked WHERE rank <= 9
UNION ALL
SELECT 'least' AS kind, term, tf, rank FROM ranked WHERE rank > vocab_size - (round_even(vocab_size * 0.05, 0) + 1)"""))
def q_removal_terms(spark, sf):
    r = vocab.rank_terms(Study(spark, sf).totals_full)
    most = vocab.removal_terms(r, 10, "most", "absolute").select(F.lit("most").alias("kind"), "term", "tf", "rank")
    least = vocab.removal_terms(r, 0.05, "least", "percent").select(F.lit("least").alias("kind"), "term", "tf", "rank")
    return most.unionByName(least)


@register("removal_frequency", with_base(RANKED + """
SELECT 'most' AS kind, tf AS removal_frequency FROM ranked WHERE rank = round_even(vocab_size * 0.01, 0)
UNION ALL
SELECT 'least' AS kind, tf AS removal_frequency FROM ranked WHERE rank = vocab_size - round_even(vocab_size * 0.05, 0)"""))
def q_removal_frequency(spark, sf):
    r = vocab.rank_terms(Study(spark, sf).totals_full)
    return (vocab.removal_frequency(r, 0.01, "most").select(F.lit("most").alias("kind"), "removal_frequency")
            .unionByName(vocab.removal_frequency(r, 0.05, "least").select(F.lit("least").alias("kind"), "removal_frequency")))


@register("trim_absolute", with_base(RANKED + """
SELECT term, tf FROM ranked WHERE rank <= vocab_size - 100 AND rank > 9"""))
def q_trim_absolute(spark, sf):
    r = vocab.rank_terms(Study(spark, sf).totals_full)
    return vocab.keep_by_rank(r, least=100, most=10, mode="absolute").select("term", "tf")


@register("trim_percent", with_base(RANKED + """
SELECT term, tf FROM ranked WHERE rank <= vocab_size - (round_even(vocab_size * 0.1, 0) + 1)
  AND rank > greatest(round_even(vocab_size * 0.01, 0), 1)"""))
def q_trim_percent(spark, sf):
    r = vocab.rank_terms(Study(spark, sf).totals_full)
    return vocab.keep_by_rank(r, least=0.1, most=0.01, mode="percent").select("term", "tf")


@register("trim_threshold", with_base("SELECT term, tf FROM kept"))
def q_trim_threshold(spark, sf):
    return Study(spark, sf).kept.select("term", "tf")


@register("trim_fixed", with_base("SELECT term, tf FROM totals_full WHERE tf > 2"))
def q_trim_fixed(spark, sf):
    """The one-shot study's fixed cut: total count > 2."""
    return vocab.keep_by_threshold(Study(spark, sf).totals_full, 2, None).select("term", "tf")


QUANT = """, qb AS (SELECT round_even(quantile_cont(tf::DOUBLE, 0.05), 0) AS lo, round_even(quantile_cont(tf::DOUBLE, 0.95), 0) AS hi
               FROM (SELECT DISTINCT tf FROM totals_full))"""


@register("trim_quantile", with_base(QUANT + " SELECT term, tf FROM totals_full, qb WHERE tf > lo AND tf < hi"))
def q_trim_quantile(spark, sf):
    return vocab.keep_by_quantile(Study(spark, sf).totals_full).select("term", "tf")


@register("vocab_size", with_base(RANKED + QUANT + """
SELECT (SELECT count(*) FROM totals_full) AS untrimmed,
       (SELECT count(*) FROM kept) AS threshold,
       (SELECT count(*) FROM ranked WHERE rank <= vocab_size - 100 AND rank > 9) AS absolute,
       (SELECT count(*) FROM totals_full, qb WHERE tf > lo AND tf < hi) AS quantile"""))
def q_vocab_size(spark, sf):
    s = Study(spark, sf)
    r = vocab.rank_terms(s.totals_full)
    cnt = lambda df: df.select(F.count(F.lit(1))).scalar()
    return s.spark.range(1).select(
        cnt(s.totals_full).alias("untrimmed"), cnt(s.kept).alias("threshold"),
        cnt(vocab.keep_by_rank(r, least=100, most=10)).alias("absolute"),
        cnt(vocab.keep_by_quantile(s.totals_full)).alias("quantile"))
