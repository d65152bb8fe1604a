"""Registered queries: class-based TF-IDF topics (E5-E9, E12-E19) and their exports.

Topics here are the fixed document classes ``documents.source``, numbered from 0
by code point (no source: the outlier topic -1), over all documents; terms are
unigrams of length >= 2 without Snowball stop words.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from topicscope.functions.stopwords import SNOWBALL_EN
from topicscope.operators import ctfidf as C
from topicscope.operators import terms
from topicscope.plans.oracle import STOP, rounded
from topicscope.plans.registry import r6, register, round_doubles
from topicscope.sources import sinks
from topicscope.sources.tables import documents
from topicscope.staging import staged

SPEC = terms.DtmSpec(ngram=(1, 1), stopwords=SNOWBALL_EN, sep=" ", min_token_len=2)
TOP_N = 10


CLASS_DOCS = """srcs AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS topic FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
cd AS (SELECT d.doc_id, d.text, d.lang, coalesce(s.topic, -1) AS topic FROM documents d LEFT JOIN srcs s USING (source))"""


def base(idf: str = "ln((SELECT a FROM aa) / ff.f + 1)", tfn: str = "ct.tf / ttot.ttot") -> str:
    return f"""WITH {CLASS_DOCS},
ctoks AS (SELECT doc_id, topic, lang, list_filter(list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda x: x NOT IN ({STOP})), lambda x: length(x) >= 2) AS t FROM cd),
ct AS (SELECT topic, term, count(*)::BIGINT AS tf FROM (SELECT topic, unnest(t) AS term FROM ctoks) GROUP BY 1, 2),
ttot AS (SELECT topic, sum(tf) AS ttot FROM ct GROUP BY topic),
aa AS (SELECT floor(avg(ttot))::DOUBLE AS a FROM ttot),
ff AS (SELECT term, sum(tf) AS f FROM ct GROUP BY term),
sc AS (SELECT ct.topic, ct.term, ct.tf, {tfn} * {idf} AS score FROM ct JOIN ttot USING (topic) JOIN ff USING (term)),
topw AS (SELECT * FROM (SELECT topic, term, score, (row_number() OVER (PARTITION BY topic ORDER BY score DESC, term))::INTEGER AS rank FROM sc) WHERE rank <= {TOP_N}),
sizes AS (SELECT topic, count(*) AS size FROM cd GROUP BY topic)
"""


class Model:
    def __init__(self, spark, sf):
        self.docs = C.class_documents(documents(spark, sf)).select("doc_id", "text", "lang", "topic")
        self.ct = staged(C.class_term_counts(self.docs, SPEC), "class-terms")   # texts are tokenised once
        self.scores = C.ctfidf(self.ct)
        self.top = C.top_words(self.scores, TOP_N)
        self.sizes = C.topic_sizes(self.docs)


@register("class_term_counts", base() + "SELECT topic, term, tf FROM ct")
def q_class_term_counts(spark, sf):
    return Model(spark, sf).ct


@register("ctfidf", base() + "SELECT topic, term, tf, round(score, 6) AS score FROM sc")
def q_ctfidf(spark, sf):
    return Model(spark, sf).scores.withColumn("score", r6("score"))


@register("ctfidf_bm25", base(idf="ln(1 + ((SELECT a FROM aa) - ff.f + 0.5) / (ff.f + 0.5))")
          + "SELECT topic, term, tf, round(score, 6) AS score FROM sc")
def q_ctfidf_bm25(spark, sf):
    return C.ctfidf(Model(spark, sf).ct, bm25=True).withColumn("score", r6("score"))


@register("ctfidf_sqrt", base(tfn="sqrt(ct.tf / ttot.ttot)") + "SELECT topic, term, tf, round(score, 6) AS score FROM sc")
def q_ctfidf_sqrt(spark, sf):
    return C.ctfidf(Model(spark, sf).ct, reduce_frequent=True).withColumn("score", r6("score"))


@register("topic_top_words", base() + "SELECT topic, rank, term, round(score, 6) AS score FROM topw")
def q_topic_top_words(spark, sf):
    return Model(spark, sf).top.withColumn("score", r6("score"))


@register("topic_summary_embed", base() + """
SELECT 't_' || dense_rank() OVER (ORDER BY topic) AS topic_name, words FROM
(SELECT topic, string_agg(term, ', ' ORDER BY rank) AS words FROM topw WHERE topic <> -1 GROUP BY topic)""")
def q_topic_summary_embed(spark, sf):
    return C.summary_embed(Model(spark, sf).top)


@register("topic_info", base() + """
SELECT s.topic, s.size, s.topic::VARCHAR || '_' || string_agg(w.term, '_' ORDER BY w.rank) AS name
FROM sizes s LEFT JOIN topw w ON w.topic = s.topic AND w.rank <= 4 GROUP BY s.topic, s.size""")
def q_topic_info(spark, sf):
    m = Model(spark, sf)
    return C.topic_info(m.sizes, m.top)


@register("topic_word_map", base() + """
SELECT topic, map_from_entries(list(struct_pack(k := term, v := round(score, 6)) ORDER BY term)) AS words FROM topw GROUP BY topic""")
def q_topic_word_map(spark, sf):
    t = Model(spark, sf).top.withColumn("score", r6("score"))
    return t.groupBy("topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "score")))).alias("words"))


@register("topic_barchart", base() + """
, best AS (SELECT topic, size FROM sizes ORDER BY size DESC, topic LIMIT 30)
SELECT w.topic, w.rank, w.term, round(w.score, 6) AS score, b.size FROM topw w JOIN best b USING (topic) WHERE w.rank <= 5""")
def q_topic_barchart(spark, sf):
    m = Model(spark, sf)
    return C.barchart(m.sizes, m.top, 30, 5).withColumn("score", r6("score"))


@register("topics_per_class", base() + """
, cell AS (SELECT topic, lang AS class, term, count(*) AS tf FROM (SELECT topic, lang, unnest(t) AS term FROM ctoks) GROUP BY 1, 2, 3),
idf AS (SELECT term, ln((SELECT a FROM aa) / f + 1) AS idf FROM ff),
cs AS (SELECT c.topic, c.class, c.term, c.tf / sum(c.tf) OVER (PARTITION BY c.topic, c.class) * idf.idf AS s FROM cell c JOIN idf USING (term)),
cw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, class ORDER BY s DESC, term) AS r FROM cs) WHERE r <= 5),
freq AS (SELECT topic, lang AS class, count(*) AS frequency FROM cd GROUP BY 1, 2)
SELECT f.topic, f.class, f.frequency, string_agg(cw.term, ', ' ORDER BY cw.r) AS words
FROM freq f LEFT JOIN cw ON cw.topic = f.topic AND cw.class = f.class GROUP BY 1, 2, 3""")
def q_topics_per_class(spark, sf):
    docs = C.class_documents(documents(spark, sf)).select("doc_id", "text", "lang", "topic")
    return C.topics_per_class(docs, SPEC, "lang", 5)


@register("topic_distance", rounded(base() + """
, nrm AS (SELECT topic, sqrt(sum(score * score)) AS n FROM sc GROUP BY topic),
dots AS (SELECT a.topic AS topic_1, b.topic AS topic_2, sum(a.score * b.score) AS dot FROM sc a JOIN sc b ON a.term = b.term AND a.topic < b.topic GROUP BY 1, 2)
SELECT n1.topic AS topic_1, n2.topic AS topic_2, coalesce(dot, 0) / (n1.n * n2.n) AS similarity, 1 - coalesce(dot, 0) / (n1.n * n2.n) AS distance
FROM nrm n1 JOIN nrm n2 ON n1.topic < n2.topic LEFT JOIN dots d ON d.topic_1 = n1.topic AND d.topic_2 = n2.topic""",
                                        ["similarity", "distance"]))
def q_topic_distance(spark, sf):
    return round_doubles(C.topic_distance(Model(spark, sf).scores))


APPROX_SQL = base() + f"""
, rtoks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda x: length(x) >= 2) AS t FROM cd),
wins AS (SELECT doc_id, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS win,
                unnest(list_transform(range(1, greatest(len(t) - 3, 1) + 1), lambda i: t[i:i + 3])) AS toks FROM rtoks),
wt AS (SELECT doc_id, win, unnest(list_filter(toks, lambda x: x NOT IN ({STOP}))) AS term FROM wins),
wc AS (SELECT doc_id, win, term, count(*) AS c FROM wt GROUP BY 1, 2, 3),
idf AS (SELECT term, ln((SELECT a FROM aa) / f + 1) AS idf FROM ff),
vec AS (SELECT wc.*, c / sum(c) OVER (PARTITION BY doc_id, win) * idf.idf AS v FROM wc JOIN idf USING (term)),
vn AS (SELECT doc_id, win, sqrt(sum(v * v)) AS vn FROM vec GROUP BY 1, 2),
tn AS (SELECT topic, sqrt(sum(score * score)) AS tn FROM sc GROUP BY topic),
dots AS (SELECT vec.doc_id, vec.win, sc.topic, sum(vec.v * sc.score) AS dot FROM vec JOIN sc USING (term) GROUP BY 1, 2, 3),
sim AS (SELECT d.doc_id, d.topic, d.dot / (vn.vn * tn.tn) AS sim FROM dots d JOIN vn USING (doc_id, win) JOIN tn USING (topic)),
tot AS (SELECT doc_id, topic, sum(sim) AS s FROM sim WHERE sim >= 0.1 GROUP BY 1, 2)
SELECT doc_id, topic, round(s / sum(s) OVER (PARTITION BY doc_id), 6) AS weight FROM tot"""


@register("approx_distribution", APPROX_SQL)
def q_approx_distribution(spark, sf):
    m = Model(spark, sf)
    out = C.approx_distribution(m.docs, m.scores, C.idf_table(m.ct), window=4, min_similarity=0.1)
    return out.withColumn("weight", r6("weight"))


@register("topic_terms_export", base() + "SELECT topic + 1 AS file_index, term AS Word, round(score, 6) AS phi, rank FROM topw")
def q_topic_terms_export(spark, sf):
    return sinks.topic_terms_files(Model(spark, sf).top.withColumn("score", r6("score")))


N_TOPICS = 20   # sources of the driver tables, for the SQL twin's column list


@register("topic_dictionary_wide", base() + """
SELECT rank, """ + ", ".join(f"""max(CASE WHEN topic = {i} THEN printf('(''%s'', %.6f)', term, score) END) AS "{i}\"""" for i in range(N_TOPICS)) + """
FROM topw GROUP BY rank""")
def q_topic_dictionary_wide(spark, sf):
    return sinks.topic_dictionary_wide(Model(spark, sf).top)


HIER_ROUNDS = 7   # covers up to 128 topics; extra rounds leave the closure unchanged


def _hierarchy_sql() -> str:
    steps = []
    prev = "d0"
    for r in range(1, HIER_ROUNDS + 1):
        steps.append(f"d{r} AS (SELECT a.i, b.j, min(greatest(a.d, b.d)) AS d FROM {prev} a JOIN {prev} b ON a.j = b.i GROUP BY 1, 2)")
        prev = f"d{r}"
    return base() + f"""
, nrm AS (SELECT topic, sqrt(sum(score * score)) AS n FROM sc GROUP BY topic),
dots AS (SELECT a.topic AS t1, b.topic AS t2, sum(a.score * b.score) AS dot FROM sc a JOIN sc b ON a.term = b.term GROUP BY 1, 2),
d0 AS (SELECT n1.topic AS i, n2.topic AS j, CASE WHEN n1.topic = n2.topic THEN 0.0 ELSE 1 - coalesce(dot, 0) / (n1.n * n2.n) END AS d
       FROM nrm n1 JOIN nrm n2 ON TRUE LEFT JOIN dots ON dots.t1 = n1.topic AND dots.t2 = n2.topic),
{", ".join(steps)}
SELECT i AS topic_1, j AS topic_2, round(d, 6) AS merge_distance FROM {prev} WHERE i < j"""


@register("topic_hierarchy", _hierarchy_sql())
def q_topic_hierarchy(spark, sf):
    return C.topic_hierarchy(C.topic_distance(Model(spark, sf).scores)).withColumn("merge_distance", r6("merge_distance"))


TOKEN_SQL = APPROX_SQL.split(",\ntot AS")[0].replace(
    "sim AS (SELECT d.doc_id, d.topic, d.dot / (vn.vn * tn.tn) AS sim",
    "sim AS (SELECT d.doc_id, d.win, d.topic, d.dot / (vn.vn * tn.tn) AS sim") + """,
cover AS (SELECT s.doc_id, s.topic, s.sim, unnest(range(s.win, least(s.win + 4, len(r.t) + 1))) AS pos
          FROM sim s JOIN rtoks r USING (doc_id) WHERE s.sim >= 0.1),
tk AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM rtoks)
SELECT c.doc_id, (c.pos - 1)::INTEGER AS pos, tk.token, c.topic, round(sum(c.sim), 6) AS weight
FROM cover c JOIN tk ON tk.doc_id = c.doc_id AND tk.pos = c.pos GROUP BY c.doc_id, c.pos, tk.token, c.topic"""


@register("token_distribution", TOKEN_SQL)
def q_token_distribution(spark, sf):
    m = Model(spark, sf)
    out = C.token_distribution(m.docs, m.scores, C.idf_table(m.ct), window=4, min_similarity=0.1)
    return out.withColumn("weight", r6("weight"))
