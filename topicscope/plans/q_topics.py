"""Registered queries: fixed-phi topics, projection, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicscope.operators import topics
from topicscope.plans.oracle import with_base
from topicscope.plans.registry import r6, register, round_doubles
from topicscope.plans.study import Study

COHERENCE_SQL = """,
hits AS (SELECT d.doc_id, t.topic, t.rank FROM dtm d JOIN top t USING (term)),
co AS (SELECT a.topic, a.rank AS i, b.rank AS j, count(*) AS co
       FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.topic = b.topic GROUP BY 1, 2, 3),
single AS (SELECT topic, i, co / (SELECT n FROM n_docs) AS p_i FROM co WHERE i = j),
grid AS (SELECT a.topic, a.rank AS i, b.rank AS j FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank),
pairdiff AS (SELECT g.topic, g.i, g.j,
                    coalesce(c.co, 0) / (SELECT n FROM n_docs) / s1.p_i - coalesce(s2.p_i, 0) AS diff
             FROM grid g LEFT JOIN co c ON c.topic = g.topic AND c.i = g.i AND c.j = g.j
             LEFT JOIN single s1 ON s1.topic = g.topic AND s1.i = g.i
             LEFT JOIN single s2 ON s2.topic = g.topic AND s2.i = g.j),
coh AS (SELECT topic, avg(ci) AS coherence FROM (SELECT topic, i, avg(diff) AS ci FROM pairdiff GROUP BY 1, 2) GROUP BY 1),
summary AS (SELECT p.topic, first(t.term ORDER BY t.rank) AS label, round_even(coh.coherence, 3) AS coherence,
                   round_even(p.prevalence, 3) AS prevalence, string_agg(t.term, ', ' ORDER BY t.rank) AS top_terms
            FROM prev p JOIN top t USING (topic) LEFT JOIN coh USING (topic) GROUP BY p.topic, coh.coherence, p.prevalence)"""


def with_summary(body: str, **kw) -> str:
    """Base CTEs + coherence + summary CTEs, then ``body`` (which starts with a comma or SELECT)."""
    return with_base(COHERENCE_SQL + "\n" + body, **kw)


@register("project_topics", with_base("SELECT doc_id, topic, round(weight, 6) AS weight FROM theta"))
def project_topics(spark, sf):
    s = Study(spark, sf)
    return s.theta.select("doc_id", "topic", r6("weight").alias("weight"))


@register("top_terms", with_base("SELECT topic, rank, term, round(phi, 6) AS phi FROM top"))
def top_terms(spark, sf):
    s = Study(spark, sf)
    return s.top.select("topic", "rank", "term", r6("phi").alias("phi"))


@register("prevalence", with_base("SELECT topic, round(prevalence, 6) AS prevalence FROM prev"))
def prevalence(spark, sf):
    s = Study(spark, sf)
    return s.prevalence.select("topic", r6("prevalence").alias("prevalence"))


@register("coherence", with_summary("SELECT topic, round(coherence, 6) AS coherence FROM coh"))
def coherence(spark, sf):
    s = Study(spark, sf)
    return s.coherence.select("topic", r6("coherence").alias("coherence"))


@register("topic_summary", with_summary("SELECT * FROM summary"))
def topic_summary(spark, sf):
    return Study(spark, sf).summary


# ------------------------------------------------------------ labels, Gamma, assignments

@register("topic_labels", with_base(""",
any_ng AS (SELECT count(*) > 0 AS a FROM dtm WHERE contains(term, '_')),
pres AS (SELECT doc_id, term FROM dtm WHERE contains(term, '_') OR NOT (SELECT a FROM any_ng)),
dfs AS (SELECT term, count(*) AS df FROM pres GROUP BY term),
norm AS (SELECT doc_id, topic, weight / nullif(sum(weight) OVER (PARTITION BY doc_id), 0) AS weight FROM theta),
assigned AS (SELECT doc_id, topic FROM norm WHERE weight > 0.05),
ctc AS (SELECT a.topic, p.term, count(*) AS c FROM pres p JOIN assigned a USING (doc_id) GROUP BY 1, 2),
sc AS (SELECT ctc.topic, ctc.term, c / sum(c) OVER (PARTITION BY ctc.topic) - df / (SELECT sum(df) FROM dfs) AS d
       FROM ctc JOIN dfs USING (term))
SELECT topic, term AS label FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY d DESC, term) AS r FROM sc) WHERE r = 1"""))
def q_topic_labels(spark, sf):
    s = Study(spark, sf)
    return topics.labels_by_blocks(s.packed, s.kept_totals, s.theta, s.topic_list, 0.05, again=s.again)


@register("topic_labels_first", with_base("SELECT topic, term AS label FROM top WHERE rank = 1"))
def q_topic_labels_first(spark, sf):
    s = Study(spark, sf)
    return s.top.where(F.col("rank") == 1).select("topic", F.col("term").alias("label"))


@register("top_topics", with_summary("SELECT topic, prevalence FROM summary ORDER BY prevalence DESC, topic LIMIT 10"))
def q_top_topics(spark, sf):
    """Top-k report: the ten most prevalent topics (the limit is the feature)."""
    s = Study(spark, sf)
    return s.summary.orderBy(F.desc("prevalence"), "topic").limit(10).select("topic", "prevalence")


@register("topic_given_word", with_base(""",
pt AS (SELECT topic, s / sum(s) OVER () AS p_topic FROM (SELECT topic, sum(weight) AS s FROM theta GROUP BY topic)),
g AS (SELECT phi.topic, phi.term, phi.phi * pt.p_topic AS g FROM phi JOIN pt USING (topic))
SELECT topic, term, round(g / sum(g) OVER (PARTITION BY term), 6) AS gamma FROM g"""))
def q_topic_given_word(spark, sf):
    s = Study(spark, sf)
    return topics.topic_given_word(s.phi, s.theta).withColumn("gamma", r6("gamma"))


@register("topic_assignments", with_base(", norm AS (SELECT doc_id, topic, coalesce(weight / nullif(sum(weight) OVER (PARTITION BY doc_id), 0), 0) AS weight FROM theta)\nSELECT doc_id, topic, round(weight, 6) AS weight FROM norm WHERE weight > 0.05"))
def q_topic_assignments(spark, sf):
    s = Study(spark, sf)
    return topics.assignments(topics.normalise_rows(s.theta), 0.05).withColumn("weight", r6("weight"))


# ------------------------------------------------------------ word-cloud tables

EXPLODE_SQL = """,
ex AS (SELECT topic, generate_subscripts(string_split(top_terms, ', '), 1)::INTEGER AS position,
              unnest(string_split(top_terms, ', ')) AS word FROM summary)"""


@register("explode_top_terms", with_summary(EXPLODE_SQL + " SELECT topic, position, word FROM ex"))
def q_explode_top_terms(spark, sf):
    from topicscope.operators import cloud
    return cloud.explode_top_terms(Study(spark, sf).summary)


@register("assign_phi", with_summary(EXPLODE_SQL + """
SELECT ex.topic, ex.word, ex.position, round(phi.phi, 6) AS phi FROM ex LEFT JOIN phi ON phi.topic = ex.topic AND phi.term = ex.word"""))
def q_assign_phi(spark, sf):
    from topicscope.operators import cloud
    s = Study(spark, sf)
    return cloud.assign_phi(cloud.explode_top_terms(s.summary), s.phi).withColumn("phi", r6("phi"))


@register("term_relevance", with_base(""",
pw AS (SELECT term, tf / sum(tf) OVER () AS p_w FROM kept)
SELECT topic, term, round(phi, 6) AS phi, round(0.6 * ln(phi) + 0.4 * ln(phi / p_w), 6) AS relevance
FROM phi JOIN pw USING (term)"""))
def q_term_relevance(spark, sf):
    from topicscope.operators import cloud
    s = Study(spark, sf)
    return round_doubles(cloud.term_relevance(s.phi, s.kept, 0.6))


@register("topic_js_distance", with_base(""",
pairs AS (SELECT a.topic AS topic_1, b.topic AS topic_2 FROM topics a JOIN topics b ON a.topic < b.topic),
full_terms AS (SELECT p.topic_1, p.topic_2, x.term, coalesce(x.phi, 0) AS p, coalesce(y.phi, 0) AS q
               FROM pairs p JOIN phi x ON x.topic = p.topic_1 LEFT JOIN phi y ON y.topic = p.topic_2 AND y.term = x.term
               UNION ALL
               SELECT p.topic_1, p.topic_2, y.term, 0 AS p, y.phi AS q
               FROM pairs p JOIN phi y ON y.topic = p.topic_2
               WHERE NOT EXISTS (SELECT 1 FROM phi x WHERE x.topic = p.topic_1 AND x.term = y.term))
SELECT topic_1, topic_2, round(sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END
                                 + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END), 6) AS js_divergence
FROM full_terms GROUP BY 1, 2"""))
def q_topic_js_distance(spark, sf):
    from topicscope.operators import cloud
    return round_doubles(cloud.topic_js_distance(Study(spark, sf).phi))


# ------------------------------------------------------------ exports

def topic_index(df, col="topic"):
    """1-based index of each topic in sorted order (t_1..t_k naming)."""
    from pyspark.sql import Window
    idx = df.select(col).distinct().select(col, F.row_number().over(Window.orderBy(col)).alias("topic_idx"))
    return df.join(F.broadcast(idx), col)


N_SOURCES = 20   # topics of the driver tables, for the SQL twin's column list


@register("theta_wide", with_base("""
, ti AS (SELECT topic, row_number() OVER (ORDER BY topic) AS idx FROM topics)
SELECT doc_id, """ + ", ".join(f"max(CASE WHEN idx = {i} THEN round(weight, 6) END) AS t_{i}" for i in range(1, N_SOURCES + 1)) + """
FROM theta JOIN ti USING (topic) GROUP BY doc_id"""))
def q_theta_wide(spark, sf):
    from topicscope.sources import sinks
    s = Study(spark, sf)
    return sinks.theta_wide(s.theta, topic_list=s.topic_list)
