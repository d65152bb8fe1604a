"""Registered queries: statistical tests of topics against outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicscope.functions.dist import t_pvalue_sql, t_quantile_sql
from topicscope.operators import stats
from topicscope.plans import workflow as W
from topicscope.plans.oracle import rounded, with_base
from topicscope.plans.q_topics import with_summary
from topicscope.plans.registry import register, round_doubles
from topicscope.plans.study import Study

WELCH_COLS = ["pair", "topic", "group_1", "group_2", "n_1", "n_2", "mean_group_1", "mean_group_2",
              "t_stat", "df", "p_value", "p_adjusted", "cohen_d"]


def welch_sql(group: str = "quality", source: str = "labels", lo: str | None = None, base: dict | None = None) -> str:
    p = t_pvalue_sql("t_stat", "df", "duckdb")
    lo = lo or f"SELECT t.doc_id, t.topic, t.weight, l.{group} AS g FROM theta t JOIN {source} l USING (doc_id) WHERE l.{group} IS NOT NULL"
    return with_summary(f""",
lo AS ({lo}),
mom AS (SELECT topic, g, count(weight) AS n, avg(weight) AS mean, var_samp(weight) AS var FROM lo GROUP BY 1, 2),
ng AS (SELECT count(DISTINCT g) AS ng FROM mom),
pairs AS (SELECT a.topic, a.g AS group_1, b.g AS group_2, a.n AS n_1, b.n AS n_2, a.mean AS mean_group_1,
                 b.mean AS mean_group_2, a.var AS v1, b.var AS v2, a.var / a.n + b.var / b.n AS se2
          FROM mom a JOIN mom b ON a.topic = b.topic AND a.g < b.g),
tt AS (SELECT *, n_1 >= 2 AND n_2 >= 2 AND se2 > 0 AS ok,
              sqrt(((n_1 - 1) * v1 + (n_2 - 1) * v2) / (n_1 + n_2 - 2)) AS pooled FROM pairs),
st AS (SELECT *, CASE WHEN ok THEN (mean_group_1 - mean_group_2) / sqrt(se2) END AS t_stat,
              CASE WHEN ok THEN se2 * se2 / ((v1 / n_1) ^ 2 / (n_1 - 1) + (v2 / n_2) ^ 2 / (n_2 - 1)) END AS df,
              CASE WHEN ok AND pooled > 0 THEN (mean_group_1 - mean_group_2) / pooled END AS cohen_d FROM tt),
pv AS (SELECT *, {p} AS p_value FROM st),
res AS (SELECT group_1::VARCHAR || '_' || group_2::VARCHAR AS pair, topic, group_1, group_2, n_1, n_2,
               mean_group_1, mean_group_2, t_stat, df, p_value,
               CASE WHEN (SELECT ng FROM ng) <= 1 THEN p_value ELSE least(1.0, (SELECT ng FROM ng) * p_value) END AS p_adjusted,
               cohen_d FROM pv)
SELECT res.*, summary.top_terms, summary.prevalence, summary.coherence
FROM res LEFT JOIN summary USING (topic)""", **(base or {}))


WELCH_DOUBLES = ["mean_group_1", "mean_group_2", "t_stat", "df", "p_value", "p_adjusted", "cohen_d",
                 "prevalence", "coherence"]


@register("welch_ttest", rounded(welch_sql(), WELCH_DOUBLES))
def welch_ttest(spark, sf):
    s = Study(spark, sf)
    res = stats.welch_ttest(s.loadings_with(["quality"]), "quality", method="fdr", compat=True)
    out = stats.join_summary(res, s.summary.select("topic", "top_terms", "prevalence", "coherence"))
    return round_doubles(out.select(*WELCH_COLS, "top_terms", "prevalence", "coherence"))


def _welch_out(res, s):
    out = stats.join_summary(res, s.summary.select("topic", "top_terms", "prevalence", "coherence"))
    return round_doubles(out.select(*WELCH_COLS, "top_terms", "prevalence", "coherence"))


# ------------------------------------------------------------ outcome shaping

@register("is_continuous", """
SELECT 'n_chars' AS variable, count(DISTINCT n_chars) AS n_distinct, count(DISTINCT n_chars) > 50 AS is_continuous FROM documents
UNION ALL
SELECT 'quality', count(DISTINCT quality), count(DISTINCT quality) > 50 FROM labels""")
def q_is_continuous(spark, sf):
    from topicscope.sources.tables import read_table
    a = stats.is_continuous(read_table(spark, sf, "documents"), "n_chars").select(F.lit("n_chars").alias("variable"), "n_distinct", "is_continuous")
    b = stats.is_continuous(read_table(spark, sf, "labels"), "quality").select(F.lit("quality").alias("variable"), "n_distinct", "is_continuous")
    return a.unionByName(b)


MEDIAN_LO = """SELECT t.doc_id, t.topic, t.weight,
       CASE WHEN d.n_chars >= (SELECT median(n_chars) FROM docs) THEN 'Group1' ELSE 'Group2' END AS g
FROM theta t JOIN docs d USING (doc_id)"""


@register("median_split_ttest", rounded(welch_sql(lo=MEDIAN_LO), WELCH_DOUBLES))
def q_median_split_ttest(spark, sf):
    s = Study(spark, sf)
    lo = s.loadings(stats.attach_outcomes(s.theta_rows, stats.median_split(s.docs.select("doc_id", "n_chars"), "n_chars", "g"), ["g"]))
    return _welch_out(stats.welch_ttest(lo, "g", method="fdr", compat=True), s)


@register("quartile_split", """
WITH d AS (SELECT doc_id, n_chars FROM documents),
q AS (SELECT quantile_cont(n_chars::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM d)
SELECT doc_id, n_chars, CASE WHEN n_chars <= q[1] THEN 'Q1' WHEN n_chars <= q[2] THEN 'Q2' WHEN n_chars <= q[3] THEN 'Q3' ELSE 'Q4' END AS split_group
FROM d, q""")
def q_quartile_split(spark, sf):
    s = Study(spark, sf)
    return stats.quartile_split(s.docs.select("doc_id", "n_chars"), "n_chars")


@register("min_max_split", """
WITH d AS (SELECT doc_id, n_chars FROM documents)
(SELECT doc_id, n_chars, 'min' AS split_group FROM d ORDER BY n_chars, doc_id LIMIT 20)
UNION ALL
(SELECT doc_id, n_chars, 'max' AS split_group FROM d ORDER BY n_chars DESC, doc_id LIMIT 20)""")
def q_min_max_split(spark, sf):
    s = Study(spark, sf)
    return stats.min_max_split(s.docs.select("doc_id", "n_chars"), "n_chars", 20)


@register("cohens_d", rounded(f"SELECT pair, topic, cohen_d FROM ({welch_sql('toxic')})", ["cohen_d"]))
def q_cohens_d(spark, sf):
    s = Study(spark, sf)
    res = stats.welch_ttest(s.loadings_with(["toxic"]), "toxic", method="fdr", compat=True)
    return round_doubles(res.select("pair", "topic", "cohen_d"))


def _ci_sql(centre: str, low: str, high: str, df: str, se: str, group: str) -> str:
    """Interval around ``centre`` from the Welch statement's columns."""
    reach = f"{t_quantile_sql(0.05, 'dfree', 'duckdb')} * se"
    return f"""SELECT pair, topic, {centre} AS estimate, {centre} - reach AS {low}, {centre} + reach AS {high}
FROM (SELECT *, {reach} AS reach FROM (SELECT *, {df} AS dfree, {se} AS se FROM ({welch_sql(group)})))"""


@register("welch_ci", rounded(_ci_sql("(mean_group_1 - mean_group_2)", "conf_low", "conf_high", "df", "(mean_group_1 - mean_group_2) / t_stat", "quality"),
                              ["estimate", "conf_low", "conf_high"]))
def q_welch_ci(spark, sf):
    """95 % confidence interval of the difference of means."""
    s = Study(spark, sf)
    res = stats.welch_ttest(s.loadings_with(["quality"]), "quality", method="fdr", compat=True)
    return round_doubles(res.select("pair", "topic", (F.col("mean_group_1") - F.col("mean_group_2")).alias("estimate"), "conf_low", "conf_high"))


@register("cohens_d_ci", rounded(_ci_sql("cohen_d", "d_low", "d_high", "(n_1 + n_2 - 2)::DOUBLE",
                                         "sqrt((n_1 + n_2) / (n_1 * n_2) + cohen_d ^ 2 / (2 * (n_1 + n_2)))", "toxic"), ["estimate", "d_low", "d_high"]))
def q_cohens_d_ci(spark, sf):
    """Cohen's d with its 95 % confidence interval."""
    s = Study(spark, sf)
    res = stats.welch_ttest(s.loadings_with(["toxic"]), "toxic", method="fdr", compat=True)
    return round_doubles(res.select("pair", "topic", F.col("cohen_d").alias("estimate"), "d_low", "d_high"))


@register("multi_group_ttest", rounded(welch_sql(lo="""SELECT t.doc_id, t.topic, t.weight, d.lang AS g
FROM theta t JOIN (SELECT doc_id, lang FROM documents) d USING (doc_id)""", base={"lang": None}), WELCH_DOUBLES))
def q_multi_group_ttest(spark, sf):
    """Every pair of languages x topic (all languages in the corpus)."""
    from topicscope.sources.tables import read_table
    s = Study(spark, sf, lang=None)
    lo = s.loadings(stats.attach_outcomes(s.theta_rows, read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("g")), ["g"]))
    return _welch_out(stats.welch_ttest(lo, "g", method="bonferroni", compat=True), s)


# ------------------------------------------------------------ correlation and p-adjust

CORR_DOUBLES = ["estimate", "df", "t_stat", "conf_low", "conf_high", "p_value", "p_adjusted"]


def corr_sql(adjust: str) -> str:
    p = t_pvalue_sql("t_stat", "df", "duckdb")
    return with_base(f""",
lo AS (SELECT t.topic, t.weight, d.n_chars AS y FROM theta t JOIN docs d USING (doc_id)),
agg AS (SELECT topic, count(*) AS n, corr(weight, y) AS estimate FROM lo GROUP BY topic),
st AS (SELECT topic, n, estimate, (n - 2)::DOUBLE AS df, estimate * sqrt((n - 2) / (1 - estimate * estimate)) AS t_stat,
              CASE WHEN n > 3 THEN tanh(atanh(estimate) - {stats.Z975!r} / sqrt(n - 3)) END AS conf_low,
              CASE WHEN n > 3 THEN tanh(atanh(estimate) + {stats.Z975!r} / sqrt(n - 3)) END AS conf_high FROM agg),
pv AS (SELECT *, {p} AS p_value FROM st)
{adjust}""")


def adjust_sql(method: str, src: str = "pv", fam: str = "") -> str:
    """SELECT *, p_adjusted FROM src with the step rule as windows."""
    part = f"PARTITION BY {fam}" if fam else ""
    pre = f"""SELECT *, row_number() OVER ({part} ORDER BY p_value, topic) AS _i, count(p_value) OVER ({part}) AS _m FROM {src}"""
    asc = f"OVER ({part} ORDER BY _i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    desc = f"OVER ({part} ORDER BY _i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    harm = "(SELECT sum(1.0 / j) FROM range(1, _m + 1) r(j))"
    rule = {
        "none": "p_value",
        "bonferroni": "least(1.0, _m * p_value)",
        "holm": f"least(1.0, max((_m - _i + 1) * p_value) {asc})",
        "hochberg": f"least(1.0, min((_m - _i + 1) * p_value) {desc})",
        "BH": f"least(1.0, min(_m / _i * p_value) {desc})",
        "BY": f"least(1.0, min(_m / _i * p_value) {desc} * list_sum(list_transform(range(1, _m + 1), lambda j: 1.0 / j)))",
    }
    if method == "hommel":
        h = """list_transform(range(1, len(ps) + 1), lambda i: greatest(
                 CASE WHEN len(ps) >= 3 THEN greatest(init, list_max(list_transform(range(2, len(ps)),
                      lambda m: least(m * ps[least(i, len(ps) - m + 1)], q1[m])))) ELSE init END, ps[i]))"""
        return f"""SELECT * EXCLUDE (_i, _m, ps, init, q1, hv), CASE WHEN _m <= 1 THEN p_value WHEN _m = 2 THEN least(1.0, min((_m - _i + 1) * p_value) {desc}) ELSE hv[_i] END AS p_adjusted FROM (
  SELECT *, {h} AS hv FROM (
    SELECT *, list_min(list_transform(range(1, len(ps) + 1), lambda j: len(ps) * ps[j] / j)) AS init,
           list_transform(range(1, len(ps) + 1), lambda m: CASE WHEN m >= 2 THEN list_min(list_transform(range(2, m + 1), lambda k: m * ps[len(ps) - m + k] / k)) END) AS q1
    FROM (SELECT *, list_sort(list(p_value) OVER ({part})) AS ps FROM ({pre}))))"""
    return f"SELECT * EXCLUDE (_i, _m), CASE WHEN _m <= 1 THEN p_value ELSE {rule[method]} END AS p_adjusted FROM ({pre})"


@register("correlation_test", rounded(corr_sql(adjust_sql("bonferroni")), CORR_DOUBLES))
def q_correlation_test(spark, sf):
    s = Study(spark, sf)
    res = stats.correlation_test(s.loadings_with(["n_chars"], source="docs"), "n_chars", "bonferroni")
    return round_doubles(res)


PADJ = {"bonferroni": "bonferroni", "holm": "holm", "hochberg": "hochberg", "bh": "BH", "by": "BY",
        "hommel": "hommel", "none": "none"}


def _padj_query(method):
    def q(spark, sf):
        s = Study(spark, sf)
        res = stats.correlation_test(s.loadings_with(["n_chars"], source="docs"), "n_chars", method)
        return round_doubles(res.select("topic", "p_value", "p_adjusted"))
    return q


for _k, _m in PADJ.items():
    register(f"p_adjust_{_k}", rounded(
        f"SELECT topic, p_value, p_adjusted FROM ({corr_sql(adjust_sql(_m))})", ["p_value", "p_adjusted"]))(_padj_query(_m))


# ------------------------------------------------------------ regression

REG_DOUBLES = ["estimate", "t_value", "p_value", "p_adjusted"]


def reg_sql(ycol: str, xcol: str, variable: str, lo: str, method: str = "BH") -> str:
    p = t_pvalue_sql("t_value", "_df", "duckdb")
    return f""",
lo AS ({lo}),
zs AS (SELECT topic, avg(weight) AS mu, stddev_samp(weight) AS sd FROM lo GROUP BY topic),
zl AS (SELECT lo.*, coalesce((weight - mu) / nullif(sd, 0), 0) AS z_topic,
              coalesce((c - (SELECT avg(c) FROM lo WHERE topic = (SELECT min(topic) FROM lo))) / (SELECT stddev_samp(c) FROM lo WHERE topic = (SELECT min(topic) FROM lo)), 0) AS z_c
       FROM lo JOIN zs USING (topic)),
agg AS (SELECT topic, count(*) AS n, covar_samp({xcol}, {ycol}) AS sxy, var_samp({xcol}) AS sxx, var_samp({ycol}) AS syy FROM zl GROUP BY topic),
st AS (SELECT topic, '{variable}' AS variable, sxy / nullif(sxx, 0) AS estimate,
              (sxy / nullif(sxx, 0)) / sqrt(((n - 1) * (syy - (sxy / nullif(sxx, 0)) * sxy) / (n - 2)) / ((n - 1) * sxx)) AS t_value,
              (n - 2)::DOUBLE AS _df FROM agg),
pv AS (SELECT topic, variable, estimate, t_value, {p} AS p_value FROM st),
res AS ({adjust_sql(method, 'pv', 'variable')})"""


REG_LO = "SELECT t.doc_id, t.topic, t.weight, d.n_chars::DOUBLE AS c FROM theta t JOIN docs d USING (doc_id)"


@register("linear_regression", rounded(with_summary(
    reg_sql("z_topic", "z_c", "n_chars", REG_LO) + """
SELECT summary.top_terms, res.* FROM summary RIGHT JOIN res USING (topic)"""), REG_DOUBLES))
def q_linear_regression(spark, sf):
    s = Study(spark, sf)
    res = stats.linear_regression(s.loadings_with(["n_chars"], source="docs"), ["n_chars"], "fdr")
    return round_doubles(stats.join_summary(res, s.summary.select("topic", "top_terms"), "left")
                         .select("top_terms", "topic", "variable", "estimate", "t_value", "p_value", "p_adjusted"))


LOGIT_LO = "SELECT t.doc_id, t.topic, t.weight, l.quality::DOUBLE AS c FROM theta t JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL"


@register("logistic_regression_compat", rounded(with_base(
    reg_sql("z_c", "z_topic", "quality", LOGIT_LO) + " SELECT * FROM res"), REG_DOUBLES))
def q_logistic_regression_compat(spark, sf):
    s = Study(spark, sf)
    return round_doubles(stats.logistic_regression_compat(s.loadings_with(["quality"]), "quality", "fdr"))


@register("zscore", rounded(with_base("""
SELECT doc_id, topic, coalesce((weight - avg(weight) OVER (PARTITION BY topic)) / nullif(stddev_samp(weight) OVER (PARTITION BY topic), 0), 0) AS z_topic
FROM theta"""), ["z_topic"]))
def q_zscore(spark, sf):
    s = Study(spark, sf)
    return round_doubles(stats.zscore(s.theta, "weight", ["topic"], "z_topic").select("doc_id", "topic", "z_topic"))


@register("complete_cases_joined", rounded(with_base("""
SELECT t.doc_id, t.topic, t.weight, l.quality FROM theta t JOIN labels l USING (doc_id)
WHERE l.quality IS NOT NULL AND t.weight IS NOT NULL"""), ["weight"]))
def q_complete_cases_joined(spark, sf):
    s = Study(spark, sf)
    return round_doubles(s.loadings_with(["quality"]).select("doc_id", "topic", "weight", "quality"))


@register("attach_outcomes", rounded(with_base("""
SELECT t.doc_id, t.topic, t.weight, d.n_chars FROM theta t JOIN docs d USING (doc_id)"""), ["weight"]))
def q_attach_outcomes(spark, sf):
    s = Study(spark, sf)
    return round_doubles(s.loadings(stats.attach_outcomes(s.theta_rows, s.docs, ["n_chars"])).select("doc_id", "topic", "weight", "n_chars"))


@register("sort_stats", rounded(f"""
SELECT topic, p_value, p_adjusted, (row_number() OVER (ORDER BY p_value, p_adjusted, topic))::INTEGER AS position
FROM ({corr_sql(adjust_sql('holm'))})""", ["p_value", "p_adjusted"]))
def q_sort_stats(spark, sf):
    from pyspark.sql import Window
    s = Study(spark, sf)
    res = stats.correlation_test(s.loadings_with(["n_chars"], source="docs"), "n_chars", "holm")
    w = Window.orderBy("p_value", "p_adjusted", "topic")
    return round_doubles(stats.sort_stats(res).select("topic", "p_value", "p_adjusted",
                                                      F.row_number().over(w).alias("position")))


@register("topic_test_oneshot", rounded(welch_sql(base={"ngram": (1, 3), "least": 2, "most": None}), WELCH_DOUBLES))
def q_topic_test_oneshot(spark, sf):
    """One-shot group comparison: 1-3 grams, total > 2, fixed topics, Welch + fdr."""
    s = Study(spark, sf, ngram=(1, 3), least=2, most=None)
    res = stats.welch_ttest(s.loadings_with(["quality"]), "quality", method="fdr", compat=True)
    return _welch_out(res, s)


# ------------------------------------------------------------ word-cloud table

@register("wordcloud_table", rounded(with_summary(
    reg_sql("z_topic", "z_c", "n_chars", REG_LO) + """,
ex AS (SELECT topic, generate_subscripts(string_split(top_terms, ', '), 1)::INTEGER AS position,
              unnest(string_split(top_terms, ', ')) AS word FROM summary),
wp AS (SELECT ex.topic, ex.position, ex.word, phi.phi FROM ex LEFT JOIN phi ON phi.topic = ex.topic AND phi.term = ex.word),
sel AS (SELECT topic, estimate, p_adjusted FROM res WHERE p_adjusted IS NOT NULL AND NOT isnan(p_adjusted))
SELECT wp.topic, wp.position, wp.word, wp.phi, sel.estimate, CASE WHEN sel.estimate < 0 THEN 'neg' ELSE 'pos' END AS sign,
       greatest(10.0 * ln(summary.prevalence), 0.0) AS max_size, printf('%.2e', sel.p_adjusted) AS p_label
FROM wp JOIN sel USING (topic) JOIN summary USING (topic)"""), ["phi", "estimate", "max_size"]))
def q_wordcloud_table(spark, sf):
    from topicscope.operators import cloud
    s = Study(spark, sf)
    res = stats.linear_regression(s.loadings_with(["n_chars"], source="docs"), ["n_chars"], "fdr")
    words = cloud.assign_phi(cloud.explode_top_terms(s.summary), s.phi)
    return round_doubles(cloud.wordcloud_table(words, res, s.summary).drop("variable"))


MULTI_LO = """SELECT t.doc_id, t.topic, t.weight, d.n_chars::DOUBLE AS c1, l.quality::DOUBLE AS c2
FROM theta t JOIN docs d USING (doc_id) JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL"""


def multi_reg_sql() -> str:
    p = t_pvalue_sql("t_value", "_df", "duckdb")
    return with_base(f""",
lo AS ({MULTI_LO}),
pdoc AS (SELECT DISTINCT doc_id, c1, c2 FROM lo),
cm AS (SELECT avg(c1) AS m1, stddev_samp(c1) AS s1, avg(c2) AS m2, stddev_samp(c2) AS s2 FROM pdoc),
zs AS (SELECT topic, avg(weight) AS mu, stddev_samp(weight) AS sd FROM lo GROUP BY topic),
zl AS (SELECT lo.topic, coalesce((weight - mu) / nullif(sd, 0), 0) AS y, coalesce((c1 - m1) / nullif(s1, 0), 0) AS x1,
              coalesce((c2 - m2) / nullif(s2, 0), 0) AS x2 FROM lo JOIN zs USING (topic), cm),
agg AS (SELECT topic, count(*) AS n, var_samp(x1) AS s11, var_samp(x2) AS s22, covar_samp(x1, x2) AS s12,
               covar_samp(x1, y) AS s1y, covar_samp(x2, y) AS s2y, var_samp(y) AS syy FROM zl GROUP BY topic),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM agg),
e AS (SELECT *, (n - 1) * (syy - b1 * s1y - b2 * s2y) / (n - 3) AS sigma2 FROM b),
st AS (SELECT topic, 'n_chars' AS variable, b1 AS estimate, b1 / sqrt(sigma2 * s22 / ((n - 1) * det)) AS t_value, (n - 3)::DOUBLE AS _df FROM e
       UNION ALL
       SELECT topic, 'quality' AS variable, b2 AS estimate, b2 / sqrt(sigma2 * s11 / ((n - 1) * det)) AS t_value, (n - 3)::DOUBLE AS _df FROM e),
pv AS (SELECT topic, variable, estimate, t_value, {p} AS p_value FROM st),
res AS ({adjust_sql('BH', 'pv', 'variable')})
SELECT * FROM res""")


@register("linear_regression_multi", rounded(multi_reg_sql(), REG_DOUBLES))
def q_linear_regression_multi(spark, sf):
    """Two controls: z(topic) ~ z(n_chars) + z(quality), fdr within each control."""
    s = Study(spark, sf)
    lo = s.loadings(stats.attach_outcomes(s.theta_rows, s.docs.select("doc_id", "n_chars").join(s.labels, "doc_id"), ["n_chars", "quality"]))
    return round_doubles(stats.linear_regression(lo, ["n_chars", "quality"], "fdr"))


# ------------------------------------------------------------ tests through the user's entry points

def three_reg_sql() -> str:
    """Three controls from the normal equations' adjugate."""
    p = t_pvalue_sql("t_value", "_df", "duckdb")
    names = ("n_chars", "quality", "toxic")
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def cofactor(i, j):
        (a, b), (c, d) = [r for r in (1, 2, 3) if r != i], [r for r in (1, 2, 3) if r != j]
        return f"({'-' if (i + j) % 2 else ''}({s(a, c)} * {s(b, d)} - {s(a, d)} * {s(b, c)}))"
    inverse = ", ".join(f"{cofactor(i, j)} / det AS v{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    moments = ", ".join([f"covar_samp(x{i}, x{j}) AS s{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j] + [f"covar_samp(x{i}, y) AS s{i}y" for i in (1, 2, 3)])
    rows = " UNION ALL ".join(f"SELECT topic, '{c}' AS variable, b{i} AS estimate, b{i} / sqrt(sigma2 * v{i}{i} / (n - 1)) AS t_value, (n - 4)::DOUBLE AS _df FROM e"
                              for i, c in enumerate(names, 1))
    return with_base(f""",
lo AS (SELECT t.doc_id, t.topic, t.weight, d.n_chars::DOUBLE AS c1, l.quality::DOUBLE AS c2, l.toxic::DOUBLE AS c3
  FROM theta t JOIN docs d USING (doc_id) JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL),
pdoc AS (SELECT DISTINCT doc_id, c1, c2, c3 FROM lo),
cm AS (SELECT {", ".join(f"avg(c{i}) AS m{i}, stddev_samp(c{i}) AS d{i}" for i in (1, 2, 3))} FROM pdoc),
zs AS (SELECT topic, avg(weight) AS mu, stddev_samp(weight) AS sd FROM lo GROUP BY topic),
zl AS (SELECT lo.topic, coalesce((weight - mu) / nullif(sd, 0), 0) AS y,
              {", ".join(f"coalesce((c{i} - m{i}) / nullif(d{i}, 0), 0) AS x{i}" for i in (1, 2, 3))} FROM lo JOIN zs USING (topic), cm),
agg AS (SELECT topic, count(*) AS n, var_samp(y) AS syy, {moments} FROM zl GROUP BY topic),
dt AS (SELECT *, s11 * {cofactor(1, 1)} + s12 * {cofactor(1, 2)} + s13 * {cofactor(1, 3)} AS det FROM agg),
iv AS (SELECT *, {inverse} FROM dt),
b AS (SELECT *, {", ".join(f"v{i}1 * s1y + v{i}2 * s2y + v{i}3 * s3y AS b{i}" for i in (1, 2, 3))} FROM iv),
e AS (SELECT *, (n - 1) * (syy - b1 * s1y - b2 * s2y - b3 * s3y) / (n - 4) AS sigma2 FROM b),
st AS ({rows}),
pv AS (SELECT topic, variable, estimate, t_value, {p} AS p_value FROM st),
res AS ({adjust_sql('BH', 'pv', 'variable')})
SELECT * FROM res""")


@register("regression_three_controls", rounded(three_reg_sql(), REG_DOUBLES))
def q_regression_three_controls(spark, sf):
    """z(topic) ~ z(n_chars) + z(quality) + z(toxic), fdr within each control."""
    s = Study(spark, sf)
    cols = ["n_chars", "quality", "toxic"]
    lo = s.loadings(stats.attach_outcomes(s.theta_rows, s.docs.select("doc_id", "n_chars").join(s.labels, "doc_id"), cols))
    return round_doubles(stats.linear_regression(lo, cols, "fdr"))


@register("correlation_compat", rounded(f"""
SELECT * REPLACE (least(1.0, p_value * (count(*) OVER () + 1)) AS p_adjusted) FROM ({corr_sql(adjust_sql('none'))})""", CORR_DOUBLES))
def q_correlation_compat(spark, sf):
    """Each topic's p adjusted alone, the family being the topics and the outcome."""
    s = Study(spark, sf)
    res = W.topic_test(s.loadings_with(["n_chars"], source="docs"), "n_chars", s.summary, test_method="correlation", compat=True)
    return round_doubles(res.select("topic", "n", *CORR_DOUBLES))


QUARTILE_LO = """SELECT t.doc_id, t.topic, t.weight, CASE WHEN n_chars <= q[1] THEN 'Q1' WHEN n_chars <= q[2] THEN 'Q2' WHEN n_chars <= q[3] THEN 'Q3' ELSE 'Q4' END AS g
FROM theta t JOIN docs USING (doc_id), (SELECT quantile_cont(n_chars::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM docs)"""


@register("split_ttest", rounded(welch_sql(lo=QUARTILE_LO), WELCH_DOUBLES))
def q_split_ttest(spark, sf):
    """A t-test on a continuous outcome compares the groups of its split, here quartiles."""
    s = Study(spark, sf)
    res = W.topic_test(s.loadings_with(["n_chars"], source="docs"), "n_chars", s.summary, test_method="t-test", split="quartile", multiple_comparison="fdr")
    return round_doubles(res.select(*WELCH_COLS, "top_terms", "prevalence", "coherence"))


CLOUD_TOPICS = [1, 3, 4, 20]


@register("wordcloud_ttest", rounded(with_summary(f""",
ex AS (SELECT topic, generate_subscripts(string_split(top_terms, ', '), 1)::INTEGER AS position, unnest(string_split(top_terms, ', ')) AS word FROM summary),
wp AS (SELECT ex.topic, ex.position, ex.word, phi.phi FROM ex LEFT JOIN phi ON phi.topic = ex.topic AND phi.term = ex.word),
chosen AS (SELECT topic, prevalence FROM summary QUALIFY row_number() OVER (ORDER BY topic) IN ({', '.join(map(str, CLOUD_TOPICS))})),
sel AS (SELECT topic, pair, cohen_d AS estimate, p_adjusted FROM ({welch_sql()}) WHERE p_adjusted < 1.1)
SELECT wp.topic, sel.pair, wp.position, wp.word, wp.phi, sel.estimate, CASE WHEN sel.estimate < 0 THEN 'neg' ELSE 'pos' END AS sign,
       greatest(10.0 * ln(chosen.prevalence), 0.0) AS max_size, printf('%.2e', sel.p_adjusted) AS p_label
FROM wp JOIN sel USING (topic) JOIN chosen USING (topic)"""), ["phi", "estimate", "max_size"]))
def q_wordcloud_ttest(spark, sf):
    """Word clouds of chosen topics from a t-test."""
    s = Study(spark, sf)
    res = W.topic_test(s.loadings_with(["quality"]), "quality", s.summary, test_method="t-test", multiple_comparison="fdr")
    return round_doubles(W.plot_wordclouds(s.summary, s.phi, res, p_threshold=1.1, plot_topics_idx=CLOUD_TOPICS))
