"""SQL text (DuckDB dialect) mirroring the registered Spark queries.

An independent formulation of the same rules used as a correctness oracle:
tables are the pre-registered driver views.  Nothing here runs on Spark.
"""

from __future__ import annotations

from topicscope.functions.stopwords import SNOWBALL_EN
from topicscope.plans.study import LANG, TOP_M, TRIM_LEAST, TRIM_MOST


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = sql_list(SNOWBALL_EN)
WORD_RE = r"'\p{L}+'"


def tokens_sql(text: str = "text", stop: bool = True, min_len: int = 1) -> str:
    t = f"regexp_extract_all(lower({text}), {WORD_RE})"
    if stop:
        t = f"list_filter({t}, lambda x: x NOT IN ({STOP}))"
    if min_len > 1:
        t = f"list_filter({t}, lambda x: length(x) >= {min_len})"
    return t


def ngrams_sql(t: str, lo: int, hi: int, sep: str = "_") -> str:
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(t)
        else:
            parts.append(f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], '{sep}'))")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def r6(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6)"


def base_ctes(ngram=(1, 1), least=TRIM_LEAST, most=TRIM_MOST, lang=LANG) -> str:
    """CTEs: docs, toks, dtm_full, totals_full, kept, dtm, phi, rel, theta_sparse, topics, theta."""
    grams = ngrams_sql("t", ngram[0], ngram[1])
    conds = []
    if least is not None:
        conds.append(f"tf > {least}")
    if most is not None:
        conds.append(f"tf < {most}")
    where = " AND ".join(conds) or "TRUE"
    return f"""
docs AS (SELECT doc_id, text, source, n_chars FROM documents WHERE {"TRUE" if lang is None else f"lang = '{lang}'"}),
toks AS (SELECT doc_id, {tokens_sql()} AS t FROM docs),
grams AS (SELECT doc_id, unnest({grams}) AS term FROM toks),
dtm_full AS (SELECT doc_id, term, count(*)::BIGINT AS n FROM grams GROUP BY doc_id, term),
totals_full AS (SELECT term, sum(n)::BIGINT AS tf, count(*)::BIGINT AS df FROM dtm_full GROUP BY term),
kept AS (SELECT * FROM totals_full WHERE {where}),
dtm AS (SELECT d.doc_id, d.term, d.n FROM dtm_full d JOIN kept k ON d.term = k.term),
ct AS (SELECT docs.source AS topic, dtm.term, sum(dtm.n)::BIGINT AS tf FROM dtm JOIN docs USING (doc_id) GROUP BY 1, 2),
phi AS (SELECT topic, term, tf, tf / sum(tf) OVER (PARTITION BY topic) AS phi FROM ct),
rel AS (SELECT dtm.doc_id, dtm.term, dtm.n, dtm.n / kept.tf AS rel FROM dtm JOIN kept USING (term)),
theta_sparse AS (SELECT doc_id, topic, sum(rel * phi) AS weight FROM rel JOIN phi USING (term) GROUP BY 1, 2),
topics AS (SELECT DISTINCT topic FROM phi),
theta AS (SELECT g.doc_id, g.topic, coalesce(s.weight, 0.0) AS weight
          FROM (SELECT doc_id, topic FROM docs CROSS JOIN topics) g
          LEFT JOIN theta_sparse s ON g.doc_id = s.doc_id AND g.topic = s.topic),
top AS (SELECT * FROM (SELECT topic, term, phi, (row_number() OVER (PARTITION BY topic ORDER BY phi DESC, term))::INTEGER AS rank FROM phi) WHERE rank <= {TOP_M}),
prev AS (SELECT topic, s / sum(s) OVER () * 100 AS prevalence FROM (SELECT topic, sum(weight) AS s FROM theta GROUP BY topic)),
n_docs AS (SELECT count(*) AS n FROM docs)"""


def with_base(body: str, **kw) -> str:
    return f"WITH {base_ctes(**kw)}\n{body}"


def rounded(sql: str, cols) -> str:
    """Round the named DOUBLE columns of a full statement to 6 places."""
    rep = ", ".join(f"round(({c})::DOUBLE, 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql})"
