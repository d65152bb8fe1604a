"""Vocabulary statistics and trimming.

Ranking the vocabulary never sorts it in one task: ``rank_terms`` places the
terms by range of (tf desc, term) over all tasks (``functions.ranks``), so no
value of tf and no prefix gathers in one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicscope.functions import ranks
from topicscope.functions.quantile import exact_quantiles


def rank_terms(totals: DataFrame) -> DataFrame:
    """Add ``rank`` (1 = most frequent, ties by term ascending) and
    ``vocab_size`` to a (term, tf, ...) table."""
    return ranks.ranked(totals, F.desc("tf"), F.asc("term"), name="ranked-terms", total="vocab_size")


def removal_count(vocab_size: Column, n: float, kind: str, mode: str, compat: bool = True) -> Column:
    """How many terms a rank-based removal drops (see SURVEY §2.4 table).

    compat=True reproduces the original 1-based slicing: most/absolute n>=2
    drops n-1, least/percent drops round(N*p)+1, most/percent at least 1.
    """
    if mode not in ("absolute", "percent"):
        raise ValueError("removal mode must be 'absolute' or 'percent'")
    if kind not in ("most", "least"):
        raise ValueError("kind must be 'most' or 'least'")
    if mode == "absolute":
        n = int(n)
        if not compat:
            return F.lit(n)
        return F.lit(1 if (kind == "most" and n <= 1) else (n - 1 if kind == "most" else n))
    r = F.bround(vocab_size * F.lit(float(n)), 0).cast("bigint")
    if not compat:
        return r
    return F.greatest(r, F.lit(1)) if kind == "most" else r + 1


def removal_terms(ranked: DataFrame, n: float, kind: str, mode: str = "absolute", compat: bool = True) -> DataFrame:
    cnt = removal_count(F.col("vocab_size"), n, kind, mode, compat)
    cond = F.col("rank") <= cnt if kind == "most" else F.col("rank") > F.col("vocab_size") - cnt
    return ranked.where(cond)


def removal_frequency(ranked: DataFrame, p: float, kind: str) -> DataFrame:
    """tf at index round(N*p) ("most") or N - round(N*p) ("least"); no row when the index is 0."""
    r = F.bround(F.col("vocab_size") * F.lit(float(p)), 0).cast("bigint")
    idx = r if kind == "most" else F.col("vocab_size") - r
    return ranked.where(F.col("rank") == idx).select(F.col("tf").alias("removal_frequency"))


def keep_by_rank(ranked: DataFrame, least: float = 0, most: float = 0, mode: str = "absolute",
                 compat: bool = True) -> DataFrame:
    """Terms left after removing the least and the most frequent, both ranked on the
    same (untrimmed) table."""
    cond = F.lit(True)
    if least and least > 0:
        cond = cond & (F.col("rank") <= F.col("vocab_size") - removal_count(F.col("vocab_size"), least, "least", mode, compat))
    if most and most > 0:
        cond = cond & (F.col("rank") > removal_count(F.col("vocab_size"), most, "most", mode, compat))
    return ranked.where(cond)


def keep_by_threshold(totals: DataFrame, least=None, most=None) -> DataFrame:
    """Strict bounds on the total count; a None bound is not applied."""
    cond = F.lit(True)
    if least is not None:
        cond = cond & (F.col("tf") > least)
    if most is not None:
        cond = cond & (F.col("tf") < most)
    return totals.where(cond)


def keep_by_occurrence(totals: DataFrame, n_docs: Column, rate: float) -> DataFrame:
    """total > round(n_docs * rate) - 1 (total count, not document frequency)."""
    if rate <= 0:
        return totals
    return totals.where(F.col("tf") > F.bround(n_docs * F.lit(float(rate)), 0) - 1)


def occ_cutoff(vocab_size: Column, rate: float) -> Column:
    return F.bround(vocab_size * F.lit(float(rate)), 0).cast("bigint")


def keep_by_quantile(totals: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Bounds = round-half-even of the lo/hi quantiles (type 7) over the distinct totals; strict."""
    lo_v, hi_v = exact_quantiles(totals.select("tf").distinct(), "tf", [lo, hi])
    return totals.where((F.col("tf") > F.bround(lo_v, 0)) & (F.col("tf") < F.bround(hi_v, 0)))


def keep_by_doc_freq(totals: DataFrame, n_docs: Column, no_below: int = 5, no_above: float = 0.5) -> DataFrame:
    """Document-frequency window: df >= no_below and df <= no_above * N."""
    return totals.where((F.col("df") >= no_below) & (F.col("df") <= F.lit(float(no_above)) * n_docs))


def restrict(dtm: DataFrame, terms: DataFrame) -> DataFrame:
    """DTM rows whose term survived.  The vocabulary is the hashed side, so the rows are
    not sorted; AQE splits a term that many rows hold."""
    return dtm.join(terms.select("term").hint("shuffle_hash"), "term", "left_semi")


def relative_frequency(dtm: DataFrame, totals: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n / (term total over all documents); 0 when the total is 0."""
    return (dtm.join(totals.select("term", "tf"), "term")
            .select(id_col, "term", "n",
                    F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("tf")), F.lit(0.0)).alias("rel")))
