"""Result tables behind word clouds and the topic browser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453  # fixed value: ln 2


def explode_top_terms(summary: DataFrame) -> DataFrame:
    """(topic, position, word) from the comma-joined ``top_terms`` string."""
    return summary.select("topic", F.posexplode(F.split("top_terms", ", ")).alias("pos", "word")) \
        .select("topic", (F.col("pos") + 1).alias("position"), "word")


def assign_phi(words: DataFrame, phi: DataFrame) -> DataFrame:
    """phi of every (topic, word); NULL when the word is not in the topic's vocabulary."""
    return words.join(phi.select("topic", F.col("term").alias("word"), "phi"), ["topic", "word"], "left")


def wordcloud_table(words_phi: DataFrame, results: DataFrame, summary: DataFrame,
                    p_threshold: float | None = None, scale_size: bool = True, topic_index: list[int] | None = None) -> DataFrame:
    """Words of the selected topics with colour class and size scale, for the results of any test.

    A topic is kept when its adjusted p is not NaN/NULL and below ``p_threshold``
    (no threshold: every such topic) and its place among the sorted topics, from
    1, is in ``topic_index`` (None: all).  The estimate is the test's own, or
    Cohen's d of a t-test, with one set of words for each pair of groups or
    variable; sign = 'neg' for a negative one; max_size = 10 ln(prevalence), at
    least 0 (or 10 without size scaling); p shown as %.2e.
    """
    r = results.where(F.col("p_adjusted").isNotNull() & ~F.isnan("p_adjusted"))
    if "estimate" not in r.columns:
        r = r.withColumn("estimate", F.col("cohen_d"))
    if p_threshold is not None:
        r = r.where(F.col("p_adjusted") < p_threshold)
    kept = summary.select("topic", "prevalence")                     # one row a topic
    if topic_index is not None:
        place = F.row_number().over(Window.orderBy("topic"))
        kept = kept.withColumn("_place", place).where(F.col("_place").isin([int(i) for i in topic_index])).drop("_place")
    size = F.greatest(F.lit(10.0) * F.ln("prevalence"), F.lit(0.0)) if scale_size else F.lit(10.0)
    which = [c for c in ("pair", "variable") if c in r.columns]
    return (words_phi.join(F.broadcast(r.select("topic", *which, "estimate", "p_adjusted")), "topic")
            .join(F.broadcast(kept), "topic")
            .select("topic", *which, "position", "word", "phi", "estimate",
                    F.when(F.col("estimate") < 0, "neg").otherwise("pos").alias("sign"),
                    size.alias("max_size"), F.format_string("%.2e", "p_adjusted").alias("p_label")))


def term_relevance(phi: DataFrame, term_freq: DataFrame, lam: float = 0.6) -> DataFrame:
    """relevance = lam ln(phi) + (1 - lam) ln(phi / p(w)), p(w) = term total / all tokens."""
    total = term_freq.agg(F.sum("tf")).scalar()          # scalar, not a window over the whole vocabulary
    pw = term_freq.select("term", (F.col("tf") / total).alias("p_w"))
    return (phi.join(pw, "term")
            .select("topic", "term", "phi", (F.lit(lam) * F.ln("phi") + F.lit(1 - lam) * F.ln(F.col("phi") / F.col("p_w"))).alias("relevance")))


def topic_js_distance(phi: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence between every pair of topic-term distributions.

    Only terms shared by both topics need a join (a term has at most k topic
    rows); a term held by one topic alone contributes 0.5 p ln 2, which is
    folded in from the shared mass: JS = 0.5 ln2 (2 - P_shared - Q_shared) + sum_shared(...).
    """
    a = phi.select(F.col("topic").alias("topic_1"), "term", F.col("phi").alias("p"))
    b = phi.select(F.col("topic").alias("topic_2"), "term", F.col("phi").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    shared = (a.join(b, "term").where(F.col("topic_1") < F.col("topic_2"))
              .groupBy("topic_1", "topic_2")
              .agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"),
                   F.sum(0.5 * F.col("p") * F.ln(F.col("p") / m) + 0.5 * F.col("q") * F.ln(F.col("q") / m)).alias("kl")))
    tops = phi.select("topic").distinct()
    pairs = (tops.select(F.col("topic").alias("topic_1"))
             .join(F.broadcast(tops.select(F.col("topic").alias("topic_2"))), F.col("topic_1") < F.col("topic_2")))
    j = pairs.join(shared, ["topic_1", "topic_2"], "left")
    js = (F.lit(0.5 * LN2) * (2 - F.coalesce("ps", F.lit(0.0)) - F.coalesce("qs", F.lit(0.0)))
          + F.coalesce("kl", F.lit(0.0)))
    return j.select("topic_1", "topic_2", js.alias("js_divergence"))
