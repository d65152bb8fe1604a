"""URL filter by empirical-Bayes host reputation [DataFrame functions only].

Labelled page outcomes (good or bad) are counted per host.  A beta-binomial
prior is passed down the tree root -> suffix -> registered domain -> host: the
prior mean of a node is the posterior mean of its parent, and the prior's
strength at a level is the moment estimate of the beta-binomial intraclass
correlation over that level's nodes.  A host is allowed if the lower bound of
its posterior good rate (logit-normal approximation of the beta posterior)
reaches ``min_good``.  Explicit rules come first.

Defined results: a null url, or one without ``://``, has the empty host and
path; it is judged as the host ``''``.  Hosts without labels take their
domain's posterior, domains theirs from the suffix, and with no labels at all
the root prior ``prior_good`` with strength ``prior_n`` holds.  Repeated pages
are judged one by one.  Labels that are null count as missing; a page with
several labels counts each.  An empty table gives no rows, a very long url is one
row like any other.  Extra columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Strength of a level's prior when its groups show no or full spread.
STRENGTH_RANGE = (1.0, 10_000.0)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host.

    ``suffixes`` lists public suffixes of several labels (bounded, a parameter);
    else the suffix is the last label.  An IPv4 address is its own domain.
    """
    labels = F.split(host, r"\.")
    suffix = F.element_at(labels, -1)
    for s in sorted(suffixes, key=len):
        suffix = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(suffix)
    depth = F.size(F.split(suffix, r"\.")) + 1
    start = F.greatest(F.size(labels) - depth + 1, F.lit(1))
    domain = F.array_join(F.slice(labels, start, depth), ".")
    ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(ip, host).otherwise(domain), F.when(ip, F.lit("")).otherwise(suffix)


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls.

    ``rules``: (verdict, ``host/path``) pairs, a bounded parameter compiled into
    one expression.  A rule fits its host and all subdomains if the path starts
    with the rule's; of equal lengths the longer host wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]))):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, parent: str) -> DataFrame:
    """One row: prior strength M of a level from the spread of its groups around their parents.

    Moments of the beta-binomial (weights n), summed over all parents:
    rho = (S - m(1-m)(g-1)) / (m(1-m) (N - sum n^2/N - (g-1))), M = 1/rho - 1.
    """
    per = (groups.groupBy(parent)
           .agg(F.sum("n").alias("t"), F.sum("k").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"),
                F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.count("*").alias("g"))
           .withColumn("m", F.col("s") / F.col("t")))
    spread = F.col("kk") - F.col("s") * F.col("s") / F.col("t")
    v = F.col("m") * (1 - F.col("m"))
    agg = per.agg(F.sum(spread - v * (F.col("g") - 1)).alias("num"),
                  F.sum(v * (F.col("t") - F.col("q") / F.col("t") - (F.col("g") - 1))).alias("den"))
    low, high = STRENGTH_RANGE
    rho = F.try_divide("num", "den")
    m = F.when(rho.isNull() | (rho <= 0), F.lit(high)).when(rho >= 1, F.lit(low)).otherwise(1 / rho - 1)
    return agg.select(F.greatest(F.lit(low), F.least(F.lit(high), m)).alias("m"))


def host_reputation(hosts: DataFrame, *, prior_good: float = 0.5, prior_n: float = 2.0, z: float = 1.645,
                    suffixes: Sequence[str] = ()) -> DataFrame:
    """Posterior of each host.  ``hosts``: (host, n labelled, k good), one row per host, n may be 0.

    Returns host, n, k, domain, suffix, alpha, beta, good_rate, good_low.
    """
    domain, suffix = domain_of(F.col("host"), suffixes)
    h = hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix"))
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    root = s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    root = root.select(((F.col("k") + prior_good * prior_n) / (F.col("n") + prior_n)).alias("mu"))
    seen = F.col("n") > 0
    m_s = _strength(s.where(seen).withColumn("all", F.lit(1)), "all")
    m_d = _strength(d.where(seen), "suffix")
    m_h = _strength(h.where(seen), "domain")

    def post(groups: DataFrame, keys: list[str], strength: DataFrame) -> DataFrame:
        """``groups`` carries its parent's mean ``mu``; the strength is one row."""
        return (groups.crossJoin(F.broadcast(strength.withColumnRenamed("m", "prior_m")))
                .withColumn("alpha", F.col("prior_m") * F.col("mu") + F.col("k"))
                .withColumn("beta", F.col("prior_m") * (1 - F.col("mu")) + F.col("n") - F.col("k"))
                .select(*keys, "n", "k", "alpha", "beta",
                        (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("good_rate")))

    sp = post(s.crossJoin(F.broadcast(root)), ["suffix"], m_s).select("suffix", F.col("good_rate").alias("mu"))
    dp = post(d.join(sp, "suffix"), ["domain", "suffix"], m_d)
    hp = post(h.join(dp.select("domain", "suffix", F.col("good_rate").alias("mu")), ["domain", "suffix"]),
              ["host", "domain", "suffix"], m_h)
    low = 1 / (1 + F.exp(-(F.log(F.col("alpha") / F.col("beta")) - z * F.sqrt(1 / F.col("alpha") + 1 / F.col("beta")))))
    return hp.withColumn("good_low", low)


def judge_urls(pages: DataFrame, outcomes: DataFrame, *, page_col: str = "page_id", url_col: str = "url",
               outcome_id: str = "page_id", outcome_col: str = "good", rules: Sequence[tuple[str, str]] = (),
               min_good: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """Judge every url.  ``outcomes``: labelled pages (id, 1 good / 0 bad).

    Returns page id, host, path, rule, verdict, host_labels, good_rate, good_low.
    The page table joins the host table on ``host``; a host with a third of the
    pages is split by the adaptive skew join, and counts are pre-aggregated.
    """
    u = pages.select(F.col(page_col).alias("page_id"), url_host(F.col(url_col)).alias("host"),
                     url_path(F.col(url_col)).alias("path"))
    y = (outcomes.where(F.col(outcome_col).isNotNull() & F.col(outcome_id).isNotNull())
         .groupBy(F.col(outcome_id).alias("page_id"))
         .agg(F.count("*").alias("n"), F.sum(F.col(outcome_col).cast("long")).alias("k")))
    hosts = (u.select("page_id", "host").join(y, "page_id", "left")
             .groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")))
    rep = host_reputation(hosts, z=z, suffixes=suffixes).select(
        "host", F.col("n").alias("host_labels"), "good_rate", "good_low")
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("good_low") >= min_good, F.lit("allow")).otherwise(F.lit("block"))
    return (u.join(rep, "host", "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                    "host_labels", "good_rate", "good_low"))
