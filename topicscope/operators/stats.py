"""Statistical tests of every topic against an outcome.

Input is long-form loadings (doc_id, topic, weight) joined with outcome
columns on doc_id.  Each test is one aggregate over ``groupBy(topic, ...)``
(k or k*G rows) followed by closed-form expressions; p-values come from the
Catalyst t-distribution expression in ``functions.dist``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicscope.functions import padjust
from topicscope.functions.dist import t_pvalue_sql, t_quantile
from topicscope.functions.quantile import exact_quantile, exact_quantiles
from topicscope.staging import staged

Z975 = 1.959963984540054  # fixed value: standard normal 97.5 % quantile


def t_pvalue(t: str, df: str) -> Column:
    return F.expr(t_pvalue_sql(f"`{t}`", f"`{df}`", "spark"))


#: Error of the reported confidence intervals.
ALPHA = 0.05


def attach_outcomes(theta: DataFrame, outcomes: DataFrame, cols: list[str], id_col: str = "doc_id",
                    complete: bool = True) -> DataFrame:
    """Loadings joined with outcome columns on the document key (no positional binding).
    complete=True drops rows with a null/NaN in any of ``cols`` (complete cases)."""
    out = theta.join(outcomes.select(id_col, *cols), id_col)
    return out.dropna("any", subset=cols) if complete else out


def is_continuous(df: DataFrame, col: str, threshold: int = 50, approx: bool = False) -> DataFrame:
    cnt = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg((cnt > threshold).alias("is_continuous"), cnt.alias("n_distinct"))


def median_split(df: DataFrame, col: str, out: str = "split_group") -> DataFrame:
    """'Group1' when value >= median, else 'Group2' (median over the rows given)."""
    med = exact_quantile(df, col, 0.5)
    return df.withColumn(out, F.when(F.col(col) >= med, F.lit("Group1")).otherwise(F.lit("Group2")))


def quartile_split(df: DataFrame, col: str, out: str = "split_group") -> DataFrame:
    """Q1..Q4 by the 25/50/75 % quantiles (type 7); the lowest bound is included in Q1,
    each upper bound closes its interval."""
    q1, q2, q3 = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    c = F.col(col)
    return df.withColumn(out, F.when(c <= q1, "Q1").when(c <= q2, "Q2").when(c <= q3, "Q3").otherwise("Q4"))


def min_max_split(df: DataFrame, col: str, n: int, id_col: str = "doc_id", out: str = "split_group") -> DataFrame:
    """The n lowest ('min') and n highest ('max') rows by ``col`` (ties by id)."""
    lo = df.orderBy(F.col(col).asc(), F.col(id_col).asc()).limit(n).withColumn(out, F.lit("min"))
    hi = df.orderBy(F.col(col).desc(), F.col(id_col).asc()).limit(n).withColumn(out, F.lit("max"))
    return lo.unionByName(hi)


def group_moments(loadings: DataFrame, group_col: str) -> DataFrame:
    return (loadings.groupBy("topic", group_col)
            .agg(F.count("weight").alias("n"), F.avg("weight").alias("mean"), F.var_samp("weight").alias("var")))


def welch_ttest(loadings: DataFrame, group_col: str, method: str = "fdr", compat: bool = True) -> DataFrame:
    """Welch two-sample t-test of the loading for every pair of group values x topic.

    Pairs are (a, b) with a < b, named ``a_b``; t = mean_a - mean_b.  NULL
    statistics when a group has fewer than 2 rows or both variances are 0.
    ``conf_low``/``conf_high``: 95 % interval of the difference of means;
    ``d_low``/``d_high``: of Cohen's d, with the variance
    (n1 + n2) / (n1 n2) + d^2 / (2 (n1 + n2)) and n1 + n2 - 2 degrees of freedom.
    compat=True adjusts each p-value alone with n = number of groups;
    otherwise across topics within a pair.
    """
    mom = group_moments(loadings, group_col)
    g = mom.select(group_col).distinct()
    n_groups = g.agg(F.count(F.lit(1))).scalar()
    a = mom.select("topic", F.col(group_col).alias("group_1"), F.col("n").alias("n_1"),
                   F.col("mean").alias("mean_group_1"), F.col("var").alias("var_1"))
    b = mom.select("topic", F.col(group_col).alias("group_2"), F.col("n").alias("n_2"),
                   F.col("mean").alias("mean_group_2"), F.col("var").alias("var_2"))
    pairs = a.join(b, "topic").where(F.col("group_1") < F.col("group_2"))
    se2 = F.col("var_1") / F.col("n_1") + F.col("var_2") / F.col("n_2")
    ok = (F.col("n_1") >= 2) & (F.col("n_2") >= 2) & (se2 > 0)
    t = F.when(ok, (F.col("mean_group_1") - F.col("mean_group_2")) / F.sqrt(se2))
    df_ = F.when(ok, se2 * se2 / ((F.col("var_1") / F.col("n_1")) ** 2 / (F.col("n_1") - 1)
                                 + (F.col("var_2") / F.col("n_2")) ** 2 / (F.col("n_2") - 1)))
    pooled = F.sqrt(((F.col("n_1") - 1) * F.col("var_1") + (F.col("n_2") - 1) * F.col("var_2"))
                    / (F.col("n_1") + F.col("n_2") - 2))
    out = (pairs.select(
        F.concat_ws("_", F.col("group_1").cast("string"), F.col("group_2").cast("string")).alias("pair"),
        "topic", "group_1", "group_2", "n_1", "n_2", "mean_group_1", "mean_group_2",
        t.alias("t_stat"), df_.alias("df"),
        F.when(ok & (pooled > 0), (F.col("mean_group_1") - F.col("mean_group_2")) / pooled).alias("cohen_d"), F.when(ok, F.sqrt(se2)).alias("_se"))
        .withColumn("p_value", t_pvalue("t_stat", "df")))
    diff, reach = F.col("mean_group_1") - F.col("mean_group_2"), t_quantile(ALPHA, "df") * F.col("_se")
    n = F.col("n_1") + F.col("n_2")
    out = out.withColumn("_df_d", F.when(F.col("cohen_d").isNotNull(), (n - 2).cast("double")))
    d_reach = t_quantile(ALPHA, "_df_d") * F.sqrt(n / (F.col("n_1") * F.col("n_2")) + F.col("cohen_d") ** 2 / (2 * n))
    out = out.withColumns({"conf_low": diff - reach, "conf_high": diff + reach, "d_low": F.col("cohen_d") - d_reach,
                           "d_high": F.col("cohen_d") + d_reach}).drop("_se", "_df_d")
    if compat:
        return out.withColumn("p_adjusted", padjust.adjust_single(F.col("p_value"), n_groups, method))
    return padjust.adjust(out, method, family=["pair"])


def correlation_test(loadings: DataFrame, outcome: str, method: str = "bonferroni",
                     compat_family: Column | int | None = None) -> DataFrame:
    """Pearson correlation of each topic's loading with ``outcome``: r, df = n-2,
    t, two-sided p, Fisher-z 95 % interval (n > 3).  Adjusted across topics, or one
    p at a time with family size ``compat_family`` when given."""
    # corr() raises under ANSI mode when a topic has zero variance; NULL instead
    agg = loadings.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_samp("weight", outcome),
                     F.stddev_samp("weight") * F.stddev_samp(outcome)).alias("estimate"))
    agg = agg.withColumn("estimate", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("estimate"))))
    r = F.col("estimate")
    z = F.atanh(r)
    se = 1.0 / F.sqrt(F.col("n") - 3)
    out = (agg.select(
        "topic", "n", "estimate", (F.col("n") - 2).cast("double").alias("df"),
        F.when(F.abs(r) < 1, r * F.sqrt((F.col("n") - 2) / (1 - r * r))).when(F.col("n") > 2, r * float("inf")).alias("t_stat"),
        F.when(F.col("n") > 3, F.tanh(z - Z975 * se)).alias("conf_low"),
        F.when(F.col("n") > 3, F.tanh(z + Z975 * se)).alias("conf_high"))
        .withColumn("p_value", t_pvalue("t_stat", "df")))
    if compat_family is not None:
        return out.withColumn("p_adjusted", padjust.adjust_single(F.col("p_value"), compat_family, method))
    return padjust.adjust(out, method)


def zscore(df: DataFrame, value: str, by: list[str], out: str | None = None) -> DataFrame:
    """(x - mean) / sd within ``by`` (sd = sample sd); 0 where sd is 0 or x is null."""
    out = out or f"z_{value}"
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd")) if by else None
    if stats is not None:
        j = df.join(F.broadcast(stats), by)
    else:
        s = df.agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
        j = df.withColumn("_mu", s.select("_mu").scalar()).withColumn("_sd", s.select("_sd").scalar())
    return j.withColumn(out, F.coalesce(F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd")), F.lit(0.0))) \
        .drop("_mu", "_sd")


def simple_regression(loadings: DataFrame, y: str, x: str, variable: str, method: str = "fdr") -> DataFrame:
    """OLS of z(y) on z(x) per topic (intercept included): estimate, t, p with df = n-2,
    p adjusted across topics.  Nulls in the z-scored columns count as 0."""
    agg = loadings.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp(x, y).alias("_sxy"),
        F.var_samp(x).alias("_sxx"), F.var_samp(y).alias("_syy"))
    slope = F.try_divide(F.col("_sxy"), F.col("_sxx"))
    resid = (F.col("n") - 1) * (F.col("_syy") - slope * F.col("_sxy"))
    resid = F.try_divide(resid, F.col("n") - 2)
    se = F.sqrt(F.try_divide(resid, (F.col("n") - 1) * F.col("_sxx")))
    out = (agg.select("topic", F.lit(variable).alias("variable"), slope.alias("estimate"),
                      F.try_divide(slope, se).alias("t_value"), (F.col("n") - 2).cast("double").alias("_df"))
           .withColumn("p_value", t_pvalue("t_value", "_df")).drop("_df"))
    return padjust.adjust(out, method, family=["variable"])


def _z_loadings(loadings: DataFrame, cols: list[str], id_col: str = "doc_id") -> DataFrame:
    """z(topic loading) within each topic; z(control) over documents (one value per
    document, not per document x topic row)."""
    z = zscore(loadings, "weight", ["topic"], "z_topic")
    per_doc = loadings.select(id_col, *cols).dropDuplicates([id_col])
    moments = per_doc.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_sd_{c}") for c in cols])
    for c in cols:
        mu = moments.select(f"_mu_{c}").scalar()
        sd = moments.select(f"_sd_{c}").scalar()
        z = z.withColumn(f"z_{c}", F.coalesce(F.try_divide(F.col(c) - mu, sd), F.lit(0.0)))
    return z


def linear_regression(loadings: DataFrame, controls: list[str], method: str = "fdr", id_col: str = "doc_id") -> DataFrame:
    """z(topic) ~ z(c1) + ... per topic.  One control: closed form; two: closed form
    from the 2x2 normal equations; more: ``linear_regression_multi``."""
    z = _z_loadings(loadings, controls, id_col)
    if len(controls) == 1:
        return simple_regression(z, "z_topic", f"z_{controls[0]}", controls[0], method)
    if len(controls) == 2:
        return _two_control_regression(z, controls, method)
    return linear_regression_multi(z, controls, method)


def _two_control_regression(z: DataFrame, controls: list[str], method: str) -> DataFrame:
    x1, x2 = (f"z_{c}" for c in controls)
    agg = z.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.var_samp(x1).alias("s11"), F.var_samp(x2).alias("s22"), F.covar_samp(x1, x2).alias("s12"),
        F.covar_samp(x1, "z_topic").alias("s1y"), F.covar_samp(x2, "z_topic").alias("s2y"),
        F.var_samp("z_topic").alias("syy"))
    c = F.col
    det = c("s11") * c("s22") - c("s12") * c("s12")
    b1 = F.try_divide(c("s22") * c("s1y") - c("s12") * c("s2y"), det)
    b2 = F.try_divide(c("s11") * c("s2y") - c("s12") * c("s1y"), det)
    sigma2 = F.try_divide((c("n") - 1) * (c("syy") - b1 * c("s1y") - b2 * c("s2y")), c("n") - 3)
    se1 = F.sqrt(F.try_divide(sigma2 * c("s22"), (c("n") - 1) * det))
    se2 = F.sqrt(F.try_divide(sigma2 * c("s11"), (c("n") - 1) * det))
    rows = agg.select("topic", (c("n") - 3).cast("double").alias("_df"), F.explode(F.array(
        F.struct(F.lit(controls[0]).alias("variable"), b1.alias("estimate"), F.try_divide(b1, se1).alias("t_value")),
        F.struct(F.lit(controls[1]).alias("variable"), b2.alias("estimate"), F.try_divide(b2, se2).alias("t_value")),
    )).alias("r")).select("topic", "r.variable", "r.estimate", "r.t_value", "_df")
    out = rows.withColumn("p_value", t_pvalue("t_value", "_df")).drop("_df")
    return padjust.adjust(out, method, family=["variable"])


def linear_regression_multi(z: DataFrame, controls: list[str], method: str = "fdr") -> DataFrame:
    """Any number of controls: one aggregate of the cross-product matrix per topic
    (Gram matrix of [1, x...] and X'y), solved per topic row with numpy in a
    grouped-map over k rows."""
    import numpy as np
    import pandas as pd

    xs = [f"z_{c}" for c in controls]
    p = len(xs) + 1
    cols = [F.lit(1.0)] + [F.col(x) for x in xs]
    sums = [F.sum(cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(cols[i] * F.col("z_topic")).alias(f"xy_{i}") for i in range(p)]
    agg = z.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z_topic") ** 2).alias("yy"), *sums)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            g = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    g[i, j] = g[j, i] = r[f"g_{i}_{j}"]
            xy = np.array([r[f"xy_{i}"] for i in range(p)])
            n = int(r["n"])
            try:
                inv = np.linalg.inv(g)
                beta = inv @ xy
                rss = r["yy"] - beta @ xy
                dfree = n - p
                s2 = rss / dfree if dfree > 0 else np.nan
                se = np.sqrt(np.diag(inv) * s2)
            except np.linalg.LinAlgError:
                beta = np.full(p, np.nan)
                se = np.full(p, np.nan)
                dfree = n - p
            for k, cname in enumerate(controls, 1):
                out.append((r["topic"], cname, float(beta[k]), float(beta[k] / se[k]) if se[k] else np.nan, float(dfree)))
        return pd.DataFrame(out, columns=["topic", "variable", "estimate", "t_value", "_df"])

    topic_type = dict(agg.dtypes)["topic"]
    schema = f"topic {topic_type}, variable string, estimate double, t_value double, _df double"
    solved = agg.groupBy("topic").applyInPandas(solve, schema)
    out = solved.withColumn("t_value", F.when(~F.isnan("t_value"), F.col("t_value"))) \
        .withColumn("p_value", t_pvalue("t_value", "_df")).drop("_df")
    return padjust.adjust(out, method, family=["variable"])


def logistic_regression_compat(loadings: DataFrame, control: str, method: str = "fdr", id_col: str = "doc_id") -> DataFrame:
    """z(control) ~ z(topic) by least squares (the original fit uses the default
    Gaussian family): same r, t, p as the reverse regression."""
    z = _z_loadings(loadings, [control], id_col)
    return simple_regression(z, f"z_{control}", "z_topic", control, method)


def join_summary(results: DataFrame, summary: DataFrame, how: str = "left") -> DataFrame:
    """Attach topic summary columns; the summary is k rows, so it is broadcast."""
    return results.join(F.broadcast(summary), "topic", how)


def sort_stats(df: DataFrame) -> DataFrame:
    cols = [c for c in ("p_value", "p_adjusted", "topic") if c in df.columns]
    return df.orderBy(*cols)


def normal_two_sided(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) = erfc(|z| / sqrt 2) (Chebyshev erfc, relative error < 1.2e-7)."""
    x = F.abs(z) / F.lit(2 ** 0.5)
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the Numerical Recipes erfc approximation.
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


def logistic_binomial(loadings: DataFrame, outcome: str, max_rounds: int = 30, tolerance: float = 1e-10, method: str = "fdr") -> DataFrame:
    """True binomial fit y ~ z(topic) for every topic at once (Newton / IRLS): topic, estimate, z_value, p_value, p_adjusted.

    One state row a topic, in a written table; a round is one aggregate over the
    rows of the topics that still move (gradient and 2 x 2 information).  The
    standard error comes from the information at the estimate.  A topic that
    does not settle (separated groups, one outcome only) has NULLs.
    """
    z = zscore(loadings, "weight", ["topic"], "x").select("topic", "x", F.col(outcome).cast("double").alias("y"))
    z = staged(z.where(F.col("y").isNotNull()), "binomial-rows")
    zero = F.lit(0.0)
    state = staged(z.select("topic").distinct().select("topic", zero.alias("b0"), zero.alias("b1"), F.lit(False).alias("done"), zero.alias("se")), "binomial-state")
    for _ in range(max_rounds):
        moving = state.where(~F.col("done"))
        mu = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("x"))))
        w = mu * (1 - mu)
        agg = z.join(moving.select("topic", "b0", "b1"), "topic").groupBy("topic").agg(
            F.sum(F.col("y") - mu).alias("g0"), F.sum((F.col("y") - mu) * F.col("x")).alias("g1"),
            F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        d0 = F.try_divide(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), det)
        d1 = F.try_divide(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)
        moved = moving.drop("done", "se").join(agg, "topic").select(
            "topic", (F.col("b0") + d0).alias("b0"), (F.col("b1") + d1).alias("b1"),
            F.coalesce(F.greatest(F.abs(d0), F.abs(d1)) <= tolerance, F.lit(True)).alias("done"),   # no step: nothing to fit
            F.sqrt(F.try_divide(F.col("h00"), det)).alias("se"))
        state = staged(state.where("done").unionByName(moved), "binomial-state")
        if state.where("NOT done").isEmpty():
            break
    settled = F.col("done") & F.col("b1").isNotNull() & (F.col("se") < 1e6)
    out = state.select("topic", F.when(settled, F.col("b1")).alias("estimate"), F.when(settled, F.col("b1") / F.col("se")).alias("z_value"))
    return padjust.adjust(out.withColumn("p_value", normal_two_sided(F.col("z_value"))), method)


def cv_regression(features: DataFrame, label: str, folds: int = 5, reg: float = 0.1, seed: int = 1234,
                  id_col: str = "doc_id") -> DataFrame:
    """Ridge regression label ~ topic loadings, out-of-fold predictions over hash
    folds, then the correlation test of predicted vs observed (one row)."""
    from pyspark.ml.regression import LinearRegression

    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds))
    data = staged(features.select(id_col, label, "features", fold.alias("_fold")), "cv-features")   # every fold's fit reads it more than once
    preds = None
    for f in range(folds):
        m = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0,
                             standardization=True).fit(data.where(F.col("_fold") != f))
        p = m.transform(data.where(F.col("_fold") == f)).select(id_col, label, "prediction")
        preds = p if preds is None else preds.unionByName(p)
    agg = preds.agg(F.count(F.lit(1)).alias("n"),
                    F.try_divide(F.covar_samp("prediction", label),
                                 F.stddev_samp("prediction") * F.stddev_samp(label)).alias("estimate"))
    r = F.col("estimate")
    return (agg.select("n", "estimate", (F.col("n") - 2).cast("double").alias("df"),
                       F.when(F.abs(r) < 1, r * F.sqrt((F.col("n") - 2) / (1 - r * r))).when(F.col("n") > 2, r * float("inf")).alias("t_stat"))
            .withColumn("p_value", t_pvalue("t_stat", "df")))
