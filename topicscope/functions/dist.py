"""Student-t and normal distribution functions as SQL expressions.

The two-sided Student-t p-value is the regularised incomplete beta
function I_x(df/2, 1/2) with x = df/(df+t^2).  It is written as a plain
expression (a continued fraction folded with a higher-order function and a
Lanczos log-gamma), so it runs inside the JVM on Spark and the same text,
rendered for DuckDB, serves as an independent oracle.  Every helper here
returns SQL text for one of two dialects: ``"spark"`` or ``"duckdb"``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos approximation, g = 7, nine coefficients (published
# constants of the approximation, as in Numerical Recipes / Godfrey).
LANCZOS_G = 7.0
LANCZOS_COEF = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
CF_TERMS = 600
#: Larger degrees of freedom are mapped to this one.
DF_MAX = 1e5
HALF_LN_2PI = 0.91893853320467274178


def _num(v: float) -> str:
    """Double literal in both dialects (Spark reads ``0.5`` as DECIMAL)."""
    return f"{float(v):.17e}"


ONE, HALF, TWO = _num(1.0), _num(0.5), _num(2.0)


def lgamma_sql(z: str) -> str:
    """ln Gamma(z) for z >= 0.5 (all uses here: z = df/2, 1/2, df/2 + 1/2)."""
    zz = f"(({z}) - {ONE})"
    series = " + ".join(
        [_num(LANCZOS_COEF[0])] + [f"{_num(c)} / ({zz} + {_num(i)})" for i, c in enumerate(LANCZOS_COEF[1:], 1)]
    )
    t = f"({zz} + {_num(LANCZOS_G + 0.5)})"
    return f"({_num(HALF_LN_2PI)} + ({zz} + {HALF}) * ln({t}) - {t} + ln({series}))"


def _fold(dialect: str, a: str, b: str, x: str) -> str:
    """Backward evaluation of the continued fraction of I_x(a, b):
    acc_j = 1 + d_j / acc_{j+1}, j = N..1, starting from acc = 1."""
    jd = "CAST(j AS DOUBLE)"
    m_even = f"({jd} / {TWO})"
    m_odd = f"(({jd} - {ONE}) / {TWO})"
    den = f"(({a} + {jd} - {ONE}) * ({a} + {jd}))"
    even = f"({m_even} * ({b} - {m_even}) * {x} / {den})"
    odd = f"(-({a} + {m_odd}) * ({a} + {b} + {m_odd}) * {x} / {den})"
    step = f"{ONE} + (CASE WHEN j % 2 = 0 THEN {even} ELSE {odd} END) / acc"
    if dialect == "spark":
        return f"aggregate(sequence({CF_TERMS}, 1, -1), {ONE}, (acc, j) -> {step})"
    return f"list_reduce(range({CF_TERMS}, 0, -1), lambda acc, j: {step}, {ONE})"


def inc_beta_sql(dialect: str, a: str, b: str, x: str, rest: str) -> str:
    """Regularised incomplete beta I_x(a, b) for 0 < x < 1 (no symmetry swap).

    ``rest`` is 1 - x, given on its own so that it does not cancel.  DuckDB
    uses its own ``lgamma``, which keeps the oracle independent of the series here.
    """
    lg = (lambda z: f"lgamma({z})") if dialect == "duckdb" else lgamma_sql
    lbeta = f"({lg(a)} + {lg(b)} - {lg(f'({a}) + ({b})')})"
    front = f"exp(({a}) * ln({x}) + ({b}) * ln({rest}) - {lbeta}) / ({a})"
    return f"({front} / {_fold(dialect, a, b, x)})"


def t_pvalue_sql(t: str, df: str, dialect: str = "spark") -> str:
    """Two-sided p-value of a Student-t statistic with (possibly fractional) df."""
    # beyond DF_MAX: the statistic of equal normal quantile at DF_MAX degrees of freedom
    z = f"(({t}) * ({ONE} - (({t}) * ({t}) + {ONE}) / ({_num(4.0)} * ({df}))))"
    top = _num(DF_MAX)
    t0 = f"({z} * ({ONE} + ({z} * {z} + {ONE}) / ({_num(4.0)} * {top}) + ({_num(5.0)} * {z} * {z} * {z} * {z} + {_num(16.0)} * {z} * {z} + {_num(3.0)}) / ({_num(96.0)} * {top} * {top})))"
    near = _p_sql(t, f"({df})", dialect)
    far = _p_sql(t0, top, dialect)
    return (
        f"(CASE WHEN ({t}) IS NULL OR ({df}) IS NULL OR ({df}) <= 0 OR isnan({t}) THEN NULL "
        f"WHEN ({t}) = 0 THEN {ONE} WHEN abs({t}) > {_num(1e150)} THEN {_num(0.0)} "
        f"WHEN ({df}) > {top} THEN (CASE WHEN abs({t}) > {_num(38.0)} THEN {_num(0.0)} ELSE {far} END) ELSE {near} END)"
    )


def _p_sql(t: str, df: str, dialect: str) -> str:
    """p of a finite non-zero statistic; the tail beyond |t| that suits the size of x."""
    x = f"({df} / ({df} + {t} * {t}))"
    rest = f"({t} * {t} / ({df} + {t} * {t}))"
    a = f"({df} / {TWO})"
    direct = inc_beta_sql(dialect, a, HALF, x, rest)
    swapped = f"({ONE} - {inc_beta_sql(dialect, HALF, a, rest, x)})"
    return (
        f"(CASE WHEN {x} < (({a}) + {ONE}) / (({a}) + {_num(2.5)}) THEN {direct} "
        f"ELSE {swapped} END)"
    )


def t_pvalue(t: Column | str, df: Column | str) -> Column:
    """Spark Column: two-sided Student-t p-value."""
    tn = t if isinstance(t, str) else None
    dn = df if isinstance(df, str) else None
    if tn is None or dn is None:
        raise TypeError("pass column names; use t_pvalue_sql for expressions")
    return F.expr(t_pvalue_sql(f"`{tn}`", f"`{dn}`", "spark"))


NEWTON_STEPS = 10
Z_START = 1.959963984540054
LN_PI = 1.1447298858494002


def t_quantile_sql(p: float, df: str, dialect: str = "spark") -> str:
    """The statistic whose two-sided p-value is ``p`` (at most 0.05) with ``df`` >= 1 degrees of freedom.

    Newton steps on ln p as a function of ln t, from the normal quantile; the
    function is concave, so after the first step they come from one side.
    """
    lg = (lambda z: f"lgamma({z})") if dialect == "duckdb" else lgamma_sql
    t = "exp(u)"
    half = f"(({df}) / {TWO})"
    upper = f"(({df}) + {ONE}) / {TWO}"
    density = (f"exp({lg(upper)} - {lg(half)} - {HALF} * (ln({df}) + {_num(LN_PI)}) - {upper} * ln({ONE} + {t} * {t} / ({df})))")
    tail = t_pvalue_sql(t, f"({df})", dialect)
    step = f"(ln(p) - {_num(math.log(p))}) * p / ({TWO} * {density} * {t})"
    start = _num(math.log(Z_START))
    if dialect == "spark":
        inner = f"aggregate(array({tail}), {_num(0.0)}, (z, p) -> {step})"
        return f"exp(aggregate(sequence(1, {NEWTON_STEPS}), {start}, (u, i) -> u + {inner}))"
    inner = f"list_reduce([{tail}], lambda z, p: {step}, {_num(0.0)})"
    return f"exp(list_reduce(range(1, {NEWTON_STEPS + 1}), lambda u, i: u + {inner}, {start}))"


def t_quantile(p: float, df: str) -> Column:
    """Spark Column: the two-sided ``p`` quantile for the column ``df``; NULL where df is NULL or below 1."""
    return F.when(F.col(df) >= 1, F.expr(t_quantile_sql(p, f"`{df}`", "spark")))
