"""Statistics as Columns; nulls are left out unless a function says otherwise.

Aggregates give null on empty input; with a required condition broken they give null too.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of a published Chebyshev fit to erfc, constant term first.
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(z: Column) -> Column:
    """The complementary error function to 1.2e-7; zero counts as negative."""
    a = F.abs(z)
    t = 1 / (1 + 0.5 * a)
    poly = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = c + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(z > 0, ans).otherwise(2 - ans)


def standard_error(x: Column, all_rows: bool = True) -> Column:
    """Population deviation by the root of the number of rows, nulls included if ``all_rows``."""
    return F.stddev_pop(x) / F.sqrt(F.count("*") if all_rows else F.count(x))


def pearson(x: Column, y: Column) -> Column:
    """Struct (r, p, n) over rows with both; p is by the normal approximation."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(F.when(both, 1))
    r = F.when((n > 1) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))
    return F.struct(r.alias("r"), erfc(F.abs(r) * F.sqrt(n) / math.sqrt(2)).alias("p"), n.alias("n"))


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_pdf(x: Column, alpha: float, beta: float, low: float, high: float) -> Column:
    """Density of a Beta distribution stretched to [low, high]; 0 outside."""
    u = (x - low) / (high - low)
    density = F.pow(u, F.lit(alpha - 1)) * F.pow(1 - u, F.lit(beta - 1)) / (math.exp(log_beta(alpha, beta)) * (high - low))
    return F.when((x < low) | (x > high), 0.0).otherwise(density)


def beta_pdf_derivative(x: Column, alpha: float, beta: float, low: float, high: float) -> Column:
    u, w = (x - low) / (high - low), high - low
    slope = (alpha - 1) * F.pow(u, F.lit(alpha - 2)) * F.pow(1 - u, F.lit(beta - 1)) - (beta - 1) * F.pow(u, F.lit(alpha - 1)) * F.pow(1 - u, F.lit(beta - 2))
    return F.when((x < low) | (x > high), 0.0).otherwise(slope / (math.exp(log_beta(alpha, beta)) * w * w))


def beta_parameters(center: Column, total: float, low: float, high: float, kind: str = "MODE") -> Column:
    """Struct (alpha, beta) with a sum of ``total`` and the given mean or mode."""
    share = (center - low) / (high - low)
    alpha = share * total if kind == "MEAN" else share * (total - 2) + 1
    return F.struct(alpha.alias("alpha"), (F.lit(float(total)) - alpha).alias("beta"))


def fit_exponential(x: Column, y: Column) -> Column:
    """Struct (a, b) of y = a exp(b x), least squares of ln y weighted by y."""
    s = lambda c: F.sum(c)
    w, wx, wxx, wl, wxl = s(y), s(x * y), s(x * x * y), s(y * F.log(y)), s(x * y * F.log(y))
    d = w * wxx - wx * wx
    return F.struct(F.exp((wxx * wl - wx * wxl) / F.nullif(d, F.lit(0.0))).alias("a"), ((w * wxl - wx * wl) / F.nullif(d, F.lit(0.0))).alias("b"))


def geometric(x: Column) -> Column:
    """Struct (mean, deviation, error) of positive values on the geometric scale."""
    log = F.log(x)
    return F.struct(F.exp(F.avg(log)).alias("gm"), F.exp(F.stddev_pop(log)).alias("gsd"), F.exp(F.stddev_pop(log) / F.sqrt(F.count(x))).alias("gse"))


def welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Struct (t, df) of two samples with means m, sample variances v and sizes n."""
    a, b = v1 / n1, v2 / n2
    return F.struct(((m1 - m2) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))).alias("df"))


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - log_beta(a, b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def two_sided(t: float | None, df: float | None) -> float | None:
    return None if t is None or df is None else incomplete_beta(df / (df + t * t), df / 2, 0.5)


def welch_p(t: Column, df: Column) -> Column:
    """Two-sided P-value of Welch's t; null where t or the degrees of freedom are undefined."""

    def values(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(n) else two_sided(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")

    return F.pandas_udf(values, "double")(t, df)
