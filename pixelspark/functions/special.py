"""Normal and chi-square tails in log space (SCL-21), in numpy; Arrow UDFs over them."""

from __future__ import annotations

from math import erfc, exp, expm1, inf, lgamma, log, log1p, nan, pi, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_2PI = log(2 * pi)


def log_normal_cdf(x: float) -> float:
    """log of the standard normal distribution function."""
    if x > -30:
        p = 0.5 * erfc(-x / sqrt(2))
        return log(p) if x < 5 else log1p(-0.5 * erfc(x / sqrt(2)))
    # asymptotic series of the tail
    z = 1 / (x * x)
    return -0.5 * x * x - 0.5 * LOG_2PI - log(-x) + log1p(-z * (1 - 3 * z * (1 - 5 * z)))


def normal_quantile_log(logp: float) -> float:
    """x with log_normal_cdf(x) == logp, by Newton steps on the log scale."""
    if logp >= 0:
        return inf if logp == 0 else nan
    if logp == -inf:
        return -inf
    if logp > log(0.5):  # upper half through the complement
        q = -expm1(logp)
        return -normal_quantile_log(log(q)) if q > 0 else inf
    x = -sqrt(max(0.0, -2 * logp - log(max(1e-300, -2 * logp)) - LOG_2PI)) if logp < -3 else -0.5
    for _ in range(60):
        f = log_normal_cdf(x)
        slope = exp(-0.5 * x * x - 0.5 * LOG_2PI - f)
        step = (f - logp) / slope
        x -= step
        if abs(step) < 1e-13 * max(1, abs(x)):
            break
    return x


def _log_gamma_pq(a: float, x: float) -> tuple[float, float]:
    """log of the regularised incomplete gamma functions P and Q."""
    if x <= 0:
        return -inf, 0.0
    front = -x + a * log(x) - lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(100_000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-16:
                break
        logp = min(0.0, front + log(total))
        return logp, log1p(-exp(logp)) if logp < 0 else -inf
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    logq = min(0.0, front + log(h))
    return log1p(-exp(logq)) if logq < 0 else -inf, logq


def chi2_to_sigma(chi2: float, df: float) -> float:
    """Normal quantile of the chi-square distribution function, without losing the far tail."""
    if chi2 is None or df is None or not df > 0 or chi2 != chi2:
        return nan
    logp, logq = _log_gamma_pq(df / 2, chi2 / 2)
    return -normal_quantile_log(logq) if logq < logp else normal_quantile_log(logp)


def significance(chi2: str | Column, df: str | Column) -> Column:
    """The ``signif`` column; an Arrow UDF, one call a batch of segments."""

    @F.pandas_udf("double")
    def run(c: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([chi2_to_sigma(a, b) for a, b in zip(c, n, strict=True)], dtype="float64")

    return run(chi2, df)


def normal_quantile(p: str | Column) -> Column:
    @F.pandas_udf("double")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([normal_quantile_log(log(v)) if v is not None and 0 < v < 1 else nan for v in c], dtype="float64")

    return run(p)
