"""Distribution functions as column expressions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series in the SQL, and degree of the polynomial in the error function.
TERMS, ERFC_DEGREE = 120, 27


def _log_scaled_erfc(u: float) -> float:
    """ln(erfc(z) exp(z^2) / t) for z >= 0 with t = 2 / (2 + z) = (u + 1) / 2."""
    t = (u + 1) / 2
    if t < 1e-12:
        return math.log(0.5 / math.sqrt(math.pi))
    z = 2 / t - 2
    if z < 3:
        return math.log(math.erfc(z) / t) + z * z
    f = z  # continued fraction of the scaled function, from the far end
    for k in range(200, 0, -1):
        f = z + k / 2 / f
    return -math.log(f * math.sqrt(math.pi) * t)


@lru_cache(maxsize=1)
def _erfc_terms() -> tuple[float, ...]:
    """Coefficients in powers of u, lowest first, by interpolation in Chebyshev points."""
    fit = np.polynomial.chebyshev.chebinterpolate(np.vectorize(_log_scaled_erfc), ERFC_DEGREE)
    return tuple(np.polynomial.chebyshev.cheb2poly(fit).tolist())


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0, as plain arithmetic."""
    t = 2 / (2 + z)
    u = 2 * t - 1
    terms = _erfc_terms()
    p = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        p = p * u + c
    return t * F.exp(p - z * z)


def chi2_cdf(x: Column, df: int) -> Column:
    """P(X <= x) for chi-square with ``df`` degrees of freedom: a finite sum, for odd ``df``
    beside the error function.  ``x`` should be a column of its own: it is used often."""
    h = F.greatest(x, F.lit(0.0)) / 2
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, df // 2):
            term = term * h / i
            total = total + term
        return 1 - F.exp(-h) * total
    z = F.sqrt(h)
    out = 1 - erfc(z)
    if df > 1:
        term = z / math.gamma(1.5)
        total = term
        for i in range(1, (df - 1) // 2):
            term = term * h / (i + 0.5)
            total = total + term
        out = out - F.exp(-h) * total
    return F.when(h <= 0, 0.0).otherwise(F.greatest(out, F.lit(0.0)))


def chi2_cdf_sql(x: str, df: int) -> str:
    """The same in DuckDB SQL."""
    h = f"(greatest({x}, 0.0) / 2)"
    if df % 2 == 0:
        total = " + ".join(["1.0"] + [f"pow({h}, {i}) / {math.factorial(i)}.0" for i in range(1, df // 2)])
        return f"(1 - exp(-{h}) * ({total}))"
    a = df / 2
    total = f"list_sum([exp(k * ln({h}) - (lgamma({a} + k + 1) - lgamma({a} + 1))) FOR k IN range(0, {TERMS + 1})])"
    return f"(CASE WHEN {h} <= 0 THEN 0.0 WHEN {h} > 40 THEN 1.0 ELSE least(exp({a} * ln({h}) - {h} - lgamma({a} + 1)) * {total}, 1.0) END)"


def normal_cdf(x: Column) -> Column:
    tail = erfc(F.abs(x) / math.sqrt(2)) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


# ------------------------------------------------------------- on the driver, for single numbers


def beta_inc(x: float, a: float, b: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = 0.0
    for m in range(400, 0, -1):
        k = m // 2
        d = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        f = d / (1 + f)
    return front / (1 + f)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_inc(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0


def t_cdf(x: float, df: float) -> float:
    tail = beta_inc(df / (df + x * x), df / 2, 0.5) / 2
    return 1 - tail if x > 0 else tail


def gamma_p(a: float, x: float) -> float:
    """The regularized lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))
    f = x + 1e-300
    for k in range(300, 0, -1):
        f = x + (k - a) / (1 + k / f)
    return 1 - math.exp(a * math.log(x) - x - math.lgamma(a)) / f


def quantile(cdf, p: float, lo: float, hi: float) -> float:
    """Where an increasing ``cdf`` reaches p, by bisection."""
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_quantile(p: float, df: float) -> float:
    return quantile(lambda x: gamma_p(df / 2, x / 2), p, 0.0, df + 40 * math.sqrt(df) + 100)


def normal_quantile(p: float) -> float:
    return quantile(lambda x: math.erfc(-x / math.sqrt(2)) / 2, p, -40.0, 40.0)


def digamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
