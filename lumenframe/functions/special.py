"""Special functions and distributions, vectorised in numpy, and p-value columns made of them.

The column forms are pandas functions over the few rows that an aggregate leaves, never over data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
erf = np.vectorize(math.erf, otypes=[float])
ln_gamma = _lgamma


def erfc(x):
    return 1 - erf(x)


def gamma(x):
    return np.exp(_lgamma(x))


def ln_beta(a, b):
    return _lgamma(a) + _lgamma(b) - _lgamma(np.add(a, b))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a power series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    # Lentz's method
    b, d, c = x + 1 - a, 1 / (x + 1 - a), 1e300
    h, i = d, 0
    while i < 10_000:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - scale * h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    # Lentz's method on 1 / (1 + t1 / (1 + t2 / ...))
    value, c, d = 1.0, 1.0, 0.0
    for i in range(1, 5000):
        m = i // 2
        if i % 2:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front / value


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """By bisection, to the last digits."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def chi2_cdf(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2)


def f_cdf(x: float, a: float, b: float) -> float:
    return 0.0 if x <= 0 else beta_inc(a / 2, b / 2, a * x / (a * x + b))


def _column(f):
    @F.pandas_udf("double")
    def apply(*xs: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*xs, strict=True)], dtype=float)

    return apply


def normal_two_sided(z):
    return _column(lambda x: math.erfc(abs(x) / math.sqrt(2)))(z)


def t_two_sided(t, df):
    return _column(lambda x, n: beta_inc(n / 2, 0.5, n / (n + x * x)))(t, df)


def chi2_upper(x, df):
    return _column(lambda a, n: 1 - chi2_cdf(a, n))(x, df)


def f_upper(x, a, b):
    return _column(lambda v, m, n: 1 - f_cdf(v, m, n))(x, a, b)
