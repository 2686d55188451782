"""Probability distributions: density, cumulative probability, quantile, moments and reproducible samples.

Each works on numpy arrays, and on columns through on_column(), which sends a column in Arrow batches. Samples are quantiles of a
uniform number hashed from a key column, so a row has the same sample in every run and on every cluster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import special as S

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])
_gamma_p = np.vectorize(S.gamma_p, otypes=[float])
_beta_inc = np.vectorize(S.beta_inc, otypes=[float])


def _log_choose(n, k):
    return _lgamma(np.add(n, 1)) - _lgamma(np.add(k, 1)) - _lgamma(np.subtract(n, k) + 1)


class Distribution:
    """What all distributions share. Subclasses give support, pdf (a mass, if discrete), cdf, mean and variance."""

    discrete = False
    support = (-math.inf, math.inf)

    def pdf(self, x) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        inside = (x >= self.support[0]) & (x <= self.support[1]) & ((x == np.floor(x)) if self.discrete else True)
        safe = np.where(inside, x, self._inner())
        with np.errstate(all="ignore"):
            return np.where(np.isnan(x), np.nan, np.where(inside, np.exp(self.log_density(safe)), 0.0))

    def _inner(self) -> float:
        low, high = self.support
        return low + 1 if math.isinf(high) and not math.isinf(low) else (low + high) / 2 if not math.isinf(high) and not self.discrete else max(low, 0.0)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def cumulative(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def cdf(self, x) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        low, high = self.support
        inside = (x >= low) & (x < high)
        with np.errstate(all="ignore"):
            return np.where(np.isnan(x), np.nan, np.where(inside, self.cumulative(np.floor(np.where(inside, x, self._inner())) if self.discrete else np.where(inside, x, self._inner())), (x >= high).astype(float)))

    def ppf(self, p) -> np.ndarray:
        """The least x whose cumulative probability reaches p, by doubling and bisection; NaN outside [0, 1]."""
        p = np.atleast_1d(np.asarray(p, dtype=float))
        good = (p > 0) & (p < 1)
        q = np.where(good, p, 0.5)
        low, high = (np.full(q.shape, b) for b in (self.support[0] if math.isfinite(self.support[0]) else -1.0, self.support[1] if math.isfinite(self.support[1]) else 1.0))
        for _ in range(1100):
            wide = (self.cdf(low) >= q) & math.isinf(self.support[0])
            if not wide.any():
                break
            low = np.where(wide, 2 * low, low)
        for _ in range(1100):
            wide = (self.cdf(high) < q) & math.isinf(self.support[1])
            if not wide.any():
                break
            high = np.where(wide, 2 * high + 1, high)
        if self.discrete:
            low, high = np.floor(low) - 1, np.ceil(high)
        for _ in range(200):
            mid = np.floor((low + high) / 2) if self.discrete else (low + high) / 2
            below = self.cdf(mid) < q
            low, high = np.where(below, mid, low), np.where(below, high, mid)
            if (high - low <= 1).all() if self.discrete else (high - low <= 1e-15 * np.maximum(1e-300, np.abs(high))).all():
                break
        edge = np.where(p == 0, self.support[0], np.where(p == 1, self.support[1], np.nan))
        return np.where(good, high, edge)

    def sample(self, uniforms) -> np.ndarray:
        return self.ppf(uniforms)


@dataclass(frozen=True)
class Uniform(Distribution):
    low: float = 0.0
    high: float = 1.0

    @property
    def support(self):
        return self.low, self.high

    def log_density(self, x):
        return np.full(np.shape(x), -math.log(self.high - self.low))

    def cumulative(self, x):
        return (x - self.low) / (self.high - self.low)

    def mean(self):
        return (self.low + self.high) / 2

    def variance(self):
        return (self.high - self.low) ** 2 / 12


@dataclass(frozen=True)
class Normal(Distribution):
    mu: float = 0.0
    sigma: float = 1.0

    def log_density(self, x):
        return -0.5 * ((x - self.mu) / self.sigma) ** 2 - math.log(self.sigma * math.sqrt(2 * math.pi))

    def cumulative(self, x):
        return 0.5 * (1 + _erf((x - self.mu) / (self.sigma * math.sqrt(2))))

    def mean(self):
        return self.mu

    def variance(self):
        return self.sigma**2


@dataclass(frozen=True)
class LogNormal(Distribution):
    mu: float = 0.0
    sigma: float = 1.0
    support = (0.0, math.inf)

    def log_density(self, x):
        return np.where(x > 0, Normal(self.mu, self.sigma).log_density(np.log(np.maximum(x, 1e-320))) - np.log(np.maximum(x, 1e-320)), -np.inf)

    def cumulative(self, x):
        return np.where(x > 0, Normal(self.mu, self.sigma).cumulative(np.log(np.maximum(x, 1e-320))), 0.0)

    def mean(self):
        return math.exp(self.mu + self.sigma**2 / 2)

    def variance(self):
        return math.expm1(self.sigma**2) * math.exp(2 * self.mu + self.sigma**2)


@dataclass(frozen=True)
class Exponential(Distribution):
    rate: float = 1.0
    support = (0.0, math.inf)

    def log_density(self, x):
        return math.log(self.rate) - self.rate * x

    def cumulative(self, x):
        return -np.expm1(-self.rate * x)

    def mean(self):
        return 1 / self.rate

    def variance(self):
        return 1 / self.rate**2


@dataclass(frozen=True)
class Gamma(Distribution):
    shape: float = 1.0
    rate: float = 1.0
    support = (0.0, math.inf)

    def log_density(self, x):
        return self.shape * math.log(self.rate) + (self.shape - 1) * np.log(x) - self.rate * x - math.lgamma(self.shape)

    def cumulative(self, x):
        return _gamma_p(self.shape, self.rate * x)

    def mean(self):
        return self.shape / self.rate

    def variance(self):
        return self.shape / self.rate**2


@dataclass(frozen=True)
class ChiSquared(Distribution):
    df: float = 1.0
    support = (0.0, math.inf)

    def log_density(self, x):
        return Gamma(self.df / 2, 0.5).log_density(x)

    def cumulative(self, x):
        return _gamma_p(self.df / 2, x / 2)

    def mean(self):
        return self.df

    def variance(self):
        return 2 * self.df


@dataclass(frozen=True)
class Beta(Distribution):
    a: float = 1.0
    b: float = 1.0
    support = (0.0, 1.0)

    def log_density(self, x):
        return (self.a - 1) * np.log(x) + (self.b - 1) * np.log1p(-x) - (math.lgamma(self.a) + math.lgamma(self.b) - math.lgamma(self.a + self.b))

    def cumulative(self, x):
        return _beta_inc(self.a, self.b, x)

    def mean(self):
        return self.a / (self.a + self.b)

    def variance(self):
        return self.a * self.b / ((self.a + self.b) ** 2 * (self.a + self.b + 1))


@dataclass(frozen=True)
class StudentT(Distribution):
    df: float = 1.0

    def log_density(self, x):
        n = self.df
        return math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi) - (n + 1) / 2 * np.log1p(x * x / n)

    def cumulative(self, x):
        tail = 0.5 * _beta_inc(self.df / 2, 0.5, self.df / (self.df + x * x))
        return np.where(x > 0, 1 - tail, tail)

    def mean(self):
        return 0.0 if self.df > 1 else math.nan

    def variance(self):
        return self.df / (self.df - 2) if self.df > 2 else math.inf if self.df > 1 else math.nan


@dataclass(frozen=True)
class Cauchy(Distribution):
    location: float = 0.0
    scale: float = 1.0

    def log_density(self, x):
        z = (x - self.location) / self.scale
        return -np.log(math.pi * self.scale * (1 + z * z))

    def cumulative(self, x):
        return 0.5 + np.arctan((x - self.location) / self.scale) / math.pi

    def mean(self):
        return math.nan

    def variance(self):
        return math.nan


@dataclass(frozen=True)
class Laplace(Distribution):
    location: float = 0.0
    scale: float = 1.0

    def log_density(self, x):
        return -np.abs(x - self.location) / self.scale - math.log(2 * self.scale)

    def cumulative(self, x):
        half = 0.5 * np.exp(-np.abs(x - self.location) / self.scale)
        return np.where(x < self.location, half, 1 - half)

    def mean(self):
        return self.location

    def variance(self):
        return 2 * self.scale**2


@dataclass(frozen=True)
class Pareto(Distribution):
    least: float = 1.0
    alpha: float = 1.0

    @property
    def support(self):
        return self.least, math.inf

    def log_density(self, x):
        return math.log(self.alpha) + self.alpha * math.log(self.least) - (self.alpha + 1) * np.log(x)

    def cumulative(self, x):
        return 1 - (self.least / x) ** self.alpha

    def mean(self):
        return self.alpha * self.least / (self.alpha - 1) if self.alpha > 1 else math.inf

    def variance(self):
        return self.least**2 * self.alpha / ((self.alpha - 1) ** 2 * (self.alpha - 2)) if self.alpha > 2 else math.inf


@dataclass(frozen=True)
class Weibull(Distribution):
    shape: float = 1.0
    scale: float = 1.0
    support = (0.0, math.inf)

    def log_density(self, x):
        z = x / self.scale
        return math.log(self.shape / self.scale) + (self.shape - 1) * np.log(z) - z**self.shape

    def cumulative(self, x):
        return -np.expm1(-((x / self.scale) ** self.shape))

    def mean(self):
        return self.scale * math.gamma(1 + 1 / self.shape)

    def variance(self):
        return self.scale**2 * (math.gamma(1 + 2 / self.shape) - math.gamma(1 + 1 / self.shape) ** 2)


@dataclass(frozen=True)
class Bernoulli(Distribution):
    p: float = 0.5
    discrete = True
    support = (0.0, 1.0)

    def log_density(self, x):
        return np.log(np.where(x == 1, self.p, 1 - self.p))

    def cumulative(self, x):
        return np.where(x >= 1, 1.0, 1 - self.p)

    def mean(self):
        return self.p

    def variance(self):
        return self.p * (1 - self.p)


@dataclass(frozen=True)
class Binomial(Distribution):
    n: int = 1
    p: float = 0.5
    discrete = True

    @property
    def support(self):
        return 0.0, float(self.n)

    def log_density(self, x):
        return _log_choose(self.n, x) + x * math.log(self.p) + (self.n - x) * math.log1p(-self.p)

    def cumulative(self, x):
        return 1 - _beta_inc(x + 1, np.maximum(self.n - x, 1e-9), self.p)

    def mean(self):
        return self.n * self.p

    def variance(self):
        return self.n * self.p * (1 - self.p)


@dataclass(frozen=True)
class NegativeBinomial(Distribution):
    """Failures before the r-th success."""

    r: float = 1.0
    p: float = 0.5
    discrete = True
    support = (0.0, math.inf)

    def log_density(self, x):
        return _lgamma(x + self.r) - _lgamma(x + 1) - math.lgamma(self.r) + self.r * math.log(self.p) + x * math.log1p(-self.p)

    def cumulative(self, x):
        return _beta_inc(self.r, x + 1, self.p)

    def mean(self):
        return self.r * (1 - self.p) / self.p

    def variance(self):
        return self.r * (1 - self.p) / self.p**2


@dataclass(frozen=True)
class Poisson(Distribution):
    rate: float = 1.0
    discrete = True
    support = (0.0, math.inf)

    def log_density(self, x):
        return x * math.log(self.rate) - self.rate - _lgamma(x + 1)

    def cumulative(self, x):
        return 1 - _gamma_p(x + 1, self.rate)

    def mean(self):
        return self.rate

    def variance(self):
        return self.rate


@dataclass(frozen=True)
class Hypergeometric(Distribution):
    """Successes among `draws` from `total`, of which `good` are successes."""

    total: int = 10
    good: int = 5
    draws: int = 3
    discrete = True

    @property
    def support(self):
        return float(max(0, self.draws + self.good - self.total)), float(min(self.good, self.draws))

    def log_density(self, x):
        return _log_choose(self.good, x) + _log_choose(self.total - self.good, self.draws - x) - _log_choose(self.total, self.draws)

    def cumulative(self, x):
        values = np.arange(self.support[0], self.support[1] + 1)
        sums = np.cumsum(np.exp(self.log_density(values)))
        return np.minimum(1.0, sums[(np.asarray(x) - self.support[0]).astype(int)])

    def mean(self):
        return self.draws * self.good / self.total

    def variance(self):
        share = self.good / self.total
        return self.draws * share * (1 - share) * (self.total - self.draws) / (self.total - 1)


def on_column(distribution: Distribution, what: str, x: Column | str) -> Column:
    """pdf, cdf, ppf or sample of a column; a null or NaN gives null."""

    @F.pandas_udf("double")
    def apply(values: pd.Series) -> pd.Series:
        out = np.asarray(getattr(distribution, what)(values.fillna(0.5).to_numpy(float)), dtype=float)
        return pd.Series(out).where(values.notna() & ~np.isnan(out))

    return apply(F.col(x) if isinstance(x, str) else x)


def uniform_of(key: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) of a key: 52 bits of its hash. JVM expressions only."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def uniform(key: Column | str, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Column:
    return uniform_of(key, seed) * (high - low) + low


def normal(key: Column | str, mean: float = 0.0, std: float = 1.0, seed: int = 0) -> Column:
    """By the Box-Muller transform of two hashed uniform numbers."""
    return F.sqrt(-2 * F.log(uniform_of(key, seed))) * F.cos(2 * math.pi * uniform_of(key, seed + 7919)) * std + mean


def randint(key: Column | str, low: int, high: int, seed: int = 0) -> Column:
    """An integer from low to high - 1."""
    return (F.floor(uniform_of(key, seed) * (high - low)) + low).cast("long")


def bernoulli(key: Column | str, p: float, seed: int = 0) -> Column:
    return (uniform_of(key, seed) < p).cast("int")
