"""Series analysis. What is an aggregate or a window runs as one; recursions run in numpy, series by series.

A series is a group of `by`, ordered by `order_by`. Recursive operators take one series into a task's memory.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.special import f_cdf
from lumenframe.operators.series import per_series, spec


def acf(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], most: int) -> DataFrame:
    """(by, lag, acf) for lags 0 to most, in one window pass and one aggregate."""
    w = spec(by, order_by)
    centred = df.withColumn("_x", F.col(column) - F.avg(column).over(Window.partitionBy(*by)))
    lagged = centred.select(*by, "_x", *[F.lag("_x", k).over(w).alias(f"_{k}") for k in range(1, most + 1)])
    sums = lagged.groupBy(*by).agg(F.sum(F.col("_x") * F.col("_x")).alias("d"), *[F.sum(F.col("_x") * F.col(f"_{k}")).alias(f"s{k}") for k in range(1, most + 1)])
    rows = F.array(F.struct(F.lit(0).alias("lag"), F.col("d").alias("s")), *[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in range(1, most + 1)])
    return sums.select(*by, "d", F.inline(rows)).select(*by, "lag", (F.coalesce("s", F.lit(0.0)) / F.nullif("d", F.lit(0.0))).alias("acf"))


def zscore(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], size: int, threshold: float = 3.0) -> DataFrame:
    """df with z against the rows around (0 where these don't vary) and anomaly: |z| beyond the threshold."""
    w = spec(by, order_by).rowsBetween(-(size // 2), size // 2)
    z = F.coalesce((F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_samp(column).over(w), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("z", z).withColumn("anomaly", F.abs("z") > threshold)


def decompose(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], period: int) -> DataFrame:
    """df with additive trend (centred moving average over a period), seasonal and residual parts."""
    w, half = spec(by, order_by), period // 2
    at = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    inside = (F.col("_i") >= half) & (F.col("_i") < F.col("_n") - half)
    if period % 2:
        trend = F.avg(column).over(w.rowsBetween(-half, half))
    else:  # the two ends count half
        trend = (F.sum(column).over(w.rowsBetween(-half, half)) - (F.lag(column, half).over(w) + F.lead(column, half).over(w)) / 2) / period
    at = at.withColumn("trend", F.when(inside, trend)).withColumn("_p", F.col("_i") % period)
    means = at.groupBy(*by, "_p").agg(F.avg(F.col(column) - F.col("trend")).alias("_m"))
    season = means.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(*by))).drop("_m")
    return at.join(season, [*by, "_p"]).withColumn("residual", F.col(column) - F.col("trend") - F.col("seasonal")).drop("_i", "_n", "_p")


def features(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], size: int) -> DataFrame:
    """Features of each full window of `size` rows, one after another: mean, std, min, max, energy, mean_abs_change."""
    w = spec(by, order_by)
    at = df.select(*by, *order_by, column).withColumn("w", F.floor((F.row_number().over(w) - 1) / size))
    inner = Window.partitionBy(*by, "w").orderBy(*order_by)
    at = at.withColumn("_d", F.abs(F.col(column) - F.lag(column).over(inner)))
    out = at.groupBy(*by, "w").agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), F.sum(F.col(column) * F.col(column)).alias("energy"), F.avg("_d").alias("mean_abs_change"), F.count(F.lit(1)).alias("_n"))
    return out.filter(F.col("_n") == size).drop("_n")


def smooth(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], alpha: float, name: str) -> DataFrame:
    """Simple exponential smoothing: the level after each value, starting at the first."""

    def f(x: np.ndarray) -> np.ndarray:
        out = np.array(x)
        for i in range(1, len(x)):
            out[i] = alpha * x[i] + (1 - alpha) * out[i - 1]
        return out

    return per_series(df, by, order_by, column, name, f)


def holt_winters(x: np.ndarray, period: int, alpha: float, beta: float, gamma: float, horizon: int) -> np.ndarray:
    """Forecasts of additive trend and season."""
    level, trend = x[:period].mean(), (x[period : 2 * period].mean() - x[:period].mean()) / period
    season = list(x[:period] - level)
    for i, v in enumerate(x):
        s, last = season[i % period], level
        level = alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - last) + (1 - beta) * trend
        season[i % period] = gamma * (v - level) + (1 - gamma) * s
    return np.array([level + (h + 1) * trend + season[(len(x) + h) % period] for h in range(horizon)])


def kalman(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], drift: float, noise: float, name: str) -> DataFrame:
    """Local-level filter: the state after each observation; drift and noise are the variances of state and observation."""

    def f(x: np.ndarray) -> np.ndarray:
        out, state, p = np.empty(len(x)), 0.0, 1e6
        for i, v in enumerate(x):
            p += drift
            if not np.isnan(v):
                gain = p / (p + noise)
                state, p = state + gain * (v - state), (1 - gain) * p
            out[i] = state
        return out

    return per_series(df, by, order_by, column, name, f)


def garch(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], omega: float, alpha: float, beta: float, name: str) -> DataFrame:
    """Conditional variance of GARCH(1, 1) with given parameters, starting at the sample variance."""

    def f(x: np.ndarray) -> np.ndarray:
        e = x - x.mean()
        out = np.empty(len(x))
        v = float(e.var())
        for i in range(len(x)):
            out[i] = v
            v = omega + alpha * e[i] ** 2 + beta * v
        return out

    return per_series(df, by, order_by, column, name, f)


def _rows(df: DataFrame, by: Sequence[str], order_by: Sequence[str], f, ddl: str) -> DataFrame:
    """One or more rows per series, with its keys."""
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values(list(order_by), kind="stable"))
        for c, v in reversed(list(zip(by, key, strict=True))):
            out.insert(0, c, v)
        return out

    return df.groupBy(*by).applyInPandas(run, f"{keys}, {ddl}")


def _pacf(x: np.ndarray, most: int) -> np.ndarray:
    """Durbin-Levinson."""
    e = x - x.mean()
    below = float(e @ e) or 1.0
    r = np.array([float(e[k:] @ e[: len(e) - k]) / below if k < len(e) else 0.0 for k in range(most + 1)])
    out, phi = np.ones(most + 1), np.zeros(0)
    for k in range(1, most + 1):
        rest = 1 - phi @ r[1:k]
        a = (r[k] - phi @ r[1:k][::-1]) / rest if rest else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out[k] = a
    return out


def pacf(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], most: int) -> DataFrame:
    return _rows(df, by, order_by, lambda p: pd.DataFrame({"lag": np.arange(most + 1), "pacf": _pacf(p[column].to_numpy(float), most)}), "lag int, pacf double")


def _ar(x: np.ndarray, p: int) -> np.ndarray:
    """Constant and coefficients of an autoregression, by least squares."""
    design = np.column_stack([np.ones(len(x) - p), *[x[p - k : len(x) - k] for k in range(1, p + 1)]])
    return np.linalg.lstsq(design, x[p:], rcond=None)[0]


def forecast_ar(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], p: int, d: int, horizon: int) -> DataFrame:
    """(step, forecast) of ARIMA(p, d, 0); null for series too short to fit."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].to_numpy(float)
        steps = np.arange(1, horizon + 1)
        if len(x) < 2 * p + d + 2:
            return pd.DataFrame({"step": steps, "forecast": np.full(horizon, np.nan)})
        ends, w = [], x
        for _ in range(d):
            ends.append(w[-1])
            w = np.diff(w)
        beta, tail = _ar(w, p), list(w[-p:]) if p else []
        out = []
        for _ in range(horizon):
            v = float(beta[0] + sum(beta[k] * tail[-k] for k in range(1, p + 1)))
            tail.append(v)
            out.append(v)
        for e in reversed(ends):
            out = list(e + np.cumsum(out))
        return pd.DataFrame({"step": steps, "forecast": out})

    return _rows(df, by, order_by, f, "step int, forecast double")


def adf(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], lags: int) -> DataFrame:
    """(statistic, stationary) of the augmented Dickey-Fuller test with a constant; stationary at the 5 % value of -2.86."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].to_numpy(float)
        dx = np.diff(x)
        if len(dx) <= 2 * lags + 4:
            return pd.DataFrame({"statistic": [np.nan], "stationary": [False]})
        y = dx[lags:]
        design = np.column_stack([x[lags:-1], np.ones(len(y)), *[dx[lags - k : len(dx) - k] for k in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        e = y - design @ beta
        cov = np.linalg.pinv(design.T @ design) * (e @ e) / (len(y) - design.shape[1])
        t = float(beta[0] / np.sqrt(cov[0, 0]))
        return pd.DataFrame({"statistic": [t], "stationary": [t < -2.86]})

    return _rows(df, by, order_by, f, "statistic double, stationary boolean")


def granger(df: DataFrame, y: str, x: str, by: Sequence[str], order_by: Sequence[str], lags: int) -> DataFrame:
    """(statistic, p_value): whether x's lags tell of y beyond y's own."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[y].to_numpy(float), pdf[x].to_numpy(float)
        n = len(a) - lags
        if n <= 3 * lags + 2:
            return pd.DataFrame({"statistic": [np.nan], "p_value": [np.nan]})
        own = np.column_stack([np.ones(n), *[a[lags - k : len(a) - k] for k in range(1, lags + 1)]])
        both = np.column_stack([own, *[b[lags - k : len(b) - k] for k in range(1, lags + 1)]])
        rss = [float(((a[lags:] - m @ np.linalg.lstsq(m, a[lags:], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
        freedom = n - both.shape[1]
        s = (rss[0] - rss[1]) / lags / (rss[1] / freedom)
        return pd.DataFrame({"statistic": [s], "p_value": [1 - f_cdf(s, lags, freedom)]})

    return _rows(df, by, order_by, f, "statistic double, p_value double")
