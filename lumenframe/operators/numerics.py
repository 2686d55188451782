"""Integrals of expressions, roots of row-wise functions, and splines through the points of a series.

An integral is one aggregate over a range of steps. Roots are found for all rows of a batch at once, each in its own interval.
A spline is a tridiagonal system of its series' points, so a series is a task's memory, as elsewhere here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _weighted(spark: SparkSession, f: Callable[[Column], Column], a: float, b: float, n: int, weight: Column, scale: float) -> DataFrame:
    x = F.lit(float(a)) + F.col("id") * F.lit((b - a) / n)
    return spark.range(n + 1).agg((F.sum(weight * f(x)) * F.lit((b - a) / n * scale)).alias("integral"))


def integrate_trapezoid(spark: SparkSession, f: Callable[[Column], Column], a: float, b: float, n: int) -> DataFrame:
    """(integral): f from a to b by n trapezoids."""
    if n < 1:
        raise ValueError("at least one step is needed")
    return _weighted(spark, f, a, b, n, F.when(F.col("id").isin(0, n), 0.5).otherwise(1.0), 1.0)


def integrate_simpson(spark: SparkSession, f: Callable[[Column], Column], a: float, b: float, n: int) -> DataFrame:
    """(integral): f from a to b by Simpson's rule on n steps; n is even."""
    if n < 2 or n % 2:
        raise ValueError("an even number of steps is needed")
    return _weighted(spark, f, a, b, n, F.when(F.col("id").isin(0, n), 1.0).otherwise(2.0 + 2.0 * (F.col("id") % 2)), 1 / 3)


def roots(df: DataFrame, f: Callable[..., np.ndarray], parameters: Sequence[str], low: str, high: str, name: str = "root", rounds: int = 200) -> DataFrame:
    """Each row with the root that bisection finds of x -> f(x, *parameters) between its `low` and `high`.

    f works on arrays. Null where a number is null or not finite, or f has one sign at both ends.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for a, b, *rest in batches:
            a, b, *rest = (x.to_numpy(dtype=float, na_value=np.nan) for x in (a, b, *rest))
            with np.errstate(all="ignore"):
                fa, fb = f(a, *rest), f(b, *rest)
                good = np.isfinite(fa) & np.isfinite(fb) & (fa * fb <= 0)
                a, b = np.where(fa == 0, b, a), np.where(fa == 0, a, b)  # a root at an end is the end that converges
                sign = np.sign(np.where(fa == 0, fb, fa))
                for _ in range(rounds):
                    middle = a + (b - a) / 2
                    if ((middle == a) | (middle == b) | ~good).all():
                        break
                    left = np.sign(f(middle, *rest)) == sign
                    a, b = np.where(left, middle, a), np.where(left, b, middle)
            yield pd.Series(np.where(good, b, np.nan)).astype(object).where(good, None)

    columns = [F.col(c).cast("double") for c in (low, high, *parameters)]
    return df.withColumn(name, F.pandas_udf(run, T.DoubleType())(*columns))


def spline_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the points of the natural cubic spline, by elimination along the tridiagonal system."""
    n, m = len(x), np.zeros(len(x))
    if n < 3:
        return m
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    up, right = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * up[i - 1]
        up[i] = h[i] / pivot
        right[i] = (6 * (d[i] - d[i - 1]) - h[i - 1] * right[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        m[i] = right[i] - up[i] * m[i + 1]
    return m


def spline_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (x, y), x ascending, at other places; beyond the points the end pieces go on."""
    if len(x) < 2:
        return np.full(len(at), y[0] if len(x) else np.nan)
    m, i = spline_slopes(x, y), np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h, t = x[i + 1] - x[i], at - x[i]
    slope = (y[i + 1] - y[i]) / h - h * (2 * m[i] + m[i + 1]) / 6
    return y[i] + t * (slope + t * (m[i] / 2 + t * (m[i + 1] - m[i]) / (6 * h)))


def cubic_spline(points: DataFrame, places: DataFrame, x: str, y: str, by: Sequence[str], name: str = "value") -> DataFrame:
    """(by, x, name): each place's value on the natural cubic spline through the points of its series.

    Points with nulls take no part, points of one x count by their mean; places without points, or null, get null.
    """
    schema = T.StructType([*(places.schema[c] for c in by), T.StructField(x, T.DoubleType()), T.StructField(name, T.DoubleType())])
    known = points.select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna(subset=[x, y]).groupBy(*by, x).agg(F.avg(y).alias(y))

    def run(_, known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known, out = known.sort_values(x), asked[[*by, x]].copy()
        out[name] = spline_at(known[x].to_numpy(float), known[y].to_numpy(float), asked[x].to_numpy(float)) if len(asked) else []
        return out

    wanted = places.select(*by, F.col(x).cast("double").alias(x))
    return known.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(run, schema).withColumn(name, F.when(~F.isnan(name), F.col(name)))
