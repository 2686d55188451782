"""Rolling, expanding and exponentially weighted windows, and filling of gaps.

`by` are the series' keys, `order_by` the position within one. A series is partitioned by its keys, so a table of many series
runs in parallel; a single series runs in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop}


def spec(by: Sequence[str], order_by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order_by)


def rolling(column: str, how: str, size: int, w: WindowSpec, min_periods: int | None = None, center: bool = False) -> Column:
    """Aggregate of the non-null values of the last `size` rows (or those around); null below min_periods of them."""
    frame = w.rowsBetween(-(size // 2), size - size // 2 - 1) if center else w.rowsBetween(1 - size, 0)
    return F.when(F.count(column).over(frame) >= (size if min_periods is None else min_periods), ROLLING[how](column).over(frame))


def expanding(column: str, how: str, w: WindowSpec) -> Column:
    """Aggregate of all values up to the row; null where the value is."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.col(column).isNotNull(), ROLLING[how](column).over(frame))


def fill_forward(column: str, w: WindowSpec) -> Column:
    return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(column: str, w: WindowSpec) -> Column:
    return F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], name: str) -> DataFrame:
    """df with gaps filled linearly by position; the ends stay null."""
    w = spec(by, order_by)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = df.withColumn("_at", F.row_number().over(w)).withColumn("_here", F.when(F.col(column).isNotNull(), F.col("_at")))
    at = at.select("*", F.last(column, True).over(back).alias("_a"), F.first(column, True).over(ahead).alias("_b"), F.last("_here", True).over(back).alias("_i"), F.first("_here", True).over(ahead).alias("_j"))
    value = F.when(F.col(column).isNotNull(), F.col(column)).when(F.col("_i").isNotNull() & F.col("_j").isNotNull(), F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_i")) / (F.col("_j") - F.col("_i")))
    return at.withColumn(name, value).drop("_at", "_here", "_a", "_b", "_i", "_j")


def per_series(df: DataFrame, by: Sequence[str], order_by: Sequence[str], column: str, name: str, f, kind: T.DataType | None = None) -> DataFrame:
    """df with f(values of a series, in order) as a new column; for recursions that windows can't express."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind or T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order_by), kind="stable")
        return pdf.assign(**{name: f(pdf[column].to_numpy(dtype=float, na_value=np.nan))})

    return df.groupBy(*by).applyInPandas(run, schema)


def ewm(values: np.ndarray, alpha: float) -> np.ndarray:
    """Adjusted exponentially weighted mean; weights decay across gaps, and a gap has the mean so far."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha is to be in (0, 1]")
    out, top, below = np.full(len(values), np.nan), 0.0, 0.0
    for i, x in enumerate(values):
        top, below = top * (1 - alpha), below * (1 - alpha)
        if not np.isnan(x):
            top, below = top + x, below + 1
        if below > 0:
            out[i] = top / below
    return out


def ewm_mean(df: DataFrame, column: str, alpha: float, by: Sequence[str], order_by: Sequence[str], name: str) -> DataFrame:
    return per_series(df, by, order_by, column, name, lambda x: ewm(x, alpha))
