"""Event-time windows, running statistics and incremental models on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """events with a watermark, which is only defined on timestamps with a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(events: DataFrame, by: Sequence[str], size: str, slide: str | None = None, late: str = "1 hour", time: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; rows later than the watermark are dropped."""
    out = _timed(events, time, late).groupBy(F.window(time, size, slide), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "v")


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    out = _timed(events, time, late).groupBy(key, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_moments(events: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by, n, mean, variance, sample_variance) so far; the aggregate's state is mergeable moments."""
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.var_samp(value).alias("sample_variance"))


def running_ewm(events: DataFrame, key: str, order: str, value: str, alpha: float, key_type: str = "long") -> DataFrame:
    """(key, n, mean) after each batch: adjusted exponentially weighted mean, its numerator and denominator kept as state."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, below, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values(order)
        for x in rows[value].to_numpy(float):
            top, below = top * (1 - alpha), below * (1 - alpha)
            if not np.isnan(x):
                top, below, n = top + x, below + 1, n + 1
        state.update((top, below, n))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [top / below if below else np.nan]})

    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {key_type}, n long, mean double", "top double, below double, n long", "update", GroupStateTimeout.NoTimeout)


class OnlineLinear:
    """Linear or logistic regression learned batch by batch: a batch's gradient is one aggregate on the cluster, the step a few
    numbers on the driver. For foreachBatch."""

    def __init__(self, columns: Sequence[str], label: str, rate: float = 0.1, ridge: float = 0.0, logistic: bool = False):
        self.columns, self.label, self.rate, self.ridge, self.logistic = list(columns), label, rate, ridge, logistic
        self.weights = np.zeros(len(columns) + 1)

    def _raw(self):
        return F.lit(float(self.weights[0])) + sum((F.col(c) * float(w) for c, w in zip(self.columns, self.weights[1:], strict=True)), F.lit(0.0))

    def predict(self):
        return 1 / (1 + F.exp(-self._raw())) if self.logistic else self._raw()

    def partial_fit(self, batch: DataFrame, _: int = 0) -> None:
        e = self.predict() - F.col(self.label)
        g = batch.agg(F.avg(e).alias("g0"), *[F.avg(e * F.col(c)).alias(f"g{i + 1}") for i, c in enumerate(self.columns)]).first()
        if g["g0"] is not None:
            grad = np.array([g[f"g{i}"] for i in range(len(self.weights))])
            grad[1:] += self.ridge * self.weights[1:]
            self.weights -= self.rate * grad


class OnlineKMeans:
    """Centres moved batch by batch towards the mean of their rows, at the rate of those rows among all so far."""

    def __init__(self, columns: Sequence[str], centers: Sequence[Sequence[float]]):
        self.columns, self.centers, self.counts = list(columns), np.array(centers, dtype=float), np.zeros(len(centers))

    def partial_fit(self, batch: DataFrame, _: int = 0) -> None:
        from lumenframe.operators.ml import assign

        rows = assign(batch, self.columns, self.centers.tolist()).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in self.columns])
        for r in rows.collect():  # a row a centre
            k = r["cluster"]
            self.counts[k] += r["n"]
            self.centers[k] += r["n"] / self.counts[k] * (np.array([r[c] for c in self.columns]) - self.centers[k])


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All that is there, through the stream into a memory table; for tests and small results."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
