"""Further models: density clustering, neighbours as classifiers, hazards, generalised lines, anomaly scores, samplers, searches."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import graph
from lumenframe.operators.frame import running_sums
from lumenframe.operators.lineage import cut
from lumenframe.operators.ml import nearest
from lumenframe.operators.series import per_series, spec
from lumenframe.operators.timeseries import _rows, decompose


def dbscan(df: DataFrame, key: str, columns: Sequence[str], radius: float, least: int) -> DataFrame:
    """(key, cluster, core): clusters of points that have `least` points (themselves included) within `radius`, and what those
    reach; cluster is the smallest core key, null for noise. For a few dimensions.

    Points meet in a grid of cells as wide as the radius: a point is compared with those of its and the neighbouring cells
    only. Exact copies are one point with a weight, so that a pile of them is not paired with itself.
    """
    points = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_w"), F.min(key).alias("_k"))
    own = points.withColumn("_cell", F.array(*[F.floor(F.col(c) / radius) for c in columns]))
    steps = F.array(*[F.array(*[F.lit(s) for s in shift]) for shift in product((-1, 0, 1), repeat=len(columns))])
    near = own.select(F.explode(F.transform(steps, lambda s: F.zip_with("_cell", s, lambda a, b: a + b))).alias("_cell"), F.col("_k").alias("_n"), F.col("_w").alias("_m"), *[F.col(c).alias(f"_{c}") for c in columns])
    close = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in columns), F.lit(0.0)) <= radius * radius
    pairs = cut(own.join(near, "_cell").filter(close).select("_k", "_n", "_m"))
    core = cut(pairs.groupBy("_k").agg(F.sum("_m").alias("_c")).filter(F.col("_c") >= least).select("_k"))
    both = pairs.join(core, "_k").join(core.select(F.col("_k").alias("_n")), "_n")
    parts = graph.components(both.select(F.col("_k").alias("src"), F.col("_n").alias("dst"))).select(F.col("node").alias("_n"), F.col("component").alias("cluster"))
    reached = pairs.join(parts, "_n").groupBy("_k").agg(F.min("cluster").alias("_reach"))
    labels = points.select("_k", *columns).join(parts.withColumnRenamed("_n", "_k"), "_k", "left").join(reached, "_k", "left")
    labels = labels.select(*columns, F.coalesce("cluster", "_reach").alias("cluster"), F.col("cluster").isNotNull().alias("core"))
    return df.join(labels, list(columns)).select(key, "cluster", "core")


def knn_classify(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query, predicted): the commonest label of the k nearest of rows (id, vector, label); the smallest of ties."""
    votes = nearest(rows.select("id", "vector"), queries, k, metric).join(rows.select("id", "label"), "id").groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"))


def knn_regress(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    return nearest(rows.select("id", "vector"), queries, k, metric).join(rows.select("id", "label"), "id").groupBy("query").agg(F.avg("label").alias("predicted"))


def cox(df: DataFrame, time: str, event: str, columns: Sequence[str], rounds: int = 20) -> list[float]:
    """Coefficients of proportional hazards, ties by Breslow's likelihood.

    A Newton step is one aggregate by distinct time and one running sum over these, then a solve on the driver.
    """
    k, beta = len(columns), np.zeros(len(columns))
    x = [F.col(c).cast("double") for c in columns]
    for _ in range(rounds):
        risk = F.exp(sum((a * float(b) for a, b in zip(x, beta, strict=True)), F.lit(0.0)))
        parts = {"s": risk} | {f"s{i}": risk * x[i] for i in range(k)} | {f"s{i}_{j}": risk * x[i] * x[j] for i in range(k) for j in range(i, k)}
        happened = F.col(event).cast("double")
        by = df.groupBy(F.col(time).alias("t")).agg(F.sum(happened).alias("d"), *[F.sum(happened * x[i]).alias(f"x{i}") for i in range(k)], *[F.sum(v).alias(n) for n, v in parts.items()])
        at = running_sums(by, [F.col("t").desc()], {n: f"run_{n}" for n in parts}).drop(*parts).withColumnsRenamed({f"run_{n}": n for n in parts}).filter("d > 0")
        mean = lambda i: F.col(f"s{i}") / F.col("s")
        one = at.agg(*[F.sum(F.col(f"x{i}") - F.col("d") * mean(i)).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("d") * (F.col(f"s{i}_{j}") / F.col("s") - mean(i) * mean(j))).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        step = np.linalg.solve(np.array([[one[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), np.array([one[f"g{i}"] for i in range(k)]))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta.tolist()


LINKS = {
    "gaussian": (lambda e: e, lambda m: F.lit(1.0), lambda m: F.lit(1.0)),
    "poisson": (lambda e: F.exp(e), lambda m: m, lambda m: m),
    "binomial": (lambda e: 1 / (1 + F.exp(-e)), lambda m: m * (1 - m), lambda m: m * (1 - m)),
}


def glm(df: DataFrame, y: str, columns: Sequence[str], family: str = "gaussian", rounds: int = 25) -> list[float]:
    """Intercept and coefficients under the canonical link, by reweighted least squares: a round is one aggregate of sums."""
    inverse, slope, _ = LINKS[family]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    k, beta = len(x), np.zeros(len(x))
    if family == "poisson":
        beta[0] = np.log(max(df.agg(F.avg(y)).first()[0], 1e-9))
    for _ in range(rounds):
        eta = sum((a * float(b) for a, b in zip(x, beta, strict=True)), F.lit(0.0))
        mean = inverse(eta)
        one = df.agg(*[F.sum((F.col(y) - mean) * x[i]).alias(f"g{i}") for i in range(k)], *[F.sum(slope(mean) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        step = np.linalg.solve(np.array([[one[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), np.array([one[f"g{i}"] for i in range(k)]))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta.tolist()


def ewma_anomaly(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], alpha: float, limit: float) -> DataFrame:
    """df with anomaly: values more than `limit` running standard deviations off the exponentially weighted mean before them."""

    def f(x: np.ndarray) -> np.ndarray:
        mean, var, out = x[0] if len(x) else 0.0, 0.0, np.zeros(len(x))
        for i, v in enumerate(x):
            e = v - mean
            out[i] = float(i > 0 and abs(e) > limit * np.sqrt(var) > 0)
            mean, var = mean + alpha * e, (1 - alpha) * (var + alpha * e * e)
        return out

    return per_series(df, by, order_by, column, "_a", f).withColumn("anomaly", F.col("_a") > 0).drop("_a")


def seasonal_anomaly(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], period: int, limit: float = 3.0) -> DataFrame:
    """df's decomposition with anomaly: residuals beyond `limit` of their standard deviations."""
    parts, w = decompose(df, column, by, order_by, period), Window.partitionBy(*by)
    return parts.withColumn("anomaly", F.coalesce(F.abs(F.col("residual") - F.avg("residual").over(w)) > limit * F.stddev_samp("residual").over(w), F.lit(False)))


def vector_autoregression(df: DataFrame, columns: Sequence[str], by: Sequence[str], order_by: Sequence[str], lags: int) -> DataFrame:
    """(by, equation, term, coefficient) by least squares on lagged columns."""
    names = ["const", *[f"{c}_{k}" for k in range(1, lags + 1) for c in columns]]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(columns)].to_numpy(float)
        if len(x) <= lags * (len(columns) + 1) + 1:
            return pd.DataFrame({"equation": [], "term": [], "coefficient": []})
        design = np.column_stack([np.ones(len(x) - lags), *[x[lags - k : len(x) - k] for k in range(1, lags + 1)]])
        beta = np.linalg.lstsq(design, x[lags:], rcond=None)[0]
        return pd.DataFrame([(c, n, float(beta[i, j])) for j, c in enumerate(columns) for i, n in enumerate(names)], columns=["equation", "term", "coefficient"])

    return _rows(df, by, order_by, f, "equation string, term string, coefficient double")


def posterior_mean(df: DataFrame, column: str, by: Sequence[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """(by, mean, std, r_hat) of a normal mean's posterior, by random-walk Metropolis on the sufficient statistics of a group.

    Groups are reduced to count, sum and sum of squares first; four chains run for each in a pandas function.
    """
    c = F.col(column).cast("double")
    sums = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v"))
    keys = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        rng, scale = np.random.default_rng(seed), float(np.sqrt(max(r["v"], 1e-12) / r["n"]))
        chains = np.empty((4, draws))
        for k in range(4):
            at = r["m"] + scale * rng.normal()
            for i in range(draws):
                new = at + 2.4 * scale * rng.normal()
                if np.log(rng.random()) < ((at - r["m"]) ** 2 - (new - r["m"]) ** 2) / (2 * scale**2):
                    at = new
                chains[k, i] = at
        half = chains[:, draws // 2 :]
        within, between = half.var(1, ddof=1).mean(), half.mean(1).var(ddof=1)
        out = {b: [r[b]] for b in by} | {"mean": [half.mean()], "std": [half.std()], "r_hat": [float(np.sqrt((within * (1 - 1 / half.shape[1]) + between) / within))]}
        return pd.DataFrame(out)

    return sums.groupBy(*by).applyInPandas(run, f"{keys}, mean double, std double, r_hat double")


def grid_search(df: DataFrame, kind: str, columns: Sequence[str], label: str, grid: dict[str, Sequence], folds: int = 3, seed: int = 0) -> DataFrame:
    """(setting, error): mean squared error by cross-validation for each combination, the best first."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from lumenframe.operators.ml import estimator, vectors

    model, builder = estimator(kind, label=label), ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(model, name), list(values))
    maps = builder.build()
    fitted = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=label, metricName="mse"), numFolds=folds, seed=seed).fit(vectors(df, columns).select("features", label))
    rows = [(", ".join(f"{p.name}={v}" for p, v in m.items()), float(e)) for m, e in zip(maps, fitted.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "setting string, error double").orderBy("error", "setting")


def product_quantise(df: DataFrame, key: str, column: str, parts: int, codes: int, rounds: int = 8) -> DataFrame:
    """(key, part, code): each vector's nearest centre in each of its parts, centres found by Lloyd's steps on aggregates.

    First centres are those of the smallest hashes of key.
    """
    width = F.size(column) / parts
    split = df.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(column, (i * width + 1).cast("int"), width.cast("int")))).alias("part", "v"))
    rows = cut(split.withColumn("v", F.transform("v", lambda x: x.cast("double"))))
    first = Window.partitionBy("part").orderBy(F.xxhash64(key), key)
    centers = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= codes).select("part", (F.col("n") - 1).alias("code"), F.col("v").alias("c"))
    distance: Column = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    for _ in range(rounds):
        best = rows.join(F.broadcast(centers), "part").groupBy(key, "part").agg(F.min_by("code", F.struct(distance, F.col("code"))).alias("code"), F.first("v").alias("v"))
        means = best.select("part", "code", F.posexplode("v").alias("i", "x")).groupBy("part", "code", "i").agg(F.avg("x").alias("x"))
        centers = cut(means.groupBy("part", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("c")))
    return rows.join(F.broadcast(centers), "part").groupBy(key, "part").agg(F.min_by("code", F.struct(distance, F.col("code"))).alias("code"))


def partial_dependence(df: DataFrame, model, columns: Sequence[str], feature: str, values: Sequence[float]) -> DataFrame:
    """(value, prediction): the mean prediction with a feature held at each value."""
    from lumenframe.operators.ml import vectors

    out = [(float(v), float(model.transform(vectors(df.withColumn(feature, F.lit(float(v))), columns)).agg(F.avg("prediction")).first()[0])) for v in values]
    return df.sparkSession.createDataFrame(out, "value double, prediction double")


def sessions_of(df: DataFrame, by: Sequence[str], time: str, gap_seconds: float, name: str = "session") -> DataFrame:
    """df with a number for each run of rows without a longer gap."""
    w = spec(by, [time])
    new = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w) >= gap_seconds * 1e6, F.lit(True))
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
