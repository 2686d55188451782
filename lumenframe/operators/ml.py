"""Preparation, metrics, selection, neighbours, clustering and models.

Scalers, encoders, metrics and selection are aggregates joined back through one broadcast row. Models whose fit is a sum over
rows (least squares, naive Bayes, k-means steps, principal components) aggregate on the cluster and solve on the driver in the
number of features; trees, boosting and logistic regression are pyspark.ml's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import scalar as S
from lumenframe.operators.lineage import cut


def _with(df: DataFrame, *aggs: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row


def standard_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over their population std; constant ones become 0."""
    wide = _with(df, *[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    return wide.select(*[(F.when(F.col(f"_s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)))).alias(c) if c in columns else F.col(c) for c in df.columns])


def minmax_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns onto [0, 1]; constant ones become 0."""
    wide = _with(df, *[x for c in columns for x in (F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}"))])
    width = lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}")
    return wide.select(*[(F.when(width(c) == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_a_{c}")) / F.nullif(width(c), F.lit(0)))).alias(c) if c in columns else F.col(c) for c in df.columns])


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the 0-based rank of each value among the distinct ones."""
    ranked = df.select(column).distinct().withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(ranked, column)


def one_hot(df: DataFrame, column: str, categories: Sequence) -> DataFrame:
    return df.select("*", *[(F.col(column) == c).cast("int").alias(f"{column}_{c}") for c in categories])


def binary_encode(df: DataFrame, column: str, bits: int) -> DataFrame:
    """df with the binary digits of a non-negative integer column, the highest first."""
    return df.select("*", *[F.shiftright(column, bits - 1 - b).bitwiseAND(F.lit(1)).cast("int").alias(f"{column}_{b}") for b in range(bits)])


def target_encode(df: DataFrame, column: str, target: str, smoothing: float, name: str) -> DataFrame:
    """Each category's mean target, drawn towards the overall mean by `smoothing` rows."""
    whole = df.agg(F.avg(target).alias("_mean"))
    means = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"), F.sum(target).alias("_s")).crossJoin(F.broadcast(whole))
    return df.join(means.select(column, ((F.col("_s") + smoothing * F.col("_mean")) / (F.col("_n") + smoothing)).alias(name)), column)


def polynomial(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with squares and pairwise products."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(columns) for b in columns[i:]])


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, precision, recall, f1 of the largest label as the positive class, in one aggregate."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    top = cells.agg(F.max("t").alias("top"))
    c = cells.crossJoin(F.broadcast(top))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    hit_t, hit_p = F.col("t") == F.col("top"), F.col("p") == F.col("top")
    one = c.agg(count(F.col("t") == F.col("p")).alias("right"), F.sum("n").alias("n"), count(hit_t & hit_p).alias("tp"), count(~hit_t & hit_p).alias("fp"), count(hit_t & ~hit_p).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return one.select((F.col("right") / F.col("n")).alias("accuracy"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e, t = F.col(truth) - F.col(predicted), F.col(truth)
    mse = F.avg(e * e)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(t) * F.count(t))).alias("r2"))


def f_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, f): one-way analysis of variance of each column by label, in one pass over group sums."""
    groups = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in (F.sum(F.col(c).cast("double")).alias(f"s_{c}"), F.sum(F.col(c).cast("double") * F.col(c).cast("double")).alias(f"q_{c}"))])
    out = []
    for c in columns:
        s, q = F.col(f"s_{c}"), F.col(f"q_{c}")
        between = F.sum(s * s / F.col("n")) - F.sum(s) * F.sum(s) / F.sum("n")
        within = F.sum(q) - F.sum(s * s / F.col("n"))
        k, n = F.count(F.lit(1)), F.sum("n")
        out.append(F.struct(F.lit(c).alias("feature"), ((between / (k - 1)) / (within / (n - k))).alias("f")))
    return groups.agg(F.array(*out).alias("a")).select(F.inline("a"))


def chi2_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, chi2): sums of each non-negative column by label against the label's share of rows."""
    groups = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in columns])
    total = groups.agg(F.sum("n").alias("_n"), *[F.sum(f"s_{c}").alias(f"_t_{c}") for c in columns])
    g = groups.crossJoin(F.broadcast(total))
    out = []
    for c in columns:
        want = F.col(f"_t_{c}") * F.col("n") / F.col("_n")
        out.append(F.struct(F.lit(c).alias("feature"), F.sum((F.col(f"s_{c}") - want) * (F.col(f"s_{c}") - want) / want).alias("chi2")))
    return g.agg(F.array(*out).alias("a")).select(F.inline("a"))


def split(df: DataFrame, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """df with `test`: by a hash of the key, so that a row falls on the same side in every run."""
    return df.withColumn("test", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(test_share * 1_000_000))


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


DISTANCES = {"l2": S.l2, "l1": S.l1, "cosine": lambda a, b: 1 - S.cosine(a, b), "dot": lambda a, b: -S.dot(a, b)}


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", most_queries: int = 10_000) -> DataFrame:
    """(query, id, distance): each query's k nearest rows; both sides are (id, vector).

    Exact, by comparing all rows with a broadcast of the queries, whose number is checked; each task keeps the best k of its
    rows before the shuffle (a group-limited window). The training-data subpackage has a search for large query sets.
    """
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    q = queries.select(F.col("id").alias("query"), F.col("vector").alias("q"))
    pairs = rows.crossJoin(F.broadcast(q)).select("query", "id", DISTANCES[metric](F.col("vector"), F.col("q")).alias("distance"))
    w = Window.partitionBy("query").orderBy("distance", "id")
    return pairs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


def gaussian_nb(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Prior, means and variances of each class."""
    total = Window.partitionBy()
    got = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.var_pop(c).alias(f"var_{c}"))])
    return got.withColumn("prior", F.col("n") / F.sum("n").over(total)).drop("n")


def predict_nb(df: DataFrame, model: DataFrame, columns: Sequence[str], label: str, key: str, smooth: float = 1e-9) -> DataFrame:
    """(key, predicted): the likeliest class; the model has a row a class."""
    score = F.log("prior")
    for c in columns:
        v = F.col(f"var_{c}") + smooth
        score = score - 0.5 * F.log(2 * np.pi * v) - (F.col(c) - F.col(f"mean_{c}")) * (F.col(c) - F.col(f"mean_{c}")) / (2 * v)
    pairs = df.select(key, *columns).crossJoin(F.broadcast(model)).withColumn("_s", score)
    return pairs.groupBy(key).agg(F.max_by(label, F.struct("_s", label)).alias("predicted"))


def assign(df: DataFrame, columns: Sequence[str], centers: Sequence[Sequence[float]]) -> DataFrame:
    """df with cluster and distance2: the nearest of given centres."""
    d = [sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(columns, center, strict=True)), F.lit(0.0)) for center in centers]
    best = F.array_min(F.array(*[F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d)]))
    return df.withColumn("_b", best).withColumn("cluster", F.col("_b.i")).withColumn("distance2", F.col("_b.d")).drop("_b")


def kmeans(df: DataFrame, columns: Sequence[str], centers: list[list[float]], rounds: int = 10, least: float = 1e-9) -> list[list[float]]:
    """Lloyd's steps from given centres: each is one aggregate of sums by cluster."""
    for _ in range(rounds):
        rows = assign(df, columns, centers).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns]).collect()
        new = [list(c) for c in centers]
        for r in rows:
            new[r["cluster"]] = [r[c] for c in columns]
        moved = max(abs(a - b) for x, y in zip(new, centers, strict=True) for a, b in zip(x, y, strict=True))
        centers = new
        if moved < least:
            break
    return centers


def pca(df: DataFrame, columns: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, variances) of the centred columns: one aggregate of covariances, an eigendecomposition on the driver."""
    n = len(columns)
    one = df.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    cov = np.array([[one[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    parts = vectors[:, order].T
    return parts * np.sign(parts[np.arange(k), np.abs(parts).argmax(1)])[:, None], values[order]


def ridge(df: DataFrame, y: str, xs: Sequence[str], penalty: float) -> list[float]:
    """Intercept (unpenalised) and coefficients, from one aggregate of sums."""
    columns = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(columns)
    s = df.agg(*[F.sum(columns[i] * columns[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(c * F.col(y)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    a = np.array([[s[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag([0.0] + [penalty] * (k - 1))
    return np.linalg.solve(a, np.array([s[f"b{i}"] for i in range(k)])).tolist()


def vectors(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def estimator(kind: str, label: str = "label", **params):
    """A pyspark.ml estimator by name: logistic, linear, tree, forest or boosting, each with _classifier or _regressor."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    kinds = {"logistic_classifier": C.LogisticRegression, "linear_regressor": R.LinearRegression, "tree_classifier": C.DecisionTreeClassifier, "tree_regressor": R.DecisionTreeRegressor, "forest_classifier": C.RandomForestClassifier, "forest_regressor": R.RandomForestRegressor, "boosting_classifier": C.GBTClassifier, "boosting_regressor": R.GBTRegressor, "svm_classifier": C.LinearSVC, "glm_regressor": R.GeneralizedLinearRegression}
    return kinds[kind](featuresCol="features", labelCol=label, **params)


def permutation_importance(df: DataFrame, model, columns: Sequence[str], label: str, key: str) -> DataFrame:
    """(feature, importance): growth of the mean squared error when a column's values change places among rows.

    Places are changed by pairing hash-ordered neighbours within buckets of the key, without a global sort.
    """
    spark = df.sparkSession
    error = lambda rows: model.transform(vectors(rows, columns)).agg(F.avg((F.col("prediction") - F.col(label)) * (F.col("prediction") - F.col(label)))).first()[0]
    base, out = error(df), []
    w = Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(64))).orderBy(F.xxhash64(key, F.lit(1)))
    for c in columns:
        moved = df.withColumn(c, F.coalesce(F.lag(c).over(w), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        out.append((c, float(error(moved) - base)))
    return spark.createDataFrame(out, "feature string, importance double")


def select_best(df: DataFrame, columns: Sequence[str], label: str, k: int, how: str = "f") -> list[str]:
    """The k columns of the highest f or chi2 score."""
    scores = f_scores(df, columns, label) if how == "f" else chi2_scores(df, columns, label).withColumnRenamed("chi2", "f")
    return [r["feature"] for r in scores.orderBy(F.desc("f"), "feature").limit(k).collect()]


def eliminate(df: DataFrame, columns: Sequence[str], label: str, keep: int) -> list[str]:
    """Recursive elimination: the column of the smallest standardised coefficient goes, until `keep` are left."""
    left = list(columns)
    while len(left) > keep:
        beta = ridge(standard_scaler(df.select(label, *left), left), label, left, 1e-9)[1:]
        left.pop(int(np.abs(beta).argmin()))
    return left


def stack(df: DataFrame, kinds: Sequence[str], columns: Sequence[str], label: str, key: str, k: int = 3) -> tuple[list, list[float]]:
    """(models, blend): regressors fitted on all rows, and the intercept and weights that blend best their out-of-fold
    predictions."""
    rows = folds(vectors(df, columns), key, k).select(key, "features", label, "fold")
    held = None
    for f in range(k):
        part = rows.filter(F.col("fold") == f)
        for i, kind in enumerate(kinds):
            part = estimator(kind, label=label, predictionCol=f"p{i}").fit(rows.filter(F.col("fold") != f)).transform(part)
        part = part.select(label, *[f"p{i}" for i in range(len(kinds))])
        held = part if held is None else held.unionAll(part)
    models = [estimator(kind, label=label, predictionCol=f"p{i}").fit(rows) for i, kind in enumerate(kinds)]
    return models, ridge(held, label, [f"p{i}" for i in range(len(kinds))], 1e-9)


def linear_shap(df: DataFrame, columns: Sequence[str], weights: Sequence[float], key: str) -> DataFrame:
    """(key, feature, shap) of a linear model: weight times the value's distance from its mean, exact for it."""
    wide = _with(df, *[F.avg(c).alias(f"_m_{c}") for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (float(w) * (F.col(c) - F.col(f"_m_{c}"))).alias("shap")) for c, w in zip(columns, weights, strict=True)])
    return wide.select(key, F.inline(parts))


def random_projection_index(rows: DataFrame, column: str = "vector", tables: int = 8, width: float = 2.0, seed: int = 1):
    """An approximate nearest-neighbour index (pyspark.ml's bucketed random projections) over (id, vector)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    index = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed)
    ready = rows.withColumn("features", array_to_vector(F.col(column)))
    return index.fit(ready), ready


def random_projection_search(model, rows: DataFrame, queries: DataFrame, radius: float, block: int = 2048) -> DataFrame:
    """(a, b, distance): of each query a, the other rows b nearer than radius that share a bucket with it in one of the index's tables.

    Both sides are packed into blocks; each pair of blocks is one row of a cross join and is searched by products of matrices, so
    neither buckets nor candidates are written out. Rows without a vector take no part.
    """
    from pyspark.ml.functions import vector_to_array

    tables = int(model.getNumHashTables())

    def packed(df: DataFrame, side: str) -> DataFrame:
        hashes = F.array(*[vector_to_array(F.col("hashes")[i])[0] for i in range(tables)])
        flat = model.transform(df).select(F.col("id").cast("long").alias("id"), vector_to_array("features").alias("v"), hashes.alias("h"))

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    part = batch.slice(at, block)
                    ids, v, h = part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int64), v, h)], names=[f"{side}_id", f"{side}_v", f"{side}_h"])

        return cut(flat.mapInArrow(run, f"{side}_id binary, {side}_v binary, {side}_h binary"))

    def search(batches):
        for batch in batches:
            for a_id, a_v, a_h, b_id, b_v, b_h in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a_id, b_id = np.frombuffer(a_id, np.int64), np.frombuffer(b_id, np.int64)
                a, b = np.frombuffer(a_v).reshape(len(a_id), -1), np.frombuffer(b_v).reshape(len(b_id), -1)
                near = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
                i, j = np.nonzero((near <= radius * radius * (1 + 1e-9) + 1e-9) & (a_id[:, None] != b_id[None, :]))
                p, q = np.frombuffer(a_h).reshape(len(a_id), tables), np.frombuffer(b_h).reshape(len(b_id), tables)
                for k in range(0, len(i), 65536):
                    m, n = i[k : k + 65536], j[k : k + 65536]
                    far = np.sqrt(((a[m] - b[n]) ** 2).sum(1))
                    ok = (far < radius) & (p[m] == q[n]).any(1)
                    yield pa.RecordBatch.from_arrays([pa.array(a_id[m][ok]), pa.array(b_id[n][ok]), pa.array(far[ok])], names=["a", "b", "distance"])

    pairs = packed(queries, "a").crossJoin(packed(rows, "b"))
    return pairs.mapInArrow(search, "a long, b long, distance double")
