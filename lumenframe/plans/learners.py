"""Pipelines, boosted trees, kernel machines, neighbours, hierarchies, isolation, searches and explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenframe.operators import learners as N
from lumenframe.plans.registry import Registry
from lumenframe.plans.statistics import rounded
from lumenframe.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

@query(
    "pipeline_impute_scale",
    "WITH p AS (SELECT p_partkey, p_retailprice::DOUBLE AS r, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS s FROM part), i AS (SELECT p_partkey, r, coalesce(s, avg(s) OVER ()) AS s FROM p) "
    "SELECT p_partkey, round((s - avg(s) OVER ()) / stddev_pop(s) OVER (), 6) AS s, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 6) AS r FROM i",
)
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("s"), F.col("p_retailprice").cast("double").alias("r"))
    return rounded(N.Pipeline([("fill", N.Impute(["s"])), ("scale", N.Scale(["s", "r"]))]).fit_transform(part))



@query("column_transformer", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS p_brand FROM part")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_brand")
    return rounded(N.ColumnTransformer([("scale", N.Scale(["p_size"]), ["p_size"]), ("code", N.Ordinal(["p_brand"]), ["p_brand"])]).fit_transform(part))


@query("feature_union", "SELECT p_partkey, p_size::DOUBLE AS p_size, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS scaled_p_size, (p_size * 2)::DOUBLE AS doubled_p_size FROM part")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return rounded(N.FeatureUnion([("scaled", N.Scale(["p_size"])), ("doubled", N.Apply({"p_size": "p_size * 2"}))], ["p_size"]).fit_transform(part))


@query("feature_generator", "SELECT p_partkey, round(ln(1 + p_size), 6) AS log_p_size, round(sqrt(p_size), 6) AS sqrt_p_size, (p_size * p_size)::DOUBLE AS square_p_size, round(p_size * p_retailprice, 4)::DOUBLE AS product FROM part")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    out = N.FeatureGenerator(["p_size", "p_retailprice"]).transform(part)
    return rounded(out.select("p_partkey", "log_p_size", "sqrt_p_size", "square_p_size", F.round("p_size_x_p_retailprice", 4).alias("product")))


@query("radius_neighbours", "WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, (p_retailprice / 10)::DOUBLE AS y FROM part) SELECT q.id AS query, p.id, round(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)), 6) AS distance FROM p, p q WHERE q.id % 50 = 0 AND power(p.x - q.x, 2) + power(p.y - q.y, 2) <= 9")
def _(spark, d):
    points = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).cast("double").alias("y"))
    return N.within_radius(points, points.filter("id % 50 = 0"), "id", ["x", "y"], 3.0, digits=6)


@query("kd_leaves")
def _(spark, d):
    """Rows a leaf of a tree of sixteen."""
    leaves, _ = N.kd_order(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 16)
    return leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


def _line(spark, d):
    return table(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), "l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")], (F.col("l_returnflag") == "R").cast("double").alias("returned"))


for _kind in ("hist", "oblivious", "additive"):

    @query(f"{_kind}_boosting_regressor")
    def _(spark, d, kind=_kind):
        line = _line(spark, d)
        model = N.Boosted(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", kind, trees=6, bins=16).fit(line.filter("l_orderkey % 5 <> 0"))
        return model.transform(line.filter("l_orderkey % 5 = 0")).select("l_orderkey", "l_linenumber", "l_extendedprice", "prediction")

    @query(f"{_kind}_boosting_classifier")
    def _(spark, d, kind=_kind):
        line = _line(spark, d).withColumn("dear", (F.col("l_extendedprice") > 30_000).cast("double"))
        model = N.Boosted(["l_quantity", "l_discount", "l_tax"], "dear", kind, "logistic", trees=6, bins=16).fit(line.filter("l_orderkey % 5 <> 0"))
        return model.transform(line.filter("l_orderkey % 5 = 0")).select("l_orderkey", "l_linenumber", "dear", "probability", "prediction")


@query("support_vector_regressor")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("x"), (F.col("p_partkey") % 10 / 10).alias("z")).withColumn("y", F.col("x") * F.col("x") - F.col("z"))
    return N.KernelMachine(["x", "z"], "y", "regressor", epsilon=0.02, steps=40).fit(part).transform(part).select("p_partkey", "y", "prediction")


@query("support_vector_kernel")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 25 - 1).alias("x"), (F.col("p_partkey") % 21 / 10 - 1).alias("z")).withColumn("inside", (F.col("x") * F.col("x") + F.col("z") * F.col("z") < 0.6).cast("double"))
    return N.KernelMachine(["x", "z"], "inside", "classifier", gamma=1.0, steps=40).fit(part).transform(part).select("p_partkey", "inside", "prediction")


@query("isolation_forest")
def _(spark, d):
    return N.IsolationForest(["l_quantity", "l_extendedprice"], "key", 25, 128).fit_transform(_line(spark, d)).select("l_orderkey", "l_linenumber", "anomaly_score")


@query("hnsw_neighbours")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return N.hnsw_search(rows, rows.filter("id % 50 = 0"), 5)


@query("agglomerative_clusters")
def _(spark, d):
    rows = N.sampled(table(spark, d, "supplier"), ["s_acctbal", "s_nationkey"], "s_suppkey", 1000)
    points = rows[["s_acctbal", "s_nationkey"]].to_numpy(float)
    labels, _ = N.agglomerate((points - points.mean(0)) / points.std(0), 5, "ward")
    return spark.createDataFrame(list(zip(rows["s_suppkey"].tolist(), labels.tolist(), strict=True)), "s_suppkey long, cluster int")


@query("tsne_map")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(300).toPandas()
    places = N.tsne(np.stack(rows["embedding"].to_numpy()).astype(float), 15, 150)
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(rows["vec_id"], places, strict=True)], "vec_id long, x double, y double")


@query("random_search")
def _(spark, d):
    _, tried = N.random_search_cv(_line(spark, d), lambda rate, depth: N.Boosted(["l_quantity", "l_tax"], "l_extendedprice", trees=3, depth=depth, rate=rate, bins=8), {"rate": (0.2, 0.9), "depth": [1, 2, 3]}, 2, "l_extendedprice", "key", 2)
    return spark.createDataFrame([(float(s["rate"]), int(s["depth"]), score) for s, score in tried], "rate double, depth int, score double")


@query("model_choice")
def _(spark, d):
    make = lambda kind: lambda depth: N.Boosted(["l_quantity", "l_tax"], "l_extendedprice", kind, trees=3, depth=depth, bins=8)
    _, _, tried = N.pipeline_optimize(_line(spark, d), {k: (make(k), {"depth": [2]}) for k in ("hist", "oblivious")}, 1, "l_extendedprice", "key")
    return spark.createDataFrame([(n, int(s["depth"]), score) for n, s, score in tried], "model string, depth int, score double")


@query("tree_shap")
def _(spark, d):
    columns = ["l_quantity", "l_discount", "l_tax"]
    line = _line(spark, d)
    model = N.Boosted(columns, "l_extendedprice", trees=4, bins=8).fit(line)
    rows = N.sampled(line, columns, "key", 40)[columns].to_dict("records")
    out = [(k, f, v) for k, row in enumerate(rows[:5]) for f, v in N.tree_shap(model, row, rows[5:]).items()]
    return spark.createDataFrame(out, "row int, feature string, shap double")


@query("kernel_shap_lime")
def _(spark, d):
    columns = ["l_quantity", "l_discount", "l_tax"]
    rows = N.sampled(_line(spark, d), columns, "key", 60)[columns].to_numpy(float)
    predict = lambda x: 3 * x[:, 0] - 50 * x[:, 1] + 20 * x[:, 2]
    shap = N.kernel_shap(predict, rows[0], rows[1:])
    _, near = N.lime(predict, rows[0], rows.std(0))
    return spark.createDataFrame([(c, float(a), float(b)) for c, a, b in zip(columns, shap, near, strict=True)], "feature string, shap double, lime double")
