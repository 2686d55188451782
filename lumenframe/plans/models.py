"""Further models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import ml, models
from lumenframe.plans.registry import Registry
from lumenframe.plans.statistics import rounded
from lumenframe.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("dbscan")
def _(spark, d):
    points = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 10).alias("x"), F.col("p_size").cast("double").alias("y"))
    return models.dbscan(points, "p_partkey", ["x", "y"], 2.0, 4)


@query(
    "knn_classify",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT min(vec_id) AS query, arg_min(v, vec_id) AS v FROM v GROUP BY label),
       p AS (SELECT query, vec_id, label, sqrt(list_sum(list_transform(list_zip(q.v, r.v), lambda z: power(z[1] - z[2], 2)))) AS d FROM q, v r), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS n FROM p),
       c AS (SELECT query, label, count(*) AS k FROM n WHERE n <= 7 GROUP BY 1, 2) SELECT query, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY k DESC, label) AS r FROM c) WHERE r = 1""",
)
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    first = rows.groupBy("label").agg(F.min("id").alias("id"), F.min_by("vector", "id").alias("vector"))
    return models.knn_classify(rows, first, 7)


@query("cox_ph")
def _(spark, d):
    ev = table(spark, d, "events").select(F.floor("value").alias("t"), (F.col("event_type") != "error").cast("int").alias("e"), (F.col("user_id") % 2).alias("a"), (F.col("event_id") % 5 / 4).alias("b"))
    return spark.createDataFrame([(n, float(v)) for n, v in zip("ab", models.cox(ev, "t", "e", ["a", "b"]), strict=True)], "term string, coefficient double")


for _family in ("gaussian", "poisson", "binomial"):

    @query(f"glm_{_family}")
    def _(spark, d, family=_family):
        line = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") if family == "gaussian" else F.col("l_linenumber") if family == "poisson" else (F.col("l_returnflag") == "R").cast("double"))
        beta = models.glm(line, "y", ["l_quantity", "l_discount"], family)
        return spark.createDataFrame([(n, float(v)) for n, v in zip(["intercept", "l_quantity", "l_discount"], beta, strict=True)], "term string, coefficient double")


@query("ewma_anomaly")
def _(spark, d):
    return models.ewma_anomaly(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 0.3, 3.0).select("event_id", "anomaly")


@query("seasonal_anomaly")
def _(spark, d):
    return models.seasonal_anomaly(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 5).select("event_id", "anomaly")


@query("vector_autoregression")
def _(spark, d):
    ev = table(spark, d, "events").withColumn("odd", (F.col("event_id") % 9).cast("double"))
    return models.vector_autoregression(ev, ["value", "odd"], ["user_id"], ["event_id"], 1)


@query("metropolis_mean")
def _(spark, d):
    return models.posterior_mean(table(spark, d, "events"), "value", ["event_type"], 600)


@query("grid_search")
def _(spark, d):
    return models.grid_search(table(spark, d, "lineitem"), "linear_regressor", ["l_quantity", "l_tax"], "l_extendedprice", {"regParam": [0.0, 0.1]}, 2)


@query("product_quantiser")
def _(spark, d):
    return models.product_quantise(table(spark, d, "embeddings"), "vec_id", "embedding", 4, 8, 3)


@query("partial_dependence")
def _(spark, d):
    line = table(spark, d, "lineitem")
    model = ml.estimator("tree_regressor", label="l_extendedprice").fit(ml.vectors(line, ["l_quantity", "l_tax"]).select("features", "l_extendedprice"))
    return models.partial_dependence(line.select("l_quantity", "l_tax"), model, ["l_quantity", "l_tax"], "l_quantity", [5, 25, 45])


@query("sessions", "WITH g AS (SELECT event_id, user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 14400000000, true)::INTEGER AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM g")
def _(spark, d):
    return models.sessions_of(table(spark, d, "events"), ["user_id"], "ts", 14400).select("event_id", "session")


@query("permutation_importance")
def _(spark, d):
    line = table(spark, d, "lineitem").withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    model = ml.estimator("linear_regressor", label="l_extendedprice").fit(ml.vectors(line, ["l_quantity", "l_tax"]).select("features", "l_extendedprice"))
    return rounded(ml.permutation_importance(line, model, ["l_quantity", "l_tax"], "l_extendedprice", "key"), 2)
