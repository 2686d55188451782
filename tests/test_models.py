import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import models


def test_dbscan(spark):
    points = [(i, 0.1 * i, 0.0) for i in range(10)] + [(20 + i, 5.0, 0.1 * i) for i in range(8)] + [(50, 9.0, 9.0), (51, -0.45, 0.0)] + [(60 + i, 0.05, 0.0) for i in range(30)]
    df = spark.createDataFrame(points, "k long, x double, y double")
    got = {r.k: (r.cluster, r.core) for r in models.dbscan(df, "k", ["x", "y"], 0.5, 4).collect()}
    assert {got[i][0] for i in range(10)} == {0} and {got[20 + i][0] for i in range(8)} == {20}
    assert got[50] == (None, False) and got[51] == (0, False) or got[51] == (0, True)
    assert len(got) == len(points)


def test_glm_and_cox(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=3000)
    rows = [(float(a), float(r.poisson(math.exp(0.5 + 0.3 * a))), float(r.random() < 1 / (1 + math.exp(-(0.2 + a)))), float(np.ceil(10 * r.exponential(1 / math.exp(0.7 * a)))), int(r.random() < 0.8)) for a in x]
    df = spark.createDataFrame(rows, "x double, n double, b double, t double, e int")
    assert np.allclose(models.glm(df, "n", ["x"], "poisson"), [0.5, 0.3], atol=0.06)
    assert np.allclose(models.glm(df, "b", ["x"], "binomial"), [0.2, 1.0], atol=0.15)
    assert models.cox(df, "t", "e", ["x"])[0] == pytest.approx(0.7, abs=0.1)


def test_posterior(spark):
    df = spark.range(2000).selectExpr("id % 2 AS g", "cast(id % 17 AS double) AS v")
    got = {r.g: r for r in models.posterior_mean(df, "v", ["g"], 1500).collect()}
    for g, want in df.groupBy("g").agg(F.avg("v")).collect():
        assert got[g]["mean"] == pytest.approx(want, abs=0.15) and got[g]["r_hat"] < 1.1


def test_anomalies(spark):
    values = [(0, i, 1.0 + 0.01 * (i % 3)) for i in range(40)]
    values[30] = (0, 30, 9.0)
    df = spark.createDataFrame(values, "k int, i int, v double")
    assert [r.i for r in models.ewma_anomaly(df, "v", ["k"], ["i"], 0.3, 4.0).filter("anomaly").collect()] == [30]
    assert 30 in [r.i for r in models.seasonal_anomaly(df, "v", ["k"], ["i"], 3).filter("anomaly").collect()]


def test_product_quantiser_is_near(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(2, 8)) * 5
    rows = [(i, [float(v) for v in centers[i % 2] + r.normal(size=8) * 0.1]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    codes = {}
    for x in models.product_quantise(df, "k", "v", 2, 2, 5).collect():
        codes.setdefault((x.part, x.code), set()).add(x.k % 2)
    assert len(codes) >= 3


def test_lda_topics_take_words_of_few_documents(spark, tmp_path):
    from lumenframe.plans import catalog

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(60)]  # 6000 words of one document each
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["lda_topics"](spark, str(tmp_path)).collect()
    assert len(got) == 4 and max(i for r in got for i in r["termIndices"]) >= 5000
