"""Operators on literal tables: nulls, ties, clashes, and published constants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import scalar, special
from lumenframe.operators import frame, graph, linalg, ml, series, signal, stats, text, timeseries
from lumenframe.operators.validate import Rule, validate


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for bad in (lambda: frame.select(df, ["a", "a"]), lambda: frame.select(df, ["z"]), lambda: frame.drop_columns(df, ["z"]), lambda: frame.rename(df, "a", "b"), lambda: frame.add_column(df, "a", F.lit(1))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("how", "want"), [("inner", 3), ("left", 4 + 1), ("right", 4), ("outer", 6)])
def test_join_counts_and_keys(spark, how, want):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "key string, val int")
    right = spark.createDataFrame([("b", 20), ("c", 30), ("c", 31), ("e", 50)], "key string, val int")
    got = frame.join(left, right, ["key"], how=how)
    assert got.columns == ["key", "val_left", "val_right"] and got.count() == want
    assert all(r.key is not None for r in got.collect())


def test_null_keys_join_only_when_asked(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    b = spark.createDataFrame([(None, 3), (1, 4)], "k int, y int")
    assert rows(frame.join(a, b, ["k"])) == [(1, 2, 4)]
    assert rows(frame.join(a, b, ["k"], null_safe=True)) == [(1, 2, 4), (None, 1, 3)]


def test_pivot_melt_crosstab(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "g string, p string, v double")
    assert rows(frame.pivot(df, ["g"], "p", "v")) == [("a", 1.0, None), ("b", None, 2.0)]
    wide = spark.createDataFrame([("a", 1, 3.5), ("b", 2, None)], "id string, x int, y double")
    assert rows(frame.melt(wide, ["id"])) == [("a", "x", "1"), ("a", "y", "3.5"), ("b", "x", "2"), ("b", "y", None)]
    animals = spark.createDataFrame([("cat", "black"), ("cat", "white"), ("dog", "black")], "animal string, color string")
    assert rows(frame.crosstab(animals, "animal", "color")) == [("cat", 1, 1), ("dog", 1, None)]


def test_orders_and_positions(spark):
    df = spark.createDataFrame([(0, 3), (1, None), (2, 1), (3, 3)], "i int, v int")
    assert [r.v for r in frame.sort_by(df, ["v"]).collect()] == [1, 3, 3, None]
    assert [r.v for r in frame.sort_by(df, ["v"], False).collect()] == [None, 3, 3, 1]
    assert rows(frame.argsort(df, "v", "i").select("i", "position")) == [(0, 1), (1, 3), (2, 0), (3, 2)]
    assert [r.i for r in frame.tail(df, 2, ["i"]).collect()] == [2, 3]


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 4, "a"), (1, 10, "b"), (2, 9, "c")], "k int, t int, v string")
    assert rows(frame.asof_join(left, right, "t", ["k"], ["v"])) == [(1, 10, "b"), (1, 5, "a"), (2, 3, None)]
    points = spark.createDataFrame([(0.5,), (3.0,), (9.9,)], "p double")
    ranges = spark.createDataFrame([(0.0, 3.0), (2.5, 10.0)], "lo double, hi double")
    assert rows(frame.range_join(points, ranges, "p", "lo", "hi", 2.0)) == [(0.5, 0.0, 3.0), (3.0, 2.5, 10.0), (9.9, 2.5, 10.0)]


def test_windows(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, None, 3.0, 5.0, None])], "k int, i int, v double")
    w = series.spec(["k"], ["i"])
    got = df.select("i", series.rolling("v", "mean", 2, w, 1).alias("r"), series.rolling("v", "mean", 2, w).alias("full"), series.expanding("v", "sum", w).alias("e"), series.fill_forward("v", w).alias("f"), series.fill_backward("v", w).alias("b")).orderBy("i").collect()
    assert [r.r for r in got] == [1, 1, 3, 4, 5] and [r.full for r in got] == [None, None, None, 4, None]
    assert [r.e for r in got] == [1, None, 4, 9, None] and [r.f for r in got] == [1, 1, 3, 5, 5] and [r.b for r in got] == [1, 3, 3, 5, None]
    assert [r.x for r in series.interpolate(df, "v", ["k"], ["i"], "x").orderBy("i").collect()] == [1, 2, 3, 5, None]
    assert np.allclose(series.ewm(np.array([1.0, np.nan, 3.0]), 0.5), [1, 1, (0.25 + 3) / 1.25])
    with pytest.raises(ValueError):
        series.ewm(np.array([1.0]), 0)


def test_scalar_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(scalar.divide(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3:] == [2.0, None]
    s = spark.createDataFrame([("2024-02-29T01:02:03Z",), ("2024-02-29",), ("no",)], "s string")
    assert [str(r[0]) for r in s.select(scalar.parse_datetime(F.col("s"))).collect()] == ["2024-02-29 01:02:03", "2024-02-29 00:00:00", "None"]
    t = spark.createDataFrame([([], []), (["a", "b", "a"], ["b", "c"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in t.select(scalar.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, round(1 / 3, 6)]
    assert t.select(scalar.ngrams(F.col("a"), 2)).collect()[1][0] == ["a b", "b a"]


def test_rules(spark):
    df = spark.createDataFrame([(1, "é"), (1, None), (None, "long")], "k int, v string")
    got = validate(df, [Rule("k", "not_null"), Rule("k", "unique"), Rule("v", "max_length", 2), Rule("k", "range", (2, 3)), Rule("v", "one_of", ("é",))])
    assert [r.violations for r in got.collect()] == [1, 1, 1, 2, 1]
    with pytest.raises(ValueError):
        Rule("k", "odd").violations()


def test_distributions():
    assert special.normal_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-10)
    assert special.normal_cdf(1.96) == pytest.approx(0.97500210485178)
    assert special.t_cdf(2.0, 10) == pytest.approx(0.963305983, abs=1e-8)
    assert special.chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95)
    assert special.f_cdf(4.102821015, 2, 10) == pytest.approx(0.95, abs=1e-8)
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248) and special.gamma_p(3, 2) == pytest.approx(0.3233235838)


def test_p_values(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (2.0, 4.0, 6.0, 9.0)], "g string, v double")
    t = stats.t_test_welch(df, "v", "g", "a", "b").first()
    assert t.statistic == pytest.approx(-2.75 / math.sqrt(5 / 12 + 107 / 48)) and 0.1 < t.p_value < 0.2
    f = stats.anova(df, "v", "g").first()
    assert f.statistic == pytest.approx(t.statistic**2) and 0 < f.p_value < 1
    assert stats.log_rank(df.withColumn("e", F.lit(1)), "v", "e", "g", "a").first().p_value < 1


def test_running_sums(spark):
    df = spark.range(0, 500, 1, 7).select(((F.col("id") * 37) % 500).alias("k"), (F.col("id") % 5).alias("v"))
    total, want = 0, []
    for k, v in sorted((r.k, r.v) for r in df.collect()):
        total += v
        want.append((k, v, total))
    assert sorted(tuple(r) for r in frame.running_sums(df, [F.col("k").asc()], {"v": "run"}).collect()) == want
    assert frame.running_sums(df.limit(0), [F.col("k").asc()], {"v": "run"}).count() == 0


@pytest.mark.parametrize(("ka", "kb"), [(1000, 1000), (4, 7), (9, 2), (6, 1)])
def test_kendall_counts_every_pair(spark, ka, kb):
    rng = np.random.default_rng(ka + kb)
    data = list(zip(rng.integers(0, ka, 120).tolist(), rng.integers(0, kb, 120).tolist(), strict=True))
    got = stats.kendall(spark.createDataFrame([*data, (None, 3), (2, None)], "a int, b int"), "a", "b").first().tau
    sign = [(np.sign(x[0] - y[0]), np.sign(x[1] - y[1])) for i, x in enumerate(data) for y in data[:i]]
    scale = math.sqrt(sum(p != 0 for p, _ in sign) * sum(q != 0 for _, q in sign))
    assert got is None if scale == 0 else got == pytest.approx(sum(p * q for p, q in sign) / scale)


def test_models(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 10 as double) AS x", "cast(id % 7 as double) AS z").withColumn("y", 2 * F.col("x") - F.col("z") + 5)
    assert np.allclose(ml.ridge(df, "y", ["x", "z"], 0.0), [5, 2, -1]) and np.allclose(stats.ols_many(df, "y", ["x", "z"]), [5, 2, -1])
    centers = ml.kmeans(df, ["x"], [[0.0], [9.0]])
    assert np.allclose(centers, [[2.0], [7.0]])
    parts, variances = ml.pca(df.withColumn("w", 2 * F.col("x")), ["x", "w"], 2)
    assert variances[1] == pytest.approx(0, abs=1e-9) and np.allclose(parts[0], np.array([1, 2]) / math.sqrt(5))
    model = ml.estimator("linear_regressor", label="y").fit(ml.vectors(df, ["x", "z"]).select("features", "y"))
    importance = {r.feature: r.importance for r in ml.permutation_importance(df, model, ["x", "z"], "y", "id").collect()}
    assert importance["x"] > importance["z"] > 0
    with pytest.raises(ValueError):
        ml.nearest(df, df, 1, most_queries=3)


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "sized": "size", "happy": "happi", "relational": "relat", "rational": "ration", "digitizer": "digit", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "controll": "control"}
    assert {w: text.stem(w) for w in pairs} == pairs


def test_small_graphs(spark):
    edges = spark.createDataFrame([(i, (i + k) % 12, float(1 + i % 5)) for i in range(12) for k in (1, 3, 7)], "src long, dst long, weight double")
    tree = graph.spanning_tree(edges)
    parent, total = list(range(12)), 0.0
    find = lambda x: x if parent[x] == x else find(parent[x])
    for weight, a, b in sorted((r.weight, r.src, r.dst) for r in edges.collect()):
        if find(a) != find(b):
            parent[find(a)], total = find(b), total + weight
    assert tree.count() == 11 and tree.agg(F.sum("weight")).first()[0] == total
    assert graph.shortest_paths(edges, 0).filter("distance < 0").count() == 0
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert rows(graph.betweenness(path)) == [(1, 0.0), (2, 2.0), (3, 2.0), (4, 0.0)]
    assert rows(graph.topological_order(path)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    loop = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert rows(graph.strong_components(loop)) == [(1, 1), (2, 1), (3, 3)]
    with pytest.raises(RuntimeError):
        graph.topological_order(loop)
    flow = spark.createDataFrame([(1, 2, 3.0), (1, 3, 2.0), (2, 4, 2.0), (3, 4, 3.0), (2, 3, 1.0)], "src long, dst long, weight double")
    assert graph.max_flow(flow, 1, 4) == 5.0
    pairs = spark.createDataFrame([(1, 11), (1, 12), (2, 11), (3, 12), (3, 13)], "src long, dst long")
    assert graph.matching(pairs).count() == 3
    assert graph.pagerank(loop, 30).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_signals(spark):
    n = 64
    df = spark.createDataFrame([(0, i, math.sin(2 * math.pi * 8 * i / n)) for i in range(n)], "k int, i int, v double")
    power = {r.frequency: r.power for r in signal.periodogram(df, "v", ["k"], ["i"]).collect()}
    assert max(power, key=power.get) == 0.125
    back = signal.inverse_haar(signal.haar(df, "v", ["k"], ["i"]), ["k"]).orderBy("pos").collect()
    assert np.allclose([r.value for r in back], [r.v for r in df.orderBy("i").collect()])
    assert signal.find_peaks(df, "v", ["k"], ["i"]).count() == 8
    assert np.allclose(signal.lfilter([1.0], [1.0, -0.5], np.array([1.0, 0, 0])), [1, 0.5, 0.25])
    assert signal.window("hann", 5).tolist() == pytest.approx([0, 0.5, 1, 0.5, 0]) and signal.hertz(signal.mel(440.0)) == pytest.approx(440)
    assert signal.resample(df, "v", ["k"], ["i"], 32).count() == 32 and signal.decimate(df, "v", ["k"], ["i"], 4).count() == 16
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "i int, j int, v double")
    assert rows(linalg.matmul(a, a)) == [(0, 0, 1.0), (0, 1, 8.0), (1, 1, 9.0)]
    assert timeseries.holt_winters(np.tile([1.0, 2.0, 3.0, 2.0], 6), 4, 0.3, 0.1, 0.2, 4).tolist() == pytest.approx([1, 2, 3, 2], abs=0.2)


def test_chi_square_counts_every_category(spark, tmp_path):
    from lumenframe.plans import catalog

    counts = [1 + i % 7 for i in range(150)]
    spark.createDataFrame([(f"s{i:03}",) for i, n in enumerate(counts) for _ in range(n)], "c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.queries()["chi_square"](spark, str(tmp_path)).first()
    each = sum(counts) / 150
    want = sum((n - each) ** 2 / each for n in counts)
    assert (got["statistic"], got["df"]) == (pytest.approx(want, abs=1e-5), 149) and got["w"] == pytest.approx(math.sqrt(want / sum(counts)), abs=1e-5)


def test_pivot_refuses_more_values_than_its_bound(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "g string, p int, v double")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError):
            frame.pivot(df, ["g"], "p", "v")
        assert len(frame.pivot(df.filter("p < 3"), ["g"], "p", "v").columns) == 4
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
