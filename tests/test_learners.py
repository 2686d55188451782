"""Learners against plain computations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import learners as N


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    x, z = r.uniform(0, 4, 600), r.uniform(0, 4, 600)
    data = [(i, float(a), float(b) if i % 9 else None, float(3 * (a > 2) + b), float(a + b > 4)) for i, (a, b) in enumerate(zip(x, z, strict=True))]
    return spark.createDataFrame(data, "id long, x double, z double, y double, c double").repartition(3).cache()


@pytest.mark.parametrize("kind", ["hist", "oblivious", "additive"])
def test_boosting_learns_and_agrees_with_its_own_margin(rows, kind):
    model = N.Boosted(["x", "z"], "y", kind, trees=12, bins=16, rate=0.4).fit(rows)
    got = model.transform(rows).collect()
    y, p = np.array([r.y for r in got]), np.array([r.prediction for r in got])
    assert ((y - p) ** 2).mean() < 0.15 * y.var()
    assert max(abs(model.margin_of({"x": r.x, "z": r.z}) - r.prediction) for r in got) < 1e-9
    assert set(model.importances()) == {"x", "z"} and sum(model.importances().values()) > 5
    classes = N.Boosted(["x", "z"], "c", kind, "logistic", trees=10, bins=16).fit(rows).transform(rows)
    assert classes.filter(F.col("prediction") == F.col("c")).count() > 0.85 * 600


def test_first_split_is_the_best_there_is(rows):
    model = N.Boosted(["x"], "y", trees=1, depth=1, bins=8, penalty=0.0).fit(rows)
    data = [(r.x, r.y) for r in rows.collect()]

    def error(edge):
        parts = [[y for x, y in data if (x <= edge) == side] for side in (True, False)]
        return sum(np.var(p) * len(p) for p in parts if p)

    assert model.edges["x"][model.forest[0][1][1]] == min(model.edges["x"], key=error)


def test_shap_values_sum_up_and_match_the_definition(rows):
    model = N.Boosted(["x", "z"], "y", trees=4, bins=8).fit(rows)
    background = [{"x": 1.0, "z": 1.0}, {"x": 3.0, "z": None}]
    row = {"x": 2.5, "z": 3.0}
    phi = N.tree_shap(model, row, background)
    mean = lambda s: np.mean([model.margin_of({c: row[c] if c in s else b[c] for c in "xz"}) for b in background])
    assert abs(phi["x"] - ((mean("x") - mean("")) + (mean("xz") - mean("z"))) / 2) < 1e-9
    assert abs(sum(phi.values()) - (mean("xz") - mean(""))) < 1e-9
    data = np.random.default_rng(2).normal(size=(50, 3))
    predict = lambda a: a[:, 0] * 2 - a[:, 1] + a[:, 0] * a[:, 2]
    value = lambda s: predict(np.where([k in s for k in range(3)], data[0], data[1:])).mean()
    exact = N.shapley(value, range(3))
    assert np.allclose(N.kernel_shap(predict, data[0], data[1:]), [exact[k] for k in range(3)])
    _, w = N.lime(lambda a: 3 * a[:, 0] - a[:, 1], data[0, :2], np.ones(2))
    assert np.allclose(w, [3, -1], atol=1e-3)


def test_kernel_machines(spark):
    r = np.random.default_rng(3)
    data = [(i, float(a), float(b), float(a * a + b * b < 0.5), float(a * a)) for i, (a, b) in enumerate(r.uniform(-1, 1, (400, 2)))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, y double")
    for kernel in ("rbf", "poly"):
        out = N.KernelMachine(["a", "b"], "c", kernel=kernel, gamma=1.5, steps=40).fit_transform(df)
        assert out.filter(F.col("prediction") == F.col("c")).count() > 0.85 * 400
    out = N.KernelMachine(["a"], "y", "regressor", "poly", epsilon=0.02, steps=60).fit_transform(df)
    assert out.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.12


def test_steps_can_be_stored_and_searched(rows, tmp_path):
    line = N.Pipeline([("fill", N.Impute(["z"])), ("scale", N.Scale(["x", "z"])), ("model", N.Boosted(["x", "z"], "y", trees=2, bins=8))]).fit(rows)
    line.save(f"{tmp_path}/line")
    again = N.Step.load(f"{tmp_path}/line")
    assert sorted(r.prediction for r in again.transform(rows).collect()) == sorted(r.prediction for r in line.transform(rows).collect())
    assert line["scale"].state["x"][1] > 0
    scores = N.cross_val_score(rows, lambda: N.Boosted(["x", "z"], "y", trees=3, bins=8, rate=0.6), "y", "id", 2)
    assert len(scores) == 2 and min(scores) > 0.5
    best, tried = N.random_search_cv(rows, lambda trees: N.Boosted(["x"], "y", trees=trees, bins=4), {"trees": [1, 3]}, 2, "y", "id", 2)
    assert best in [s for s, _ in tried] and max(s for _, s in tried) == dict((str(a), b) for a, b in tried)[str(best)]
    coded = N.Ordinal(["id"], most=5)
    with pytest.raises(ValueError):
        coded.fit(rows)


def test_neighbours(spark):
    r = np.random.default_rng(4)
    points = r.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
    found = N.hnsw_search(df, df.filter("id < 40"), 10, cell_rows=600).collect()
    want = {(i, int(j)) for i in range(40) for j in np.argsort(((points - points[i]) ** 2).sum(1))[:10]}
    assert len(found) == 400 and len({(x.query, x.id) for x in found} & want) > 0.9 * 400
    flat = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(points)], "id long, x double, y double")
    got = {(x.query, x.id) for x in N.within_radius(flat, flat.filter("id < 20"), "id", ["x", "y"], 0.3).collect()}
    assert got == {(i, j) for i in range(20) for j in range(1500) if ((points[i, :2] - points[j, :2]) ** 2).sum() <= 0.09}
    leaves, tree = N.kd_order(flat, ["x", "y"], 8)
    sizes = [x["count"] for x in leaves.groupBy("leaf").count().collect()]
    assert len(sizes) == 8 and len(tree) == 7 and min(sizes) > 150


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_agglomeration_against_plain_merging(linkage):
    points = np.random.default_rng(5).normal(size=(24, 2))
    labels, merges = N.agglomerate(points, 4, linkage)
    groups = [[i] for i in range(24)]

    def far(a, b):
        d = [np.linalg.norm(points[i] - points[j]) for i, j in itertools.product(a, b)]
        if linkage == "ward":
            return np.linalg.norm(points[a].mean(0) - points[b].mean(0)) * np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)))
        return {"single": min, "complete": max, "average": np.mean}[linkage](d)

    for _, _, height in merges:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: far(groups[p[0]], groups[p[1]]))
        assert abs(far(groups[a], groups[b]) - height) < 1e-9
        groups[a] += groups.pop(b)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == k).tolist()) for k in range(4)}


def test_maps_and_isolation(spark):
    r = np.random.default_rng(6)
    points = np.concatenate([r.normal(0, 0.3, (40, 5)), r.normal(4, 0.3, (40, 5))])
    y = N.tsne(points, 10, 200)
    between, within = np.linalg.norm(y[:40].mean(0) - y[40:].mean(0)), y[:40].std()
    assert between > 2 * within
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(500, 2)))] + [(1000, 9.0, 9.0), (1001, None, 1.0)]
    got = {x.id: x.anomaly_score for x in N.IsolationForest(["x", "y"], "id", 40, 128).fit_transform(spark.createDataFrame(data, "id long, x double, y double")).collect()}
    assert got[1001] is None and got[1000] == max(v for v in got.values() if v is not None) and got[1000] > 0.6


def test_rows_of_equal_places_meet_once(spark):
    points = [(i, float(i % 7), float(i % 3)) for i in range(300)] + [(900, None, 1.0), (None, 2.0, 2.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = N.within_radius(df, df.filter("id % 50 = 0"), "id", ["x", "y"], 1.5, digits=3)
    want = [(q, i, round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 3)) for q, u, v in points if q is not None and q % 50 == 0 and u is not None for i, x, y in points if x is not None and (x - u) ** 2 + (y - v) ** 2 <= 2.25]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r["count"] for r in N._places(df, "id", ["x", "y"]).groupBy("x", "y").count().collect()} == {1}
