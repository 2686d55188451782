"""Integrals, roots and splines against closed forms and dense solutions; distances against a plain triple loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import graph, numerics


def test_integrals(spark):
    assert numerics.integrate_simpson(spark, lambda x: x**3, 0, 2, 10).first().integral == pytest.approx(4.0)
    assert numerics.integrate_trapezoid(spark, F.sin, 0, math.pi, 2000).first().integral == pytest.approx(2.0, abs=1e-5)
    with pytest.raises(ValueError):
        numerics.integrate_simpson(spark, F.sin, 0, 1, 3)


def test_roots(spark):
    df = spark.createDataFrame([(2.0, 0.0, 3.0), (9.0, 0.0, 3.0), (0.0, 0.0, 3.0), (50.0, 0.0, 3.0), (None, 0.0, 3.0), (4.0, 5.0, 0.0)], "v double, a double, b double")
    got = [r.root for r in numerics.roots(df, lambda x, v: x * x - v, ["v"], "a", "b").collect()]
    assert got[:3] == pytest.approx([math.sqrt(2), 3.0, 0.0]) and got[3] is None and got[4] is None and got[5] == pytest.approx(2.0)


def test_spline_is_natural(spark):
    x, y = np.array([0.0, 1.0, 2.5, 4.0, 7.0]), np.array([1.0, 3.0, -2.0, 0.5, 4.0])
    n, h = len(x), np.diff(x)
    system, right = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    assert np.allclose(numerics.spline_slopes(x, y), np.linalg.solve(system, right)) and np.allclose(numerics.spline_at(x, y, x), y)
    points = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y, strict=True)] + [("b", 0.0, 0.0), ("b", 2.0, 4.0), ("b", None, 1.0)], "g string, x double, y double")
    places = spark.createDataFrame([("a", 2.5), ("b", 1.0), ("c", 1.0), ("b", None)], "g string, x double")
    got = {(r.g, r.x): r.value for r in numerics.cubic_spline(points, places, "x", "y", ["g"]).collect()}
    assert got[("a", 2.5)] == pytest.approx(-2.0) and got[("b", 1.0)] == pytest.approx(2.0) and got[("c", 1.0)] is None and got[("b", None)] is None


@pytest.mark.parametrize("directed", [True, False])
def test_all_pairs_paths(spark, directed):
    rng = np.random.default_rng(3)
    data = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 12, 25), rng.integers(0, 12, 25), rng.integers(1, 20, 25), strict=True)]
    names = {v for a, b, _ in data for v in (a, b)}
    best = {(a, b): 0.0 if a == b else math.inf for a in names for b in names}
    for a, b, w in data + ([] if directed else [(b, a, w) for a, b, w in data]):
        best[a, b] = min(best[a, b], w)
    for k in names:
        for a in names:
            for b in names:
                best[a, b] = min(best[a, b], best[a, k] + best[k, b])
    got = {(r.src, r.dst): r.distance for r in graph.all_pairs_paths(spark.createDataFrame(data, "src int, dst int, weight double"), directed).collect()}
    assert got == {k: v for k, v in best.items() if v < math.inf}


def test_negative_cycles_raise(spark):
    with pytest.raises(RuntimeError):
        graph.all_pairs_paths(spark.createDataFrame([(1, 2, 1.0), (2, 1, -3.0)], "src int, dst int, weight double"), directed=True)
