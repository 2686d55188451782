"""The random-projection index against plain distances."""

import numpy as np

from lumenframe.operators import ml


def test_random_projection_search_meets_every_row_and_writes_no_candidates_out(spark):
    x = np.random.default_rng(6).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    model, ready = ml.random_projection_index(df, tables=4, width=0.5)
    found = ml.random_projection_search(model, ready, ready.filter("id % 50 = 0"), 1.2, block=100)
    got = {(r.a, r.b): r.distance for r in found.collect()}
    want = {(a, int(b)): d for a in range(0, 3000, 50) for b, d in enumerate(np.linalg.norm(x - x[a], axis=1)) if d < 1.2 and a != b}
    assert len(got) == found.count() and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(abs(d - want[k]) < 1e-12 for k, d in got.items())
    print("recall", len(got) / len(want))
