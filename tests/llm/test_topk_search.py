import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import topk_search as ts


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], defaultdict(list)
    for q, a in good:
        if q % 50 == 0:
            asked[q] += [(-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in good if c != q and len(b) == len(a)]
    for q, scores in asked.items():
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "queries"), [(4096, 65536), (37, 3)])
def test_against_brute_force(spark, block, queries):
    r = random.Random(block)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, None), (2050, []), (2100, [None] * 8), (2150, [math.nan] + [0.0] * 7), (2200, [math.inf] * 8), (None, rows[1][1]), (100, rows[100][1]), (150, rows[7][1]), (7, rows[8][1]), (3000, [1.0, 2.0]), (3001, [0.5, 0.5]), (3050, [0.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = ts.search(ts.integers(vectors), F.col("vec_id") % 50 == 0, 5, block, queries)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect()) == brute(rows)


def test_fewer_candidates_and_none(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    found = ts.search(ts.integers(vectors), F.col("vec_id") % 50 == 0)
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect()] == [(0, 1, 1, 256 * 128)]
    assert ts.search(ts.integers(vectors.limit(0)), F.col("vec_id") % 50 == 0).collect() == []


def test_reading_stops_early_where_lists_allow():
    r = np.random.default_rng(1)
    vectors = np.floor(r.normal(0, 30, (4000, 6)))
    vectors[:10, 0] = 5000
    queries = np.zeros((3, 6))
    queries[:, 0] = 100
    q, c, s, read = ts.search_block(np.array([-1, -2, -3]), queries, ts.Lists(np.arange(4000), vectors), 5)
    assert sorted(zip(q.tolist(), c.tolist(), s.tolist(), strict=True)) == [(a, b, 500_000.0) for a in range(3) for b in range(5)]
    assert (read < 0.2).all()


def test_a_known_bar_saves_reading_and_nothing_is_lost():
    r = np.random.default_rng(2)
    vectors = np.floor(256 * r.normal(0, 0.125, (4096, 64)))
    queries, lists = vectors[:20] + 0.0, ts.Lists(np.arange(4096), vectors)
    scores = queries @ vectors.T
    scores[np.arange(20), np.arange(20)] = -np.inf
    want = [(i, int(c)) for i in range(20) for c in np.lexsort((np.arange(4096), -scores[i]))[:5]]
    alone = ts.search_block(np.arange(20), queries, lists, 5)
    told = ts.search_block(np.arange(20), queries, lists, 5, np.sort(scores, 1)[:, -5])
    for q, c, _, _ in (alone, told):
        assert list(zip(q.tolist(), c.tolist(), strict=True)) == want
    assert told[3].mean() < alone[3].mean() < 0.95


def test_query_reports_what_was_read(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = ts.search(ts.integers(vectors), F.col("vec_id") % 50 == 0, block=128).collect()
    assert found and all(0 < x.entries_read <= 1 for x in found) and np.mean([x.entries_read for x in found]) < 0.95
