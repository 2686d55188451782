"""Graph queries on keys and sizes that the tables given don't have."""

import random

import duckdb
import numpy as np

from lumenframe.operators import graph
from lumenframe.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components_of_nations_at_keys_of_any_size(spark, tmp_path):
    customers = [(k, n) for k, n in [(1, 1), (99_999, 1), (100_001, 2), (150_000, 2), (900_000, 3), (100_003, 3), (7, None), (8, 4)]]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(150_007, 1), (3, 1), (200_002, 2), (300_000, 2), (9, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(SQL["components_of_nations"]).fetchall(), key=repr)
    assert rows(QUERIES["components_of_nations"](spark, str(tmp_path)).select("node", "component")) == want


def strong(pairs):
    """Components by plain reachability."""
    seen = {x: {x} for p in pairs for x in p}
    grown = True
    while grown:
        grown = False
        for a, b in pairs:
            if not seen[b] <= seen[a]:
                seen[a] |= seen[b]
                grown = True
    return sorted((a, min(b for b in seen[a] if a in seen[b])) for a in seen)


def no_group_in_one_task(monkeypatch):
    """Grouped pandas functions hold a group in one task's memory; with this they are an error."""
    from pyspark.sql import GroupedData

    def refuse(*_, **__):
        raise AssertionError("a group in one task")

    monkeypatch.setattr(GroupedData, "applyInPandas", refuse)


def test_strong_components_without_a_component_in_one_task(spark, monkeypatch):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 5), (5, 6), (6, 5), (6, 8), (8, 9), (7, 7), (9, 9)]
    r = random.Random(3)
    thin = [(r.randrange(300), r.randrange(300)) for _ in range(420)]
    assert rows(graph.strong_components(spark.createDataFrame(thin, "src long, dst long"))) == sorted(strong(thin), key=repr)
    no_group_in_one_task(monkeypatch)
    assert rows(graph.strong_components(spark.createDataFrame(pairs, "src long, dst long"), small=-1)) == sorted(strong(pairs), key=repr)


def test_matching_by_key_writes_no_links_out(spark, monkeypatch):
    left = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "src long, nation int")
    right = spark.createDataFrame([(1, 1), (8, 2), (9, None)], "dst long, nation int")
    assert graph.matching_by_key(left, right, "nation").count() == 2  # node 2 has two keys
    no_group_in_one_task(monkeypatch)
    left = spark.createDataFrame([(i, i % 3) for i in range(3000)] + [(5000, 7), (5001, None)], "src long, nation int")
    right = spark.createDataFrame([(i, 1) for i in range(1500)] + [(i, 2) for i in range(2000, 2400)] + [(9, None), (4000, 5)], "dst long, nation int")
    got = graph.matching_by_key(left, right, "nation").collect()
    assert len(got) == 1400 and len({r.src for r in got}) == len({r.dst for r in got}) == 1400
    assert all(r.src % 3 == (1 if r.dst < 1500 else 2) for r in got)


def cut_of(edges, source, sink):
    """The least capacity of any cut, over all of them."""
    others = sorted({x for a, b, _ in edges for x in (a, b)} - {source, sink})
    sides = ({source, *(x for i, x in enumerate(others) if bits >> i & 1)} for bits in range(2 ** len(others)))
    return min(sum(w for a, b, w in edges if a in side and b not in side) for side in sides)


def test_max_flow_holds_only_the_ways_found_in_one_task(spark, monkeypatch):
    held, inner = [], graph._flows
    monkeypatch.setattr(graph, "_flows", lambda part, *ends: (held.append(part.count()), inner(part, *ends))[1])
    r = random.Random(5)
    edges = [(r.randrange(8), r.randrange(8), float(r.randrange(1, 6))) for _ in range(22)]
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long, weight double")
    assert graph.max_flow(frame(edges), 0, 7) == cut_of(edges, 0, 7)
    # the way first found, 0-1-4-7, has to be given back in part
    back = [(0, 1, 1.0), (1, 4, 1.0), (4, 7, 1.0), (0, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 5, 1.0), (5, 6, 1.0), (6, 8, 1.0), (8, 7, 1.0)]
    assert graph.max_flow(frame(back), 0, 7) == cut_of(back, 0, 7) == 2
    held.clear()
    wide = [(0, 1, 2.0), (1, 9, 3.0)] + [(1, i, 1.0) for i in range(10, 400)] + [(i, 9, 1.0) for i in range(10, 400)]
    assert graph.max_flow(frame(wide), 0, 9) == 2 and max(held) == 2
    assert graph.max_flow(frame(wide), 9, 0) == 0


def test_betweenness_deals_a_component_over_tasks(spark):
    r = random.Random(8)
    dense = sorted({(r.randrange(90), r.randrange(90)) for _ in range(1500)})
    pairs = dense + [(i, i + 1) for i in range(200, 240)] + [(300, 300), (400, 401)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()), near.setdefault(b, set())
        if a != b:
            near[a].add(b), near[b].add(a)
    names = sorted(near)
    lists = [[names.index(x) for x in near[v]] for v in names]
    want = dict(zip(names, graph._queue_shares(lists, list(range(len(names)))), strict=True))
    got = {x.node: x.betweenness for x in graph.betweenness(spark.createDataFrame(pairs, "src long, dst long"), batch=20).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    start = np.cumsum([0, *map(len, lists[:90])])
    flat = np.array([x for v in lists[:90] for x in v], np.int32)
    assert np.allclose(graph._level_shares(start, flat, np.arange(90)), [want[v] for v in names[:90]])
