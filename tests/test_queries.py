"""Every registered query of the engine against its DuckDB twin, on the smallest tables; the others against invariants."""

import duckdb
import pytest

from lumenframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    rows = [tuple(plain(r[i]) for i in order) for r in want.fetchall()]
    assert sorted((tuple(map(plain, r)) for r in got), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 5
    assert set(e.oracle_sql()) <= set(e.queries())
