import json
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.sources import connectors, text_formats
from lumenframe.sources.delta import read_delta
from lumenframe.streaming import running as R

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_types_nulls_and_quotes(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b,c,d,e\n1,1.5,true,"line1\nline2",MISSING\n2,,False,"he said ""hi""",x\n-3,NA,True,plain,\n')
    df = text_formats.read_csv(spark, str(p), null_values=["MISSING"])
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}
    assert rows(df) == [(1, 1.5, True, "line1\nline2", None), (2, None, False, 'he said "hi"', "x"), (-3, None, True, "plain", None)]


def test_csv_forms(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("# note\n1;x\n 2 ; y \n")
    df = text_formats.read_csv(spark, str(p), sep=";", header=False, comment="#", trim=True)
    assert df.columns == ["column_0", "column_1"] and rows(df) == [(1, "x"), (2, "y")]
    assert rows(text_formats.read_csv(spark, str(p), sep=";", header=False, comment="#", trim=True, names=["k", "v"], types={"k": "string"}, max_rows=1)) == [("1", "x")]
    q = tmp_path / "c.csv"
    q.write_text("junk\nmore junk\na,b\n1,2\n")
    assert rows(text_formats.read_csv(spark, str(q), skip_rows=2)) == [(1, 2)]
    text_formats.write_csv(spark.createDataFrame([(1, None), (2, 'a"b')], "k int, v string"), str(tmp_path / "out"), quote="always")
    assert rows(text_formats.read_csv(spark, str(tmp_path / "out")).orderBy("k")) == [(1, None), (2, 'a"b')]


def test_json_forms(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1, "b": None}, {"a": None, "b": 2}]))
    (tmp_path / "c.json").write_text(json.dumps({"a": [1, None, 3], "b": [None, "hello", None]}))
    assert rows(text_formats.read_json(spark, str(tmp_path / "r.json"))) == [(1, None), (None, 2)]
    assert rows(text_formats.read_json(spark, str(tmp_path / "c.json"), "columns")) == [(1, None), (None, "hello"), (3, None)]
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").coalesce(1)
    assert json.loads(text_formats.to_json_document(df).first()[0]) == [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    assert json.loads(text_formats.to_json_document(df, "columns").first()[0]) == {"a": [1, 2], "b": ["x", None]}
    text_formats.write_json(df, str(tmp_path / "w"))
    assert sorted(rows(spark.read.json(str(tmp_path / "w")))) == [(1, "x"), (2, None)]


def test_delta_snapshots(spark, tmp_path):
    top = tmp_path / "t"
    (top / "_delta_log").mkdir(parents=True)
    for k in range(3):
        spark.range(k * 10, k * 10 + 2).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        next((tmp_path / f"p{k}").glob("*.parquet")).rename(top / f"f{k}.parquet")
    logs = [[{"add": {"path": "f0.parquet"}}, {"add": {"path": "f1.parquet"}}], [{"remove": {"path": "f0.parquet"}}], [{"add": {"path": "f2.parquet"}}, {"commitInfo": {}}]]
    for v, acts in enumerate(logs):
        (top / "_delta_log" / f"{v:020d}.json").write_text("\n".join(map(json.dumps, acts)))
    read = lambda v=None: sorted(r[0] for r in read_delta(spark, str(top), v).collect())
    assert read() == [10, 11, 20, 21] and read(0) == [0, 1, 10, 11] and read(1) == [10, 11]


def test_connectors(spark, tmp_path):
    connectors.register(spark)
    np.save(tmp_path / "m.npy", np.arange(6).reshape(3, 2))
    got = spark.read.format("npy").option("path", str(tmp_path / "m.npy")).load()
    assert [r["values"] for r in got.orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for stream in (False, True):
        path = str(tmp_path / f"x{stream}.arrow")
        connectors.write_arrow(df, path, stream)
        assert sorted(rows(spark.read.format("arrow_ipc").option("path", path).load())) == [(1, "a"), (2, None)]
    db = str(tmp_path / "d.sqlite")
    connectors.write_sqlite(df, db, "t")
    connectors.write_sqlite(df, db, "t", "append")
    with pytest.raises(ValueError, match="already"):
        connectors.write_sqlite(df, db, "t")
    assert sqlite3.connect(db).execute("SELECT count(*) FROM t").fetchone() == (4,)
    got = spark.read.format("sqlite").options(path=db, query="SELECT k, v FROM t", partitionColumn="k", lowerBound="0", upperBound="4", numPartitions="3").load()
    assert sorted(rows(got), key=str) == [(1, "a"), (1, "a"), (2, None), (2, None)]
    assert pa.__version__


@pytest.fixture
def events(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "ev"))
    return ev, str(tmp_path / "ev")


def test_streams_equal_batches(spark, events, tmp_path):
    ev, path = events
    stream = R.stream(spark, path, ev.schema)
    got = R.run_once(R.running_moments(stream, ["event_type"]), "moments", "complete", str(tmp_path / "c1"))
    key = lambda x: x[0]
    for a, b in zip(sorted(rows(got), key=key), sorted(rows(R.running_moments(ev, ["event_type"])), key=key), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:])
    window = lambda x: R.windowed(x, ["event_type"], "1 day")
    got = R.run_once(window(stream), "windows", "complete", str(tmp_path / "c2"))
    assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in rows(got)) == sorted((r[0], r[1], r[2], round(r[3], 6)) for r in rows(window(ev)))
    got = R.run_once(R.sessions(stream, "user_id", "4 hours", "60 days"), "sessions", "complete", str(tmp_path / "c3"))
    assert sorted(rows(got)) == sorted(rows(R.sessions(ev, "user_id", "4 hours")))


def test_ewm_state(spark, events, tmp_path):
    from lumenframe.operators.series import ewm

    ev, path = events
    got = R.run_once(R.running_ewm(R.stream(spark, path, ev.schema, 10), "user_id", "event_id", "value", 0.3), "ewm", "update", str(tmp_path / "c"))
    last = {k: m for k, _, m in sorted(rows(got), key=lambda r: r[1])}
    for user, values in ev.orderBy("event_id").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])).collect():
        assert last[user] == pytest.approx(ewm(np.array(values), 0.3)[-1])


def test_online_models(spark):
    df = spark.range(400).selectExpr("id", "(id % 20) / 10.0D AS x").withColumn("y", 3 * F.col("x") - 1).withColumn("label", (F.col("x") > 1).cast("double"))
    model = R.OnlineLinear(["x"], "y", 0.3)
    logistic = R.OnlineLinear(["x"], "label", 2.0, logistic=True)
    for _ in range(90):
        model.partial_fit(df)
        logistic.partial_fit(df)
    assert np.allclose(model.weights, [-1, 3], atol=0.1)
    assert df.filter((logistic.predict() > 0.5) == (F.col("label") == 1)).count() > 360
    means = R.OnlineKMeans(["x"], [[0.0], [2.0]])
    for _ in range(3):
        means.partial_fit(df)
    assert np.allclose(means.centers.ravel(), [0.45, 1.45], atol=0.15)
