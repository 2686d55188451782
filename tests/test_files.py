"""Formats that are read and written in plain Python, and paths."""

import datetime as dt

import numpy as np
import pytest

from lumenframe.operators import labels as L
from lumenframe.sources import files as X


def test_avro_keeps_nested_values_and_nulls(spark, tmp_path):
    ddl = "i int, l long, f float, d double, s string, b binary, t boolean, day date, ts timestamp, a array<long>, m map<string,double>, r struct<x:int,y:string>"
    rows = [(1, 2**40, 1.5, 2.5, "é\n", b"\x00\xff", True, dt.date(1969, 5, 1), dt.datetime(2020, 1, 2, 3, 4, 5, 678901), [1, None, -3], {"k": 1.0, "n": None}, (7, None)), (None,) * 12, (-5, -(2**50), 0.0, -1e300, "", b"", False, dt.date(2200, 1, 1), dt.datetime(1960, 1, 1), [], {}, (None, "z"))]
    df = spark.createDataFrame(rows, ddl)
    for codec in ("null", "deflate"):
        X.write_avro(df.repartition(2), f"{tmp_path}/{codec}", codec)
        back = X.read_avro(spark, f"{tmp_path}/{codec}")
        assert back.columns == df.columns
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert X.parse_schema(X.avro_schema(df.schema)).simpleString() == df.schema.simpleString()
    with pytest.raises(ValueError):
        X.parse_schema('{"type": "record", "name": "r", "fields": [{"name": "u", "type": ["int", "string"]}]}')


def test_avro_in_many_blocks_and_a_broken_one(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, s string").schema
    path = f"{tmp_path}/one.avro"
    assert X.write_avro_file(((i, "x" * (i % 50)) for i in range(10_000)), schema, path, block_rows=333) == 10_000
    assert [r[0] for r in X.avro_rows(path)] == list(range(10_000))
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-1] + b"?")
    with pytest.raises(ValueError):
        list(X.avro_rows(path))


def test_workbook_cells(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    df = spark.createDataFrame([(1.5, "a<b & \"c\"", True, None), (None, " lead", False, None), (-2e10, None, None, None)], "x double, s string, b boolean, n string")
    X.write_excel(df, path, "A & B")
    back = X.read_excel(spark, path)
    assert back.dtypes[:3] == df.dtypes[:3] and [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    with pytest.raises(Exception, match="no sheet"):
        X.read_excel(spark, path, "missing").collect()
    assert [X._column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and X._column_number("AB12") == 27


def test_arrays_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2), (3.0, 4)], "a double, b int")
    X.write_npy(df, f"{tmp_path}/x.npy")
    X.write_npz({"p": df, "q": df.select("a")}, f"{tmp_path}/x.npz")
    assert np.load(f"{tmp_path}/x.npy").tolist() == [[1, 2], [3, 4]] and np.load(f"{tmp_path}/x.npz")["q"].tolist() == [[1], [3]]
    with pytest.raises(ValueError):
        X.write_npy(df, f"{tmp_path}/y.npy", most=3)
    batch = X.tensor_to_record_batch(np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert batch.num_rows == 2 and X.record_batch_to_tensor(batch).tolist() == [[1, 2], [3, 4]]
    assert X.read_parquet_bytes(spark, _parquet(batch)).count() == 2


def _parquet(batch) -> bytes:
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(pa.Table.from_batches([batch]), out)
    return out.getvalue()


def test_duckdb_tables_and_files(spark, tmp_path):
    from lumenframe.sources.connectors import register

    register(spark)
    path, df = f"{tmp_path}/x.db", spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    X.write_duckdb(df, path, "t")
    X.write_duckdb(df, path, "t", "append")
    with pytest.raises(ValueError):
        X.write_duckdb(df, path, "t")
    read = lambda: sorted(map(str, spark.read.format("duckdb_query").option("path", path).option("query", "SELECT * FROM t").load().collect()))
    assert read() == sorted(2 * list(map(str, df.collect())))
    X.write_duckdb(df.limit(1), path, "t", "replace")
    assert len(read()) == 1
    assert X.read_duckdb_file(spark, "/root/testdata/sf0.001/region.parquet").count() == 5
    open(f"{tmp_path}/x.csv", "w").write("a,b\n1,x\n2,y\n")
    assert [tuple(r) for r in X.read_duckdb_file(spark, f"{tmp_path}/x.csv", "csv").collect()] == [(1, "x"), (2, "y")]


def test_codecs_and_paths(spark, tmp_path):
    df = spark.range(10)
    for f, codecs in ((X.write_parquet, X.PARQUET_CODECS), (X.write_orc, X.ORC_CODECS)):
        with pytest.raises(ValueError):
            f(df, f"{tmp_path}/no", "lzma")
        for codec in codecs[:3]:
            f(df, f"{tmp_path}/{f.__name__}{codec}", codec)
    assert X.read_orc(spark, f"{tmp_path}/write_orczlib").count() == 10 and X.read_parquet(spark, f"{tmp_path}/write_parquetsnappy", batch_size=100).count() == 10
    assert X.CloudPath.parse("s3://b/k/x.csv") == X.CloudPath("s3", "b", "k/x.csv") and X.CloudPath.parse("s3://b/k").spark() == "s3a://b/k"
    assert X.CloudPath.parse("/a/b").spark() == "/a/b" and X.CloudPath.parse("gs://b/").provider == "gcs"
    for bad in ("ftp://x/y", "s3:///k"):
        with pytest.raises(ValueError):
            X.CloudPath.parse(bad)
    open(f"{tmp_path}/bytes", "wb").write(b"abc")
    assert X.cloud_read_bytes(f"{tmp_path}/bytes") == b"abc"
    with pytest.raises(ValueError):
        X.cloud_read_bytes(f"{tmp_path}/bytes", most=2)


def test_frames_and_indexes(spark):
    df = L.from_series(spark, a=[1, 2, 2], s=["x", None, "y"])
    assert L.shape(df) == (3, 2) and L.n_groups(df, ["a"]).first()[0] == 2 and L.n_unique(df, "s").first()[0] == 2
    with pytest.raises(TypeError):
        L.column_typed(df, "a", "string")
    with pytest.raises(KeyError):
        L.column_typed(df, "z", "string")
    with pytest.raises(ValueError):
        L.from_series(spark, a=[1], b=[1, 2])
    index = L.MultiIndex.from_tuples(spark, ["x", "y"], [("b", "q"), ("a", "p")])
    assert [tuple(r) for r in index.get_label(1).collect()] == [("a", "p")] and index.select(0, "b").count() == 1
    assert index.droplevel("x").levels == ("y",) and index.swap_levels(0, 1).levels == ("y", "x")
    with pytest.raises(ValueError):
        index.droplevel(0).droplevel(0)
