"""Formats without a reader in Spark, as Python data sources: npy, arrow_ipc, sqlite and duckdb_query; JDBC options by name.

register(spark) makes them available to spark.read.format(...). A file is one partition; options of a database query may name a
numeric column and its bounds to read it in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _paths(options: dict) -> list[str]:
    import glob

    return sorted(glob.glob(options["path"])) or [options["path"]]


class _ArrowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _paths(self.options)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from read_ipc(partition.path)


def read_ipc(path: str) -> Iterator[pa.RecordBatch]:
    """Batches of an Arrow file or stream."""
    with pa.memory_map(path) as f:
        if f.read(6) == b"ARROW1":
            reader = pa.ipc.open_file(f)
            yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
        else:
            f.seek(0)
            yield from pa.ipc.open_stream(f)


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        return from_arrow_schema(next(read_ipc(_paths(self.options)[0])).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowReader(self.options)


class _NpyReader(_ArrowReader):
    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import numpy as np

        loaded = np.load(partition.path, mmap_mode="r")
        arrays = loaded.items() if hasattr(loaded, "items") else [("", loaded)]
        for name, array in arrays:
            rows = array.reshape(len(array), -1) if array.ndim else array.reshape(1, 1)
            for k in range(0, len(rows), 10_000):
                part = rows[k : k + 10_000].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(part)), pa.array([name] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["path", "array", "row", "values"])


class NpySource(DataSource):
    """Rows (path, array, row, values) of .npy and .npz files; files are mapped, not loaded whole."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, array string, row long, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpyReader(self.options)


class _Slice(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _QueryReader(DataSourceReader):
    def __init__(self, options: dict, connect: str):
        self.options, self.connect = options, connect

    def partitions(self) -> list[_Slice]:
        query, column = self.options["query"], self.options.get("partitioncolumn")
        if not column:
            return [_Slice(query)]
        low, high, n = float(self.options["lowerbound"]), float(self.options["upperbound"]), int(self.options["numpartitions"])
        edges = [low + (high - low) * k / n for k in range(1, n)]
        tests = [f"{column} < {edges[0]} OR {column} IS NULL", *[f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:], strict=False)], f"{column} >= {edges[-1]}"] if edges else ["1 = 1"]
        return [_Slice(f"SELECT * FROM ({query}) q WHERE {t}") for t in tests]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with _open(self.connect, self.options["path"]) as c:
            cursor = c.execute(partition.query)
            while rows := cursor.fetchmany(10_000):
                yield from map(tuple, rows)


class _open:  # noqa: N801
    def __init__(self, kind: str, path: str):
        if kind == "sqlite":
            import sqlite3

            self.c = sqlite3.connect(path)
        else:
            import duckdb

            self.c = duckdb.connect(path, read_only=path != ":memory:")

    def __enter__(self):
        return self.c

    def __exit__(self, *_):
        self.c.close()


class SqliteSource(DataSource):
    """Options path, query; types are those of the first row's values unless a schema is given."""

    kind = "sqlite"

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _open(self.kind, self.options["path"]) as c:
            cursor = c.execute(f"SELECT * FROM ({self.options['query']}) q LIMIT 1")
            names, row = [x[0] for x in cursor.description], cursor.fetchone()
        kinds = {int: "long", float: "double", bytes: "binary", bool: "boolean"}
        return ", ".join(f"`{n}` {kinds.get(type(v), 'string')}" for n, v in zip(names, row or [None] * len(names), strict=True))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _QueryReader(self.options, self.kind)


class DuckSource(SqliteSource):
    kind = "duckdb"

    @classmethod
    def name(cls) -> str:
        return "duckdb_query"


def register(spark: SparkSession) -> None:
    for source in (ArrowSource, NpySource, SqliteSource, DuckSource):
        spark.dataSource.register(source)


#: Driver classes by kind of database.
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver"}


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query by JDBC; the driver's jar is to be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, driver=DRIVERS[url.split(":")[1]], **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "fail", **options: str) -> None:
    """if_exists: fail, replace or append."""
    mode = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists]
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, driver=DRIVERS[url.split(":")[1]], **options).save()


def write_arrow(df: DataFrame, path: str, stream: bool = False, batch: int = 50_000) -> None:
    """One local file, batch by batch, a partition at a time on the driver; for results that are to leave the cluster."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, names, held = to_arrow_schema(df.schema), df.columns, []
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(path, schema) as out:
        for row in df.toLocalIterator():
            held.append(dict(zip(names, row, strict=True)))
            if len(held) == batch:
                out.write_batch(pa.RecordBatch.from_pylist(held, schema=schema))
                held.clear()
        if held:
            out.write_batch(pa.RecordBatch.from_pylist(held, schema=schema))


def write_sqlite(df: DataFrame, path: str, table: str, if_exists: str = "fail") -> None:
    """Rows are streamed through the driver into one local file."""
    import sqlite3

    names = ", ".join(f'"{c}"' for c in df.columns)
    with sqlite3.connect(path) as c:
        there = c.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()[0]
        if there and if_exists == "fail":
            raise ValueError(f"{table} is there already")
        if there and if_exists == "replace":
            c.execute(f'DROP TABLE "{table}"')
        if not there or if_exists == "replace":
            c.execute(f'CREATE TABLE "{table}" ({names})')
        c.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))
