"""Parquet and ORC sinks, Avro containers, workbooks, npy and npz files, DuckDB tables, and paths in object stores.

Parquet and ORC are Spark's own. Avro containers and workbooks are read and written in plain Python, as data sources: a file is a
partition, its blocks are streamed; each task writes a file of its own. Paths go through pyarrow's file systems.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Codecs by format.
PARQUET_CODECS = ("none", "snappy", "gzip", "zstd", "lz4")
ORC_CODECS = ("none", "zlib", "snappy", "zstd", "lz4")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, batch_size: int | None = None) -> DataFrame:
    """batch_size: rows of a columnar batch, for the session."""
    if batch_size:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", batch_size)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_parquet_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """A Parquet file held in memory (so of a size that the driver holds)."""
    import pyarrow.parquet as pq

    return spark.createDataFrame(pq.read_table(io.BytesIO(data)))


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    if compression not in PARQUET_CODECS:
        raise ValueError(f"compression is to be one of {PARQUET_CODECS}")
    df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path)


def read_orc(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.orc(path)
    return df.select(*columns) if columns else df


def write_orc(df: DataFrame, path: str, compression: str = "zlib", stripe_size: int | None = None, mode: str = "errorifexists") -> None:
    """stripe_size in bytes."""
    if compression not in ORC_CODECS:
        raise ValueError(f"compression is to be one of {ORC_CODECS}")
    writer = df.write.mode(mode).option("compression", compression)
    (writer.option("orc.stripe.size", stripe_size) if stripe_size else writer).orc(path)


# Avro

#: What an Avro container begins with, and types without parts by their name.
MAGIC = b"Obj\x01"
PRIMITIVES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.NullType()}
LOGICAL = {"date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType()}


def parse_schema(text: str | dict) -> T.StructType:
    """The Spark schema of an Avro record schema."""
    kind = _spark_type(json.loads(text) if isinstance(text, str) else text, {})[0]
    if not isinstance(kind, T.StructType):
        raise ValueError("an Avro container holds records")
    return kind


def _spark_type(schema, named: dict) -> tuple[T.DataType, bool]:
    """The type, and whether it takes null."""
    if isinstance(schema, list):
        others = [s for s in schema if s != "null"]
        if len(others) != 1:
            raise ValueError(f"a union of {len(others)} types has no column type")
        return _spark_type(others[0], named)[0], "null" in schema
    if isinstance(schema, str):
        return (PRIMITIVES[schema], schema == "null") if schema in PRIMITIVES else (named[schema], False)
    kind = schema["type"]
    if schema.get("logicalType") in LOGICAL:
        return LOGICAL[schema["logicalType"]], False
    if kind == "record":
        fields = []
        for f in schema["fields"]:
            t, null = _spark_type(f["type"], named)
            fields.append(T.StructField(f["name"], t, null))
        named[schema["name"]] = T.StructType(fields)
        return named[schema["name"]], False
    if kind == "array":
        t, null = _spark_type(schema["items"], named)
        return T.ArrayType(t, null), False
    if kind == "map":
        t, null = _spark_type(schema["values"], named)
        return T.MapType(T.StringType(), t, null), False
    if kind in ("enum", "fixed"):
        named[schema["name"]] = T.StringType() if kind == "enum" else T.BinaryType()
        return named[schema["name"]], False
    return _spark_type(kind, named)


def avro_schema(schema: T.StructType, name: str = "row") -> dict:
    """An Avro record schema of a Spark schema; every field may be null."""
    plain = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "binary": "bytes", "string": "string"}

    def of(t: T.DataType, path: str):
        if isinstance(t, T.StructType):
            return {"type": "record", "name": path, "fields": [{"name": f.name, "type": ["null", of(f.dataType, f"{path}_{f.name}")]} for f in t.fields]}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": ["null", of(t.elementType, path + "_e")]}
        if isinstance(t, T.MapType):
            return {"type": "map", "values": ["null", of(t.valueType, path + "_v")]}
        if isinstance(t, T.DateType):
            return {"type": "int", "logicalType": "date"}
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return {"type": "long", "logicalType": "timestamp-micros"}
        return plain[t.simpleString()] if t.simpleString() in plain else "string"

    return of(schema, name)


class _Decoder:
    """Values of one block of bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def long(self) -> int:
        shift = n = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n |= (b & 127) << shift
            if b < 128:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, schema, named: dict):
        import datetime

        if isinstance(schema, list):
            return self.value(schema[self.long()], named)
        if isinstance(schema, dict):
            logical, kind = schema.get("logicalType"), schema["type"]
            if logical == "date":
                return datetime.date(1970, 1, 1) + datetime.timedelta(days=self.long())
            if logical in ("timestamp-millis", "timestamp-micros"):
                return datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=self.long() * (1000 if logical.endswith("millis") else 1))
            if kind == "record":
                named[schema["name"]] = schema
                return tuple(self.value(f["type"], named) for f in schema["fields"])
            if kind in ("array", "map"):
                out = []
                while n := self.long():
                    if n < 0:
                        n = -n
                        self.long()  # the block's bytes
                    for _ in range(n):
                        key = self.take(self.long()).decode() if kind == "map" else None
                        item = self.value(schema["items" if kind == "array" else "values"], named)
                        out.append(item if kind == "array" else (key, item))
                return out if kind == "array" else dict(out)
            if kind in ("enum", "fixed"):
                named[schema["name"]] = schema
                return schema["symbols"][self.long()] if kind == "enum" else self.take(schema["size"])
            return self.value(kind, named)
        if schema in ("int", "long"):
            return self.long()
        if schema == "string":
            return self.take(self.long()).decode()
        if schema == "bytes":
            return self.take(self.long())
        if schema == "double":
            return struct.unpack("<d", self.take(8))[0]
        if schema == "float":
            return struct.unpack("<f", self.take(4))[0]
        if schema == "boolean":
            return self.take(1) == b"\x01"
        return None if schema == "null" else self.value(named[schema], named)


def _long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _encoded(value, schema) -> bytes:
    import datetime

    if isinstance(schema, list):
        return _long(0) if value is None else _long(1) + _encoded(value, schema[1])
    if isinstance(schema, dict):
        if schema.get("logicalType") == "date":
            return _long((value - datetime.date(1970, 1, 1)).days)
        if schema.get("logicalType"):
            zone = value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
            return _long((zone - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1))
        if schema["type"] == "record":
            return b"".join(_encoded(v, f["type"]) for v, f in zip(value, schema["fields"], strict=True))
        if schema["type"] == "array":
            return (_long(len(value)) + b"".join(_encoded(v, schema["items"]) for v in value) if len(value) else b"") + _long(0)
        return (_long(len(value)) + b"".join(_encoded(k, "string") + _encoded(v, schema["values"]) for k, v in value.items()) if value else b"") + _long(0)
    if schema in ("int", "long"):
        return _long(int(value))
    if schema in ("string", "bytes"):
        data = str(value).encode() if schema == "string" else bytes(value)
        return _long(len(data)) + data
    if schema == "boolean":
        return b"\x01" if value else b"\x00"
    return struct.pack("<d" if schema == "double" else "<f", value)


def _open_file(path: str, how: str = "r"):
    """A file of any store that pyarrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if how == "list":
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            found = sorted(x.path for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and not os.path.basename(x.path).startswith(("_", ".")))
        else:
            found = [inner]
        head = path[: path.index("://") + 3] if "://" in path else "file:" if path.startswith("file:") else ""
        return [head + x if head else x for x in found]
    if how == "w":
        system.create_dir(os.path.dirname(inner), recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_file(inner)


def _header(f) -> tuple[dict, bytes, bytes, int]:
    """The schema, the codec, the sync marker and where blocks begin."""
    data = f.read(1 << 16)
    while True:
        try:
            if data[:4] != MAGIC:
                raise ValueError("not an Avro container")
            d = _Decoder(data, 4)
            meta = d.value({"type": "map", "values": "bytes"}, {})
            sync = d.take(16)
            if len(sync) < 16:
                raise IndexError
            return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null"), sync, d.at
        except IndexError:
            more = f.read(1 << 16)
            if not more:
                raise ValueError("a cut Avro header") from None
            data += more


def avro_rows(path: str) -> Iterator[tuple]:
    """Rows of a container, block by block."""
    with _open_file(path) as f:
        schema, codec, sync, at = _header(f)
        f.seek(at)
        while head := f.read(20):
            d = _Decoder(head)
            n, size = d.long(), d.long()
            f.seek(at + d.at)
            data = f.read(size)
            if f.read(16) != sync:
                raise ValueError("a block without its sync marker")
            at += d.at + size + 16
            if codec == b"deflate":
                data = zlib.decompress(data, -15)
            elif codec != b"null":
                raise ValueError(f"codec {codec.decode()} is not known")
            block = _Decoder(data)
            for _ in range(n):
                yield block.value(schema, {})


def write_avro_file(rows: Iterator, schema: T.StructType, path: str, codec: str = "deflate", block_rows: int = 4096) -> int:
    own, sync, written = avro_schema(schema), uuid.uuid4().bytes, 0
    with _open_file(path, "w") as f:
        meta = {"avro.schema": json.dumps(own).encode(), "avro.codec": codec.encode()}
        f.write(MAGIC + _long(len(meta)) + b"".join(_encoded(k, "string") + _encoded(v, "bytes") for k, v in meta.items()) + _long(0) + sync)
        block: list[bytes] = []

        def flush() -> None:
            data = b"".join(block)
            if codec == "deflate":
                c = zlib.compressobj(6, zlib.DEFLATED, -15)
                data = c.compress(data) + c.flush()
            f.write(_long(len(block)) + _long(len(data)) + data + sync)
            block.clear()

        for row in rows:
            block.append(_encoded(row, own))
            written += 1
            if len(block) == block_rows:
                flush()
        if block:
            flush()
    return written


class _Path(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _AvroReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Path(p) for p in _open_file(self.path, "list")]

    def read(self, partition):
        yield from avro_rows(partition.path)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _AvroWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema

    def write(self, iterator):
        path = f"{self.options['path'].rstrip('/')}/part-{uuid.uuid4().hex}.avro"
        return _Written(path, write_avro_file(iterator, self.schema, path, self.options.get("codec", "deflate")))

    def abort(self, messages) -> None:
        from pyarrow import fs

        for m in messages:
            if m:
                system, inner = fs.FileSystem.from_uri(m.path) if "://" in m.path or m.path.startswith("file:") else (fs.LocalFileSystem(), m.path)
                system.delete_file(inner)


class AvroSource(DataSource):
    """Options path, codec (null or deflate)."""

    @classmethod
    def name(cls) -> str:
        return "avro_container"

    def schema(self) -> T.StructType:
        with _open_file(_open_file(self.options["path"], "list")[0]) as f:
            return parse_schema(_header(f)[0])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _AvroReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _AvroWriter(dict(self.options), schema)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(AvroSource)
    return spark.read.format("avro_container").load(path)


def write_avro(df: DataFrame, path: str, codec: str = "deflate") -> None:
    """A folder of containers, one a task; a task that fails leaves none behind."""
    df.sparkSession.dataSource.register(AvroSource)
    df.write.format("avro_container").mode("append").option("codec", codec).save(path)


# workbooks: XML parts in a zip archive

#: Name spaces of a workbook's parts, and the most rows of a sheet.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
SHEET_ROWS = 1_048_576


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _column_name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list]:
    """Cell values of a sheet (the first, without a name), row by row: numbers, texts, booleans and None."""
    with _open_file(path) as f, zipfile.ZipFile(f) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{{{MAIN}}}t")) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        names = {s.get("name"): s.get(f"{{{RELATIONS}}}id") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if sheet is not None and sheet not in names:
            raise ValueError(f"no sheet {sheet}")
        target = targets[names[sheet] if sheet is not None else next(iter(names.values()))].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                cells: dict[int, object] = {}
                for k, c in enumerate(row.iter(f"{{{MAIN}}}c")):
                    kind, v = c.get("t", "n"), c.find(f"{{{MAIN}}}v")
                    text = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t")) if kind == "inlineStr" else v.text if v is not None else None
                    if text is not None:
                        cells[_column_number(c.get("r")) if c.get("r") else k] = shared[int(text)] if kind == "s" else text == "1" if kind == "b" else float(text) if kind == "n" else text
                yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]
                row.clear()


class _SheetReader(DataSourceReader):
    def __init__(self, options: dict, width: int, kinds: list[str]):
        self.options, self.width, self.kinds = options, width, kinds

    def partitions(self):
        return [_Path(p) for p in _open_file(self.options["path"], "list")]

    def read(self, partition):
        rows = sheet_rows(partition.path, self.options.get("sheet"))
        next(rows, None)
        for row in rows:
            row = [*row, *[None] * (self.width - len(row))][: self.width]
            yield tuple(v if v is None or k == "double" and isinstance(v, float) or k == "boolean" and isinstance(v, bool) else (v if k == "string" and isinstance(v, str) else str(v)) if k == "string" else None for v, k in zip(row, self.kinds, strict=True))


class SheetSource(DataSource):
    """Options path, sheet. The first row holds names; a column is double or boolean if all values of the first file are."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        rows = sheet_rows(_open_file(self.options["path"], "list")[0], self.options.get("sheet"))
        names = [str(x) if x is not None else f"column_{k}" for k, x in enumerate(next(rows, []))]
        seen: list[set] = [set() for _ in names]
        for row in rows:
            for kinds, v in zip(seen, row, strict=False):
                kinds.add(type(v))
        kind = lambda s: T.DoubleType() if s - {type(None)} == {float} else T.BooleanType() if s - {type(None)} == {bool} else T.StringType()
        return T.StructType([T.StructField(n, kind(s)) for n, s in zip(names, seen, strict=True)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SheetReader(dict(self.options), len(schema.fields), [f.dataType.simpleString() for f in schema.fields])


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(SheetSource)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet is not None else reader).load(path)


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """One workbook, streamed through the driver; a sheet holds 1,048,576 rows at most, more is an error."""
    from xml.sax.saxutils import escape, quoteattr

    def cell(v, ref: str) -> str:
        if v is None or isinstance(v, float) and v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    with _open_file(path, "w") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = {"xl/workbook.xml": "sheet.main", "xl/worksheets/sheet1.xml": "worksheet"}
        parts = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in kinds.items())
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<?xml version="1.0"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
            letters = [_column_name(k) for k in range(len(df.columns))]
            for n, row in enumerate((r for rows in ([df.columns], df.toLocalIterator()) for r in rows), 1):
                if n > SHEET_ROWS:
                    raise ValueError(f"more than {SHEET_ROWS} rows")
                out.write(f'<row r="{n}">{"".join(cell(v, f"{a}{n}") for a, v in zip(letters, row, strict=True))}</row>'.encode())
            out.write(b"</sheetData></worksheet>")


# arrays


def write_npy(df: DataFrame, path: str, columns: Sequence[str] | None = None, most: int = 50_000_000) -> None:
    """Numeric columns as a matrix; of at most `most` numbers, as one file comes from the driver. Order is that of df."""
    np.save(path, _matrix(df, columns, most))


def write_npz(arrays: dict[str, DataFrame], path: str, most: int = 50_000_000) -> None:
    np.savez(path, **{name: _matrix(df, None, most) for name, df in arrays.items()})


def _matrix(df: DataFrame, columns: Sequence[str] | None, most: int) -> np.ndarray:
    chosen = df.select(*(columns or df.columns))
    if chosen.count() * len(chosen.columns) > most:
        raise ValueError(f"more than {most} numbers")
    return chosen.toPandas().to_numpy(dtype=float)


def tensor_to_record_batch(array: np.ndarray, names: Sequence[str] | None = None):
    """A matrix as an Arrow batch, a column each."""
    import pyarrow as pa

    array = np.atleast_2d(np.asarray(array, dtype=float))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in array.T], names=list(names or [f"column_{k}" for k in range(array.shape[1])]))


def record_batch_to_tensor(batch) -> np.ndarray:
    """Numeric columns of an Arrow batch as a matrix; nulls are NaN."""
    return np.column_stack([c.to_pandas().to_numpy(dtype=float) for c in batch.columns]) if batch.num_columns else np.empty((batch.num_rows, 0))


# DuckDB


def write_duckdb(df: DataFrame, path: str, table: str, if_exists: str = "fail") -> None:
    """Rows go to a local database file by Arrow batches, one partition after another."""
    import duckdb
    import pyarrow as pa

    with duckdb.connect(path) as c:
        there = c.execute("SELECT count(*) FROM duckdb_tables() WHERE table_name = ?", [table]).fetchone()[0]
        if there and if_exists == "fail":
            raise ValueError(f"{table} is there already")
        if there and if_exists == "replace":
            c.execute(f'DROP TABLE "{table}"')
            there = 0
        from pyspark.sql.pandas.types import to_arrow_schema

        empty = to_arrow_schema(df.schema).empty_table()
        if not there:
            c.execute(f'CREATE TABLE "{table}" AS SELECT * FROM empty')
        names, held = df.columns, []

        def put() -> None:
            part = pa.Table.from_pylist(held, schema=empty.schema)  # noqa: F841 - DuckDB finds it by its name
            c.execute(f'INSERT INTO "{table}" SELECT * FROM part')
            held.clear()

        for row in df.toLocalIterator():
            held.append(dict(zip(names, row, strict=True)))
            if len(held) == 50_000:
                put()
        if held:
            put()


def read_duckdb_file(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A Parquet or CSV file through DuckDB's reader."""
    from lumenframe.sources.connectors import register

    register(spark)
    quoted = path.replace("'", "''")
    return spark.read.format("duckdb_query").option("path", ":memory:").option("query", f"SELECT * FROM read_{kind}{'_auto' if kind == 'csv' else ''}('{quoted}')").load()


# object stores

#: Providers by the scheme of a path, and the scheme that Spark reads them by.
PROVIDERS = {"s3": ("s3", "s3a"), "s3a": ("s3", "s3a"), "gs": ("gcs", "gs"), "az": ("azure", "abfss"), "abfss": ("azure", "abfss"), "file": ("local", "file"), "hdfs": ("hdfs", "hdfs")}


@dataclass(frozen=True)
class CloudPath:
    provider: str
    bucket: str
    key: str

    @classmethod
    def parse(cls, url: str) -> CloudPath:
        scheme, mark, rest = url.partition("://")
        if not mark:
            return cls("local", "", url)
        if scheme.lower() not in PROVIDERS:
            raise ValueError(f"scheme {scheme} is not known")
        provider = PROVIDERS[scheme.lower()][0]
        if provider == "local":
            return cls(provider, "", rest)
        bucket, _, key = rest.partition("/")
        if not bucket:
            raise ValueError(f"{url} names no bucket")
        return cls(provider, bucket, key)

    def spark(self) -> str:
        """The path as Spark's readers take it."""
        if self.provider == "local":
            return self.key
        return f"{next(s for p, s in PROVIDERS.values() if p == self.provider)}://{self.bucket}/{self.key}"


def cloud_read_bytes(url: str, most: int = 1 << 30) -> bytes:
    """A whole object, of at most `most` bytes; tables are read by Spark's readers instead."""
    with _open_file(url) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"more than {most} bytes")
    return data
