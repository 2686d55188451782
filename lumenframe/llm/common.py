"""What the operators of this subpackage share: the folder all executors see, tables that cut lineage, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass works on: bounds a worker's memory to some 30 times this.
CHUNK = 1 << 20
#: Rows that one key of keyed() may have.
COPIES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one that is then set - on one machine only, as other
    machines don't see it."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lumenframe/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as a table to the shared folder and read again: later stages don't depend on executors that made it."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by cut(); nothing may read it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it is read from fewer files than there are cores; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < len(df.inputFiles()) < cores else df


def whole_text(df: DataFrame, column: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def most_rows(df: DataFrame, key: str) -> int:
    """Rows of the key that has most."""
    return df.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def keyed(docs: DataFrame) -> DataFrame:
    """(_d, _c, text): one row per input row, with a key that is unique even where doc_id is null or repeated.

    _d is doc_id, a null one last (the largest long); _c numbers the rows of one _d, by text. Whether any _d repeats is
    looked up first over the ids alone; only then are texts ranked.
    """
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("_d"), whole_text(docs).alias("text"))
    if (most := most_rows(base, "_d")) > COPIES:
        raise ValueError(f"{most} rows of one doc_id, or without one")
    if most < 2:
        return base.select("_d", F.lit(0).alias("_c"), "text")
    from pyspark.sql import Window

    order = Window.partitionBy("_d").orderBy(F.xxhash64("text"))
    return base.withColumn("_c", (F.row_number().over(order) - 1).cast("int")).select("_d", "_c", "text")


def real_id(column: str = "_d") -> F.Column:
    """doc_id again: the key that stands for null is null."""
    return F.when(F.col(column) != 2**63 - 1, F.col(column))


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", "))])


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes of their texts one after another, offsets of each text in them)."""
    array = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_az(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def schema_of(df: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in added.items())])


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15
#: One random number a byte value.
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the rolling hash's base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(n + 1, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of hashed bytes times powers: C[j] - C[i], times the inverse's i-th power, is the hash of data[i:j]."""
    n = len(data)
    up, _ = powers(n)
    out = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_HASH[data] * up[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix) - 1)
    return (prefix[end] - prefix[start]) * down[start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of texts in a row, and where each text's words begin (one more at the end).

    Words are runs of bytes other than blank and 09-0D. Two words have the same 64-bit hash with odds of 2^-64.
    """
    low = lower_az(data)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = (low != 32) & ((low < 9) | (low > 13))
    begins = np.empty(len(data) + 1, dtype=bool)
    begins[0] = inside[0]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a text's first byte begins a word though the last text ended in one
    begins[1:] = inside[1:] & (~inside[:-1] | edge[1:])
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    starts = np.flatnonzero(begins)
    hashed = mix(span_hash(prefix_hash(low), starts, ends) ^ (ends - starts).astype(np.uint64))
    return hashed, np.searchsorted(starts, offsets)


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    n = np.concatenate(counts) if counts else np.empty(0, np.int64)
    if not len(k):
        return k, n
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n[order], first)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each is there. Sorting alone is faster than np.unique with counts."""
    k = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.diff(np.append(first, len(k)))


_KEPT: dict = {"owner": None, "tables": {}}


def remembered(owner: str, key=None, make=None):
    """What a worker remembers from task to task, of one operator at a time: what another one left is dropped first."""
    if _KEPT["owner"] != owner:
        _KEPT["owner"], _KEPT["tables"] = owner, {}
    if make is None:
        return None
    if key not in _KEPT["tables"]:
        _KEPT["tables"][key] = make()
    return _KEPT["tables"][key]
