"""CSV with types inferred from text, and JSON in records or columns form.

Files are read by Spark's readers, so paths may be in any store. Types are inferred in one aggregate over all rows, not from a
sample, unless the caller gives them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts taken as null.
NULLS = ("", "NA", "N/A", "na", "n/a", "NaN", "nan", "null", "NULL", "Null", "None", "none", "-")
_INT, _FLOAT, _BOOL = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^(true|false|True|False|TRUE|FALSE)$"


def _typed(c: Column, kind: str) -> Column:
    return c if kind == "string" else F.lower(c).try_cast(kind) if kind == "boolean" else c.try_cast(kind)


def infer(df: DataFrame, sample: int | None = None) -> dict[str, str]:
    """The narrowest of bigint, double, boolean and string that all values of each string column have (of `sample` rows, if
    given; later values of another type are null then)."""
    df = df.limit(sample) if sample else df
    aggs = [F.count_if(F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").rlike(p)).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k, p in (("bigint", _INT), ("double", _FLOAT), ("boolean", _BOOL))]
    aggs += [F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs).first()
    return {c: next((k for k in ("bigint", "double", "boolean") if one[f"{i}_n"] and not one[f"{i}_{k}"]), "string") for i, c in enumerate(df.columns)}


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", quote: str = '"', header: bool = True, null_values: Sequence[str] = (), names: Sequence[str] | None = None, types: dict[str, str] | None = None,
    comment: str | None = None, trim: bool = False, skip_rows: int = 0, max_rows: int | None = None, multi_line: bool = True, infer_sample_size: int | None = None,
) -> DataFrame:
    """Quoted fields may hold the separator, doubled quotes and line ends. For large files without line ends in fields, multi_line
    is to be off: files are split among tasks then, else each is one task.
    Without a header columns are column_0, column_1, ... Types come from all rows, or from infer_sample_size of them.

    skip_rows drops physical lines first, which needs their order: it is for files that one task can read.
    """
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": multi_line, "header": header and not skip_rows, "inferSchema": False, "nullValue": "\0", "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim}
    if comment:
        options["comment"] = comment
    if skip_rows:
        lines = spark.read.text(path).rdd.zipWithIndex().filter(lambda x: x[1] >= skip_rows).map(lambda x: x[0][0])
        raw = spark.read.options(**options | {"header": header, "multiLine": False}).csv(lines)
    else:
        raw = spark.read.options(**options).csv(path)
    if not header:
        raw = raw.toDF(*[f"column_{i}" for i in range(len(raw.columns))])
    if names:
        raw = raw.toDF(*names)
    elif trim:
        raw = raw.toDF(*[c.strip() for c in raw.columns])
    if max_rows is not None:
        raw = raw.limit(max_rows)
    nulls = [*NULLS, *null_values]
    text = raw.select(*[F.when(~F.col(f"`{c}`").isin(nulls), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    kinds = (infer(text, infer_sample_size) if set(types or {}) < set(text.columns) else {}) | (types or {})
    return text.select(*[_typed(F.col(f"`{c}`"), kinds[c]).alias(c) for c in text.columns])


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, null: str = "", quote: str = "necessary", mode: str = "errorifexists") -> None:
    """quote: necessary, always or never."""
    options = {"sep": sep, "header": header, "nullValue": null, "emptyValue": '""', "escape": '"', "quoteAll": quote == "always"}
    if quote == "never":
        options["quote"] = "\0"
    df.write.mode(mode).options(**options).csv(path)


def read_json(spark: SparkSession, path: str, orient: str = "records", schema: T.StructType | str | None = None) -> DataFrame:
    """records: an array of objects (or an object a line); columns: one object of equally long arrays."""
    reader = spark.read.option("multiLine", True)
    raw = (reader.schema(schema) if schema else reader).json(path)
    if orient == "records":
        return raw
    zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in raw.columns])
    return raw.select(F.inline(zipped)).toDF(*raw.columns)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An object a line, nulls written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def to_json_document(df: DataFrame, orient: str = "records", most: int = 1_000_000) -> DataFrame:
    """One row: the whole table as a JSON document, of at most `most` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    if orient == "records":
        return df.agg(F.to_json(F.collect_list(F.struct("*")), {"ignoreNullFields": "false"}).alias("document"))
    rows = df.agg(F.collect_list(F.struct("*")).alias("rows"))
    columns = F.struct(*[F.col("rows").getField(c).alias(c) for c in df.columns])
    return rows.select(F.to_json(columns, {"ignoreNullFields": "false"}).alias("document"))
