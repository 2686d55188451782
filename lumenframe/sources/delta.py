"""Snapshots of log-structured tables: the JSON log is replayed, then the active parquet files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def active_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(path): files that the last action up to a version has added."""
    log = spark.read.schema("add struct<path:string>, remove struct<path:string>").json(f"{path}/_delta_log/*.json").withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("long"))
    if version is not None:
        log = log.filter(F.col("version") <= version)
    acts = log.select("version", F.coalesce("add.path", "remove.path").alias("path"), F.col("add").isNotNull().alias("added")).filter("path IS NOT NULL")
    last = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("added"))
    return acts.withColumn("n", F.row_number().over(last)).filter("n = 1 AND added").select("path")


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest snapshot, or that of a version. The list of files is brought to the driver, as any reader's is."""
    files = [f"{path}/{r.path}" for r in active_files(spark, path, version).orderBy("path").toLocalIterator()]
    if not files:
        raise FileNotFoundError(f"no active files in {path}")
    return spark.read.parquet(*files)
