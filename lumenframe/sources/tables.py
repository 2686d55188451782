"""Session factory and the loader of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lumenframe", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes; on a cluster the submitter's own settings win.

    Only settings that decide results (time zone) or plans (adaptive execution) are fixed; sizes such as the number of
    shuffle partitions are left to the submitter.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Tables of long texts, whose rows are worth dealing anew.
LONG_ROWS = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it is read from fewer files than there are cores; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be in any store that Spark reads."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LONG_ROWS else df
