"""Exact deduplication against a persistent digest index; DataFrame operations only.

The index is a table of one row per distinct text, bucketed and sorted by digest. Rows come in batches, those of smaller doc_id
first: a call deals its rows into `batches` ranges of doc_id. Each is reduced to its own distinct digests, anti-joined to the
index by sort-merge on the digest - the index is read by its buckets, without a shuffle - and what is new is appended. So the
later batches of a call, and all of a later call with the same index, meet digests that are stored. An index that doesn't exist
yet is made empty first, its buckets by the number of rows.

Only digests are shuffled; a digest that a third of all rows share is first reduced by (digest, salt), the salt coming
from doc_id, and rows meet their group's result on that pair, so no task holds more than its salt's share of a group.

Defined results: a null text counts as empty; a null doc_id sorts last, and keep_id is null only where all ids of a group
are; of repeated rows (same doc_id, same text) one is kept; a very long text is one digest like any other; an empty table gives
an empty result; further columns don't matter, whatever their names. Rows whose text an earlier call brought to the index are not
kept, and keep_id is the row that brought it. group_size counts the rows of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, table_path, whole_text

#: Rows of one group are dealt over so many salts.
SALTS = 64
#: Buckets of an index: one for so many rows, within bounds.
ROWS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 24, 8192
LAST = 2**63 - 1


def normalised(text: F.Column) -> F.Column:
    """Each run of white space as one space. Single spaces are left alone, as most runs are one: that halves the work."""
    return F.regexp_replace(text, r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def digest(docs: DataFrame) -> F.Column:
    return F.sha2(normalised(whole_text(docs)).cast("binary"), 256)


def _id(docs: DataFrame) -> F.Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))


class DigestIndex:
    """A table (digest, keep_id, batch), bucketed and sorted by digest, kept in the shared folder.

    One with a name is found again by later calls; without, it is made anew, and drop() removes it.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if self.exists():
            self.buckets = int(spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Num Buckets'").first()["data_type"])

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def create(self, rows: int) -> None:
        """An empty index for so many rows, if there is none."""
        if not self.exists():
            self.buckets = self.buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, rows // ROWS_A_BUCKET))
            columns = "digest STRING, keep_id BIGINT, batch STRING"
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{table_path(self.spark, self.name)}'")

    def append(self, partial: DataFrame, batch: str) -> None:
        """Adds what is new of (digest, keep), several rows a digest, under the name of a batch."""
        own = partial.repartition(self.buckets, "digest").groupBy("digest").agg(F.min("keep").alias("keep_id"))
        fresh = own.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        fresh.sortWithinPartitions("digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _indexed(rows: DataFrame, index: DigestIndex, batches: int) -> tuple[DataFrame, str]:
    """Brings rows (_id, digest, salt) to the index in ranges of _id; (digest, salt, keep, n) of all rows, and the batch's name."""
    batch = uuid.uuid4().hex
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_id", [k / batches for k in range(1, batches)] or [0.5], 1000).alias("at")).first()
    index.create(sums["n"])
    edges = sorted(set(sums["at"] or [])) if batches > 1 else []
    part = sum((F.when(F.col("_id") > e, 1).otherwise(0) for e in edges), F.lit(0))
    partial = cut(rows.withColumn("part", part).groupBy("digest", "salt", "part").agg(F.min("_id").alias("keep"), F.count(F.lit(1)).alias("n")), "partial")
    for k in range(len(edges) + 1):
        index.append(partial.filter(F.col("part") == k), batch)
    return partial, batch


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))


def annotate(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    index = index or DigestIndex(docs.sparkSession)
    rows = cut(_salted(docs.select(_id(docs).alias("_id"), digest(docs).alias("digest"))), "digests")
    partial, batch = _indexed(rows, index, batches)
    sizes = partial.groupBy("digest").agg(F.sum("n").alias("group_size"))
    pairs = partial.select("digest", "salt").distinct().join(sizes, "digest")
    found = pairs.join(index.rows().hint("merge"), "digest").withColumn("new", F.col("batch") == batch)
    copies = Window.partitionBy("digest", "salt", "_id").orderBy("_id")
    joined = rows.join(found, ["digest", "salt"]).withColumn("_n", F.row_number().over(copies))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return joined.select(
        real("_id").alias("doc_id"), real("keep_id").alias("keep_id"), F.col("group_size"),
        (F.col("new") & (F.col("_id") == F.col("keep_id")) & (F.col("_n") == 1)).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Rows are dealt by (digest, doc_id), so that a large group of copies is spread out; of repeated rows one stays.
    """
    index = index or DigestIndex(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes with the operator's own
    plain = docs.toDF(*names)
    named = plain.select("*", plain[names[docs.columns.index("doc_id")]].alias("doc_id"), plain[names[docs.columns.index("text")]].alias("text"))
    wide = named.select(*names, _id(named).alias("__id"), digest(named).alias("__digest"))
    _, batch = _indexed(cut(_salted(wide.select(F.col("__id").alias("_id"), F.col("__digest").alias("digest"))), "digests"), index, batches)
    stay = index.rows().filter(F.col("batch") == batch).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__id"))
    copies = Window.partitionBy("__id", "__digest").orderBy("__id")
    kept = wide.join(stay, ["__id", "__digest"], "left_semi").withColumn("__n", F.row_number().over(copies)).filter("__n = 1")
    return kept.select(*names).toDF(*docs.columns)
