"""A training corpus from documents: toxic documents go, then exact copies, near copies and repeated passages; what is left is
packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, in the columns of documents; the last one
returns a row per packed piece. A document whose text consists of repeated passages alone stays, with an empty text.

Defined results, of all stages: a null text is not toxic and counts as empty (of several, one stays, in the dedup stages the one of
smallest doc_id); a null doc_id sorts last; of equal rows one stays; documents of one doc_id and different texts are documents of
their own; very long texts are worked on whole; of ties (the same text or group) the smallest doc_id stays; an empty table, or one
without labelled documents, runs through; further columns of documents, whatever their names, stay with their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import exact_dedup, minhash, packing, suffix_dedup, toxicity
from lumenframe.llm.common import cut, spread
from lumenframe.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, doesn't find toxic. Null and empty texts stay; without
    toxic labels all do; rows are judged one by one, so copies and repeated rows go or stay together."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart), the document of smallest id; null and empty texts are equal; of equal rows one stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of smallest id. Texts without words belong to no group; rows of one doc_id are
    one document here, and stay or go together."""
    return minhash.dedup(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that stand earlier too; n_chars, if there, is counted anew. A null text stays
    null; no row goes; rows of one doc_id are texts of their own."""
    left = suffix_dedup.strip(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, each with its place in a sequence of at most 2048 tokens; a null or empty text is its end
    token."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("repeated passages", strip_repeats), ("packing", pack)]

#: Toxicity, near copies, repeated passages and packing are not for SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
