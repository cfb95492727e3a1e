"""A corpus pipeline of five stages: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; `run` writes each stage's result as Parquet to
the shared folder and reads it again as the next one's docs. All stages but the last return the columns of documents.

Defined results, for all stages: an empty table gives an empty table; null ids, sources and other columns are values like
any other, and stay; very long texts are read whole; columns besides those of documents are carried along whatever their
names. Nulls, ties and repeated rows are told at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emulsia.llm import common, decontaminate, mixing, packing, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; a null or empty text has too few words and goes; equal rows share a fate."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more on five-word shingles) stays: that with the least id.

    Of a group's texts under its least id that with the least digest stays, and of repeated rows one; rows without an id
    stay unless their group has a row with one. All texts without words are alike.
    """
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; a null text has none and stays; equal rows share a fate."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, with the words that it takes.

    A null source is a source; a text without words is taken no times; repeated rows are documents of their own.
    """
    return mixing.mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard (0 to 7) and their slot in it; equal texts share a shard, repeated rows get slots of their own."""
    return packing.shard_rows(docs, shards=8)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", sharding),
]

#: The mix and the shards follow hashes that SQL doesn't have; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
