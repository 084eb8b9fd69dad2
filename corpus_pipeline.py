"""Corpus pipeline: ``documents`` to shards for training.

``STAGES`` are (name, function) in order.  A function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet under
``spark.checkpoint.dir`` and read again as the next one's ``docs``.  The first
four return the columns of documents; the last adds ``shard`` and ``slot``.

1. language ID: documents that are rejected go
2. SimHash near-dedup: one document of each group stays
3. benchmark decontamination: documents that leak an item go
4. mixing: all documents, stored in the order of the mix
5. sharding: near equal bytes, shards are runs of that order

Fingerprints, compression and edit distances are not SQL, so ORACLE_SQL is
None; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valora.llm import decontaminate, language_id, mixing, sharding, simhash
from valora.session import stage
from valora.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.in_shards(docs)


STAGES = [("language_id", language), ("simhash_dedup", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixed), ("sharding", sharded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
