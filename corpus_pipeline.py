"""The corpus pipeline: five operators of ``prospect.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last keep
the columns of ``documents``; the last adds ``shard``.

* ``quality``: rows that the classifier rejects go.
* ``near_duplicates``: one row of each SimHash group stays.
* ``decontaminate``: rows holding a benchmark item go.
* ``mix``: rows are repeated or left out by the fitted rates.
* ``shard``: every row gets its shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prospect.llm import decontaminate, mixing, quality, sharding, simhash
from prospect.llm.common import table
from prospect.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.source_domains(docs, table(spark, sf_dir, "labels")))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: The classifier and the fitted rates have no SQL form; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
