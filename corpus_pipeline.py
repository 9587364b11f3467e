"""A training corpus in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trustframe.llm.decontaminate import without_leaks
from trustframe.llm.jaccard import one_of_each
from trustframe.llm.mixing import mixed_documents
from trustframe.llm.sharding import shuffle_into_shards
from trustframe.llm.toxicity import without_toxic
from trustframe.session import checkpoint_root, load_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; it learns from ``labels`` and the documents at hand."""
    return without_toxic(docs, load_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts (five words, similarity 0.8)."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_leaks(docs, load_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot in a uniform shuffle."""
    return shuffle_into_shards(docs)


STAGES = [
    ("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixing", mixing), ("sharding", sharding),
]

#: SQL can express neither learned models nor seeded draws; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = load_table(spark, sf_dir, "documents"), checkpoint_root(spark)
    for _, stage in STAGES:
        path = f"{root}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
