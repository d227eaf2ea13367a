"""The corpus pipeline: quality, toxicity, repeated lines, near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written and read again before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import lines, packing, quality, simhash, toxicity
from concordat.operators.graph import set_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier place has."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints over five words linked by the trie join, confirmed at similarity 0.8; an exact join adds the pairs that fingerprints tell apart."""
    return simhash.first_of_each(docs, width=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("toxicity", civil), ("line dedup", new_lines), ("near dedup", distinct), ("packing", packed)]
#: The trained classifiers cannot be written in SQL; line dedup and near copies are tested against brute force, the classifiers on held-out labels, packing by its invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the others keep is written to the shared checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        set_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
