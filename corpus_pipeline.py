"""Cleaning and packing of ``documents``: five stages, each a table on disk for the next.

A stage takes (spark, docs, sf_dir) and returns the documents that go on, with
the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import jaccard, mixing, packing, substrings, toxicity
from tallyforge.llm.common import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates stays."""
    return jaccard.first_of_groups(docs)


def repeated_passage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the texts; other texts stay as they are."""
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequences."""
    return packing.pack_documents(docs, packing.byte_tokenizer())


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicate), ("substring_dedup", repeated_passage),
          ("mixing", mix), ("packing", pack)]
#: SQL can express neither the fitted grammar nor the trained tokenizer's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
