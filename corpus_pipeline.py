"""From raw documents to packed training sequences: five stages, each written out and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelcube.llm import exact_dedup, mixing, packing, quality, simhash
from labelcube.llm.common import Scratch, documents


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    return quality.keep_good(docs, quality.co_train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the smallest id."""
    return exact_dedup.exact_dedup(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash, the document of the smallest id."""
    return simhash.one_per_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix of their sources draws them."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [("quality", good_quality), ("exact", no_exact_copies), ("near", no_near_copies), ("mixing", mixed), ("packing", packed)]

#: The classifier and the tokenizer can't be said in SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        known = len(Scratch.made)
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        Scratch.clear(known)  # what the stage wrote on its way
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
