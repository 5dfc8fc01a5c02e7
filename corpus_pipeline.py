"""The corpus pipeline: documents through five stages, each a corpus operator whose decisions take effect.

Every stage gets all that its predecessor kept, written as Parquet in the shared folder and read again. All but the last
keep the columns of documents. Rows with null ids or texts pass: an empty text is not toxic, holds no benchmark words
and no secret, equals other empty texts, and is packed as an end alone; a row without an id belongs to no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from astroloom.llm import decontaminate, packing, secrets, simhash, toxicity
from astroloom.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the network, trained on the labels outside the held-out fold, scores 0.3 or more."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, pairs of five-word Jaccard 0.8 or more."""
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark windows out, and rejects documents that are mostly made of them."""
    return decontaminate.drop_hit_words(docs, table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("simhash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("secret scan", secret), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
