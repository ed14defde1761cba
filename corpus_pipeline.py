"""A corpus pipeline: every stage reads what the stage before it has kept.

Toxicity and quality filters, one document of each near-duplicate class, mixing
to target weights, and packing into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealis.llm import mixing, packing, quality, simhash, toxicity
from arealis.llm.common import in_checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents ranked below the quality threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash near-duplicates stays."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it leaves out go."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in the sequences."""
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
# The classifiers are trained, so no SQL states the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    base = f"{in_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
