"""From raw documents to packed training windows: quality, exact dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import exact_dedup, jaccard_join, packing, quality_rules, substring_dedup
from ragloom.llm.common import documents, materialise
from ragloom.llm.token_counts import byte_tokenizer_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go; labels of the held-out fold aren't learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality_rules.fold())
    return quality_rules.accepted(docs, quality_rules.train(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) the row with the largest id stays."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five-word shingles, the row with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a document with a smaller id has too are cut out; every row stays."""
    return substring_dedup.cut(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 ids."""
    return packing.pack(docs, byte_tokenizer_files())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings), ("packing", packed)]
#: A trained classifier and a packing plan aren't expressible in SQL; tests replay the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
