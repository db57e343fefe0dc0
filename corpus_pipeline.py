"""Corpus pipeline: five stages over ``documents``, each calling one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, decontaminate, pii, quality_rules, simhash
from larder.llm.common import prepare, table
from larder.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    prepare(spark)
    return quality_rules.kept_rows(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: the document of the least id of each group stays."""
    prepare(spark)
    return simhash.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a verified test item go."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: entities are replaced by surrogates, n_chars follows the text."""
    prepare(spark)
    return pii.replace(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids (four bytes each, little-endian) and the decoded text of every document."""
    prepare(spark)
    return bpe.code(docs, bpe.default_vocabulary()).select(F.col("id").alias("doc_id"), "n_tokens", "ids", "decoded")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

# Models, a graph search and a tokenizer: no stage can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
