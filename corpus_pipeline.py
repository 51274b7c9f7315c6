"""The corpus pipeline: five stages from raw documents to token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir). ``run``
writes every stage as Parquet to the shared checkpoint folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redline.llm import decontaminate, quality, simhash, substring_dedup
from redline.llm.common import cut, read
from redline.llm.queries import bpe_digests
from redline.plans.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents unlikely to have the best grade go."""
    ship_package(spark)
    return quality.select(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each near-duplicate group stays."""
    ship_package(spark)
    return simhash.keep_one(docs, shingle=3, radius=2, seed=42)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: repeated 100-byte strings are cut from the texts."""
    ship_package(spark)
    return substring_dedup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go."""
    ship_package(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token counts and digests of the encoded and decoded texts."""
    ship_package(spark)
    return bpe_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encode_decode),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
