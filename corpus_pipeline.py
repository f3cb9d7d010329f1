"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the folder that driver and executors share, and gives it to the
next stage. Every stage but the last returns the columns of ``documents``. Nulls, empty
texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import mixing, near_sets, packing, quality_rules, recompress
from tessella.llm.common import delete, discard_since, read, shared_path, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cleaned documents that pass the quality rules."""
    return quality_rules.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate class: five-word shingles,
    similarity 0.8; candidates from SimHash trees and MinHash keys."""
    return near_sets.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one; emptied ones go."""
    return recompress.clean(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the target weights ask for."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, mark = shared_path(spark, f"pipeline-{name}"), stored()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # what a stage read and wrote on its way is not needed once its result is written
        discard_since(spark, mark)
        if last:
            delete(spark, last)
        last = path
    return docs


#: Fingerprints, descent and tokenizers have no SQL; tests/llm/test_pipeline.py holds each
#: stage and the whole run against plain versions.
ORACLE_SQL = None
