"""Labels for the classifiers: folds by a checksum of the id, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as its empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def training_labels(labels: DataFrame, label: str, in_training: Column) -> DataFrame:
    """(doc_id, y): one label per document in the training folds; of several, the largest."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & in_training)
    return own.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def bounded(df: DataFrame, n: int) -> DataFrame:
    """At most n rows, those of smallest hash of doc_id: the same on any layout."""
    return df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
