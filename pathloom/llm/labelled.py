"""Labels for classifiers: rows that may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; null ids count as the text ''."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")) % modulus


def one_label_each(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label (0 or 1): null ids and labels are left out; of contradicting labels of one id the larger counts."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))


def sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of their id: the same at any partitioning."""
    return labels.orderBy(F.xxhash64("_id"), "_id").limit(most)
