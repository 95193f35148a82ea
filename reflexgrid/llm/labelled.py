"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null keys are in no fold."""
    return F.crc32(F.col(key).cast("string")) % parts


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, text) of at most `rows` labelled documents of each class for which `train` holds, chosen by a hash of the key.

    Only the chosen keys (bounded by `rows`) are broadcast; null labels, keys without a document and null texts give no row.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & train).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    picked = [usable.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(rows) for v in (0, 1)]
    keys = picked[0].union(picked[1]).dropDuplicates(["key"])
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return found.join(F.broadcast(keys), "key").select("label", "text")
