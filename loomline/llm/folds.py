"""Labelled folds by a checksum of the id, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds


def is_held_out(key: Column, folds: int, fold: int) -> Column:
    return F.coalesce(remainder(key, folds) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, bound: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y) of at most ``bound`` distinct labels (id and value) outside the fold, taken by a hash of the id, so that these labels are small enough to send to every executor. An id whose row is repeated trains once, by the text of the smallest hash."""
    y = labels.select(labels[key].alias(key), labels[label].cast("double").alias("y")).where(F.col("y").isNotNull() & F.col(key).isNotNull() & (remainder(F.col(key), folds) != fold)).distinct()
    y = y.orderBy(F.xxhash64(key), key, "y").limit(bound)
    rows = docs.select(docs[key].alias(key), docs[text].alias("text")).join(F.broadcast(y), key)
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    return rows.groupBy(key, "y").agg(first).select(key, "text", "y")
