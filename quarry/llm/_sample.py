"""A bounded sample of labelled training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents outside the held-out fold.

    The labels are cut to ``max_rows`` by a hash of the id before anything is joined, so what is broadcast is
    bounded by that parameter, and texts of other documents are not shuffled. An id with several labels takes the
    largest; rows with a null id, label or text don't train.
    """
    chosen = (
        labels.select(F.col(id_col).alias("sample_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("sample_id").isNotNull() & F.col("label").isin(0, 1) & (remainder("sample_id", folds) != held_out))
        .groupBy("sample_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "sample_id").select("sample_id", "text", "label")
