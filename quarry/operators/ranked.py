"""First-wins deduplication, per-key caps, priority merges and pages of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError


def first_wins(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """Of the rows that share the keys the first in the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def cap_per_key(df: DataFrame, key: str, order: list[str | Column], cap: int = 2, more: str = "more_from_symbol", parts: int = 64) -> DataFrame:
    """The first ``cap`` rows of each key; the last kept one carries how many were left out, if any.

    A key's rows are first dealt into ``parts`` by their hash; each part gives its first rows and its number, so no task meets all rows of a key.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    w = Window.partitionBy(key, "_part")
    rows = df.withColumn("_part", part).withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)}).filter(F.col("_rn") <= cap)
    w = Window.partitionBy(key)
    rows = rows.withColumns({"_k": F.row_number().over(w.orderBy(*order)), "_all": F.sum(F.when(F.col("_rn") == 1, F.col("_n"))).over(w)}).filter(F.col("_k") <= cap)
    return rows.withColumn(more, F.when((F.col("_k") == cap) & (F.col("_all") > cap), F.col("_all") - cap)).drop("_part", "_rn", "_n", "_k", "_all")


def page(df: DataFrame, order: list[str | Column], limit: int, offset: int = 0, position: str = "position", more: str | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the whole order, numbered from 1 over all pages; ``more`` names a column that tells whether rows follow.

    The sort is a top-k: each task keeps offset + limit rows at most, and one to see whether more follow; only these are numbered.
    """
    if limit < 1 or offset < 0:
        raise QueryError("invalid_request", "limit must be positive and offset not negative")
    top = df.orderBy(*order).limit(offset + limit + bool(more))
    rows = top.withColumn(position, F.row_number().over(Window.orderBy(*order)))
    if more:
        rows = rows.withColumn(more, F.max(position).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > offset + limit)
    return rows.filter((F.col(position) > offset) & (F.col(position) <= offset + limit))


def check_offset(df: DataFrame, offset: int) -> None:
    """An offset at the end is an empty page; beyond it, an error."""
    if offset and df.limit(offset).count() < offset:
        raise QueryError("invalid_cursor", "the cursor is beyond the last row")


def merge_by_priority(df: DataFrame, key: str = "declaration_id", priority: str = "priority", ties: tuple[str, ...] = ()) -> DataFrame:
    """One row of each declaration: repository before package, as ``priority`` encodes."""
    return first_wins(df, [key], [priority, *ties])
