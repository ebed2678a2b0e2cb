"""Rows picked within groups: the newest, the first few, turns taken between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], newest: list[str], columns: list[str]) -> DataFrame:
    """keys and columns of the row with the greatest `newest` values per key.

    An aggregate rather than a window: rows are reduced before the shuffle, so a hot key costs one row per task.
    """
    best = F.max_by(F.struct(*columns), F.struct(*newest)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col("best")[c].alias(c) for c in columns))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, name: str | None = None) -> DataFrame:
    """The first n rows of each key in the given order, with their rank as `name` if asked for."""
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
    return out.withColumn(rank, F.col(rank).cast("long")) if name else out.drop(rank)


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """Up to `limit` rows, the groups taking turns: every group's first row, then every group's second, and so on; at least one of each group."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    rows = df.withColumn("turn", turn).where(F.col("turn") <= limit)
    place = F.row_number().over(Window.orderBy("turn", group))
    return rows.withColumn("place", place).where((F.col("place") <= limit) | (F.col("turn") == 1))


def latest_then_ascending(df: DataFrame, order: str, tie: str, limit: int) -> DataFrame:
    """The newest `limit` rows, oldest first."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(limit).orderBy(F.asc(order), F.asc(tie))
