"""Joins whose sides are told apart by what they hold, not by Spark's estimate: rows that were taken out of a small file's columns look small to it, however many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dictionary is broadcast.
LISTED_ROWS = 100_000


def by_key(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input: both are shuffled and sorted, neither is gathered."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def by_list(rows: DataFrame, listed: DataFrame, on: list[str] | str, limit: int = LISTED_ROWS) -> DataFrame:
    """The inner join of ``rows`` with a dictionary, which alone is broadcast, and only if its counted rows stay under ``limit``."""
    few = listed.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(listed), on) if few else by_key(rows, listed, on)
