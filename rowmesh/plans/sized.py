"""Partitions by rows instead of bytes.

Adaptive execution puts partitions together by their compressed bytes, down to as many as there are cores. Entries compress
well, so their number in a task, and with it the memory of an aggregate or a sort, would grow with the input."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

#: Rows of a partition, about.
PART_ROWS = 500_000


def parts(df: DataFrame, rows: int) -> int | None:
    """How many partitions so many rows are worth, or None where one for each core is enough."""
    n = ceil(rows / PART_ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt out by ``keys``; as it is where one partition for each core is enough."""
    n = parts(df, rows)
    return df.repartition(n, *keys) if n else df


def in_order(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, in the order of ``keys``, by ranges."""
    n = parts(df, rows)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) if n else df.orderBy(*keys)
