"""Prefix sums over a dense index, in two levels so that no task sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def prefix_sums(df: DataFrame, index: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` (one row for each ``index``) with the sum of ``value`` over all rows up to and including its own.

    Sums within blocks of the index are windows with partitions; only one total for each block meets in a single task."""
    df = df.withColumn("_block", F.floor(F.col(index) / block)).withColumn("_value", value)
    inner = F.sum("_value").over(Window.partitionBy("_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    totals = df.groupBy("_block").agg(F.sum("_value").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_block", before.alias("_before"))
    return df.withColumn("_inner", inner).join(totals, "_block").withColumn(out, F.col("_before") + F.col("_inner")).drop("_block", "_value", "_inner", "_before")


def entry_prefix(df: DataFrame, value: Column, out: str, block: int = BLOCK, within: tuple[str, ...] = ()) -> DataFrame:
    """``df(row, col, ...)`` with the sum of ``value`` over all entries up to and including its own, in the order of row,
    column and ``within``.

    Sums run within ``block`` neighbouring columns of a row, and are shifted by the row's blocks and the rows before. So
    there is no window over all, nor over a row, however full it is."""
    df = df.withColumn("_block", F.floor(F.col("col") / block)).withColumn("_value", value)
    blocks = df.groupBy("row", "_block").agg(F.sum("_value").alias("_n"))
    rows = prefix_sums(blocks.groupBy("row").agg(F.sum("_n").alias("_n")), "row", F.col("_n"), "_upto").select("row", (F.col("_upto") - F.col("_n")).alias("_before"))
    in_row = F.coalesce(F.sum("_n").over(Window.partitionBy("row").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("_in_row", in_row).join(rows, "row").select("row", "_block", (F.col("_before") + F.col("_in_row")).alias("_start"))
    inner = F.sum("_value").over(Window.partitionBy("row", "_block").orderBy("col", *within).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_inner", inner).join(starts, ["row", "_block"]).withColumn(out, F.col("_start") + F.col("_inner")).drop("_block", "_value", "_inner", "_start")
