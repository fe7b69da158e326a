"""Reading, writing and ordering entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Kind
from ..functions.scans import entry_prefix, prefix_sums


def element(a: DataFrame, i: int, j: int) -> DataFrame:
    """The entry at (i, j), if there is one; both equalities reach the scan."""
    return a.where((F.col("row") == i) & (F.col("col") == j)).select("row", "col", "val")


def upsert(a: DataFrame, new: DataFrame, kind: Kind, drop_zeros: bool = False) -> DataFrame:
    """``a`` with the entries of ``new`` (unique cells) instead of its own; zeros are stored, or delete with ``drop_zeros``."""
    new = new.select("row", "col", F.col("val").cast(kind.type).alias("val"))
    kept = a.select("row", "col", "val").join(new.select("row", "col"), ["row", "col"], "left_anti")
    if drop_zeros:
        new = new.where(~kind.is_zero(F.col("val")))
    return kept.union(new)


def row_counts(a: DataFrame, rows: int) -> DataFrame:
    """(row, n) for every row of the shape, empty ones with 0."""
    counts = a.groupBy("row").agg(F.count("*").alias("n"))
    return a.sparkSession.range(rows).withColumnRenamed("id", "row").join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))


def offsets(a: DataFrame, rows: int) -> DataFrame:
    """(i, offset) for i in 0..rows: entries in all rows before i."""
    scanned = prefix_sums(row_counts(a, rows), "row", F.col("n"), "offset")
    zero = a.sparkSession.range(1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("offset"))
    return zero.union(scanned.select((F.col("row") + 1).alias("i"), "offset"))


def ranked(a: DataFrame) -> DataFrame:
    """``a`` with pos, the place of each entry in (row, col) order from 0."""
    places = entry_prefix(a.select("row", "col", "val"), F.lit(1), "pos")
    return places.select("row", "col", "val", (F.col("pos") - 1).alias("pos"))


def compare_positions(row, col, other_row, other_col) -> Column:
    """-1, 0 or 1: positions compare by row, then by column; null where either is none."""
    mine, other = F.struct(F.col(row).alias("r"), F.col(col).alias("c")), F.struct(F.col(other_row).alias("r"), F.col(other_col).alias("c"))
    known = F.col(row).isNotNull() & F.col(other_row).isNotNull()
    return F.when(known, F.when(mine < other, -1).when(mine == other, 0).otherwise(1))


def steps(a: DataFrame) -> DataFrame:
    """``a`` with next_row and next_col, the position one step on in (row, col) order; null at the end."""
    places = ranked(a)
    following = places.select((F.col("pos") - 1).alias("pos"), F.col("row").alias("next_row"), F.col("col").alias("next_col"))
    return places.join(following, "pos", "left").select("row", "col", "val", "next_row", "next_col")


def grouped(a: DataFrame, ordered: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """The row-grouped form (row, indices, vals) of the rows that have entries; columns ascend if ``ordered``. Where rows
    are whole within some other columns, by which they are partitioned, naming these saves the exchange."""
    pairs = F.collect_list(F.struct("col", "val"))
    lists = a.groupBy(*within, "row").agg((F.array_sort(pairs, lambda x, y: F.when(x["col"] < y["col"], -1).when(x["col"] > y["col"], 1).otherwise(0)) if ordered else pairs).alias("e"))
    return lists.select("row", F.col("e.col").alias("indices"), F.col("e.val").alias("vals"))


def ungrouped(g: DataFrame) -> DataFrame:
    """Entries of a row-grouped form, with pos, the place within the row."""
    zipped = F.posexplode(F.arrays_zip(F.col("indices").alias("col"), F.col("vals").alias("val"))).alias("pos", "e")
    return g.select("row", zipped).select("row", F.col("e.col").alias("col"), F.col("e.val").alias("val"), "pos")
