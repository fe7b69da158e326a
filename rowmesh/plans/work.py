"""Work analysis of a product before it runs: scalar products by row, exact fill-in, balanced row ranges, hot indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import prefix_sums
from . import packs, strips

#: An inner index with more than this share of all scalar products is dealt over several tasks.
HOT_SHARE = 0.02
MOST_SALT = 64
#: A row with more than this share of all entries is not left to one task.
MOST_ROW_SHARE = 1 / 16


def flops_by_row(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """(row, flops): scalar products that each row of the result takes, 0 for empty ones."""
    sizes = b.groupBy(F.col("row").alias("col")).agg(F.count("*").alias("n"))
    work = a.join(sizes, "col").groupBy("row").agg(F.sum("n").alias("flops"))
    return a.sparkSession.range(rows).withColumnRenamed("id", "row").join(work, "row", "left").select("row", F.coalesce("flops", F.lit(0)).alias("flops"))


def fill_by_row(a: DataFrame, b: DataFrame, rows: int, planned: strips.Strips | None = None) -> DataFrame:
    """(row, nnz): entries of each row of the result, found by strips where these are ``planned``."""
    if planned:
        sizes = (packs if planned.cols else strips).fill(a, b, planned)
    else:
        cells = a.select("row", F.col("col").alias("k")).join(b.select(F.col("row").alias("k"), F.col("col").alias("j")), "k")
        sizes = cells.select("row", "j").distinct().groupBy("row").agg(F.count("*").alias("nnz"))
    return a.sparkSession.range(rows).withColumnRenamed("id", "row").join(sizes, "row", "left").select("row", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def largest_row(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """(most): entries of the fullest row of the result."""
    return fill_by_row(a, b, rows).agg(F.max("nnz").alias("most"))


def work_prefix(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """(i, products) for i in 0..rows: scalar products in all rows before i."""
    scanned = prefix_sums(flops_by_row(a, b, rows), "row", F.col("flops"), "products")
    zero = a.sparkSession.range(1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("products"))
    return zero.union(scanned.select((F.col("row") + 1).alias("i"), "products"))


def row_ranges(a: DataFrame, b: DataFrame, rows: int, workers: int) -> DataFrame:
    """(part, first_row) for part in 0..workers: contiguous row ranges of about equal work; the last bound is ``rows``.

    All bounds come from one aggregate over the prefix sums; the total is a scalar subquery."""
    prefix = work_prefix(a, b, rows)
    average = prefix.agg(F.expr(f"(max(products) + {int(workers) - 1}) div {int(workers)}").alias("average")).scalar()
    counted = prefix.agg(*(F.count_if(F.col("products") <= average * i).alias(f"c{i}") for i in range(1, workers)), F.max("i").alias("last"))
    bounds = F.array(F.lit(0).cast("long"), *(F.col(f"c{i}") - 1 for i in range(1, workers)), F.col("last"))
    return counted.select(F.posexplode(bounds).alias("part", "first_row"))


@dataclass(frozen=True)
class Estimate:
    products: int
    hottest: int
    salt: int
    hot: tuple[int, ...] = ()


def estimate(a: DataFrame, b: DataFrame, most_salt: int = MOST_SALT) -> Estimate:
    """Scalar products in all and at the busiest inner index, the hot indexes and the salt that evens them out. Two
    aggregates and a join; no more than 1 / ``HOT_SHARE`` indexes can be hot."""
    left = a.groupBy(F.col("col").alias("k")).agg(F.count("*").alias("x"))
    right = b.groupBy(F.col("row").alias("k")).agg(F.count("*").alias("y"))
    work = left.join(right, "k").select("k", (F.col("x") * F.col("y")).alias("n"))
    got = work.agg(F.sum("n").alias("n"), F.max("n").alias("m")).first()
    products, hottest = got["n"] or 0, got["m"] or 0
    if not products or hottest <= HOT_SHARE * products:
        return Estimate(products, hottest, 1)
    hot = tuple(sorted(r["k"] for r in work.where(F.col("n") > HOT_SHARE * products).collect()))
    return Estimate(products, hottest, min(most_salt, max(2, round(hottest / products / HOT_SHARE))), hot)


def fits_by_rows(a: DataFrame, b: DataFrame, most: int) -> bool:
    """Whether ``b`` has at most ``most`` entries, so that it can be broadcast, and no row of ``a`` would outweigh a task."""
    if b.limit(most + 1).count() > most:
        return False
    got = a.groupBy("row").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("m")).first()
    return not got["n"] or got["m"] <= MOST_ROW_SHARE * got["n"]


def chain_order(shapes: list[tuple[int, int]], sizes: list[int]) -> list[tuple[int, int]]:
    """Order in which to multiply a chain, as (position, position + 1) merges, least estimated scalar products first.

    Uniform sparsity is assumed: a product of r x m with p entries and m x c with q entries takes p q / m products and
    fills at most r c cells. Only shapes and counts are looked at."""
    n = len(shapes)
    best: dict[tuple[int, int], tuple[float, float, int]] = {(i, i): (0.0, float(sizes[i]), i) for i in range(n)}
    for span in range(1, n):
        for i in range(n - span):
            j, found = i + span, None
            for cut in range(i, j):
                (ca, na, _), (cb, nb, _) = best[i, cut], best[cut + 1, j]
                work = na * nb / shapes[cut][1]
                option = (ca + cb + work, min(work, float(shapes[i][0]) * shapes[j][1]), cut)
                found = min(found, option) if found else option
            best[i, j] = found
    merges: list[tuple[int, int]] = []

    def walk(i: int, j: int) -> None:
        if i < j:
            cut = best[i, j][2]
            walk(i, cut)
            walk(cut + 1, j)
            merges.append((i, cut + 1))

    walk(0, n - 1)
    return merges
