"""Element-wise operators, products, transposition and comparison on entry tables.

Explicit zeros are kept: an entry is in a sum if it is in either operand, and in a product if any pair of entries meets
there, whatever the value comes to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Kind
from ..plans import sized


def add(a: DataFrame, b: DataFrame, kind: Kind) -> DataFrame:
    """One exchange with partial sums instead of a full outer join."""
    both = a.select("row", "col", "val").union(b.select("row", "col", "val"))
    total = both.groupBy("row", "col").agg(kind.total(kind.work(F.col("val"))).alias("val"))
    return total.select("row", "col", kind.settle(F.col("val")).alias("val"))


def sub(a: DataFrame, b: DataFrame, kind: Kind) -> DataFrame:
    """``a - b``, an absent entry counting as zero. Sides are summed apart, so that no value is negated on its own."""
    left = a.select("row", "col", F.col("val").alias("x"), F.lit(None).cast(kind.type).alias("y"))
    right = b.select("row", "col", F.lit(None).cast(kind.type).alias("x"), F.col("val").alias("y"))
    sides = left.union(right).groupBy("row", "col").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    sides = sides.select("row", "col", *(kind.work(F.coalesce(c, kind.lit(0))).alias(c) for c in ("x", "y")))
    return sides.select("row", "col", kind.settle(kind.minus(F.col("x"), F.col("y"))).alias("val"))


def combine(a: DataFrame, b: DataFrame, kind: Kind, f: Callable[[Column, Column], Column], left_alone: bool = True) -> DataFrame:
    """Any element-wise ``f``. Entries of ``a`` alone stay as they are, or become f(x, 0) without ``left_alone``; entries
    of ``b`` alone become f(0, y)."""
    joined = a.select("row", "col", F.col("val").alias("x")).join(b.select("row", "col", F.col("val").alias("y")), ["row", "col"], "full_outer")
    value = f(F.coalesce("x", kind.lit(0)), F.coalesce("y", kind.lit(0)))
    if left_alone:
        value = F.when(F.col("y").isNull(), F.col("x")).otherwise(value)
    return joined.select("row", "col", value.cast(kind.type).alias("val"))


#: Products of so many neighbouring inner indexes are summed apart where the order of a sum is to be fixed.
ORDER_BLOCK = 256
#: A piece of a block has about so many scalar products, and entries of either side, at most.
PIECE = 2_000_000


def _sums_in_order(t: pa.Table) -> pa.Table:
    """Cells of one piece: products are added one by one, from the lowest inner index to the highest."""
    left = t.filter(t["mine"])
    right = t.filter(pc.invert(t["mine"]))
    i, k, j, m = (x.to_numpy() for x in (left["at"], left["k"], right["at"], right["k"]))
    by_left, by_right = np.argsort(k, kind="stable"), np.argsort(m, kind="stable")
    i, k, j, m = i[by_left], k[by_left], j[by_right], m[by_right]
    start = np.searchsorted(m, k, "left")
    n = np.searchsorted(m, k, "right") - start
    l_at = np.repeat(np.arange(len(k)), n)
    r_at = np.arange(len(l_at)) + np.repeat(start - (np.cumsum(n) - n), n)
    (rows, i), (cols, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    cell = i[l_at] * len(cols) + j[r_at]
    if len(rows) * len(cols) <= 4 * len(cell):
        known = np.flatnonzero(np.bincount(cell, minlength=len(rows) * len(cols)))
        slot = np.zeros(len(rows) * len(cols), np.int64)
        slot[known] = np.arange(len(known))
        cell = slot[cell]
    else:
        known, cell = np.unique(cell, return_inverse=True)
    x, y = ([side[c].to_numpy()[order] for c in ("re", "im")] for side, order in ((left, by_left), (right, by_right)))
    (a, b), (c, d) = ([v[l_at] for v in x], [v[r_at] for v in y])
    sums = []
    for p in (a * c - b * d, a * d + b * c) if t["complex"][0].as_py() else (a * c, np.zeros(len(cell))):
        sums.append(np.full(len(known), -0.0))  # adding to -0.0 changes no number, not even a zero's sign
        np.add.at(sums[-1], cell, p)
    block = pa.array(np.full(len(known), t["block"][0].as_py(), np.int64))
    return pa.table({"block": block, "row": rows[known // len(cols)], "col": cols[known % len(cols)], "re": sums[0], "im": sums[1]})


def _block_sums(a: DataFrame, b: DataFrame, kind: Kind) -> DataFrame:
    """(row, col, block, p): the products of each block of inner indexes, summed where the block's entries have met.

    A job counts these entries. Only they and sums are shuffled. A block that is worth more than ``PIECE`` is a grid of pieces, rows of ``a`` by columns
    of ``b``, both by hash; as no row or column has more than ``ORDER_BLOCK`` entries in a block, pieces are even."""
    is_complex = F.lit(kind.name == "complex")
    values = [F.col("val.re").alias("re"), F.col("val.im").alias("im")] if kind.name == "complex" else [F.col("val").alias("re"), F.lit(0.0).alias("im")]
    block = F.floor(F.col("k") / ORDER_BLOCK).cast("long").alias("block")
    left = a.select(F.col("row").alias("at"), F.col("col").alias("k"), *values).select(block, F.lit(True).alias("mine"), "*")
    right = b.select(F.col("col").alias("at"), F.col("row").alias("k"), *values).select(block, F.lit(False).alias("mine"), "*")
    met = left.union(right).groupBy("block", "k").agg(F.count_if("mine").alias("x"), F.count_if(~F.col("mine")).alias("y"))
    met = met.groupBy("block").agg(F.sum(F.col("x") * F.col("y")).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).where("n > 0")
    pieces = F.ceil(F.greatest("n", "x", "y") / PIECE)
    met = met.withColumn("r", F.greatest(F.lit(1), F.least(pieces, F.ceil(F.sqrt(pieces * F.col("x") / F.col("y"))))))
    met = met.select("block", "r", F.ceil(pieces / F.col("r")).alias("c"), "x", "y")
    records = met.agg(F.sum(F.col("x") * F.col("c") + F.col("y") * F.col("r"))).first()[0] or 0
    met = met.drop("x", "y")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("at"), F.col(n))
    left = left.join(met, "block").withColumn("ri", deal("r")).withColumn("ci", every("c"))
    right = right.join(met, "block").withColumn("ri", every("r")).withColumn("ci", deal("c"))
    both = left.union(right).select("block", "ri", "ci", "mine", "at", "k", "re", "im", is_complex.alias("complex"))
    sums = sized.spread(both, records, "block", "ri", "ci").groupBy("block", "ri", "ci").applyInArrow(_sums_in_order, "block bigint, row bigint, col bigint, re double, im double")
    return sums.select("row", "col", "block", (F.struct("re", "im") if kind.name == "complex" else F.col("re")).alias("p"))


def _pairs(a: DataFrame, b: DataFrame, salt: int, hot: Sequence[int], by_rows: bool) -> DataFrame:
    """(i, k, x, j, y) for all entries with a.col = b.row. The ``hot`` inner indexes are dealt to ``salt`` tasks each, and
    only entries of these are copied; with ``by_rows``, rows of ``a`` are dealt out once and meet all of ``b``."""
    if by_rows:
        a, b = a.repartition("row"), F.broadcast(b)
    left = a.select(F.col("col").alias("k"), F.col("row").alias("i"), F.col("val").alias("x"))  # as the right side, so that a gram has one exchange
    right = b.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("val").alias("y"))
    if salt > 1 and hot and not by_rows:
        is_hot = F.col("k").isin(list(hot))
        left = left.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("i"), F.lit(salt))).otherwise(0))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_hot, salt - 1).otherwise(0).cast("long"))))
        return left.join(right, ["k", "salt"]).drop("salt")
    return left.join(right, "k")


def multiply(a: DataFrame, b: DataFrame, kind: Kind, salt: int = 1, hot: Sequence[int] = (), ordered: bool = False, by_rows: bool = False) -> DataFrame:
    """The sparse product: join on the inner index, sum by cell.

    ``by_rows`` is for a right side of a checked size: it is broadcast, and as each task holds whole rows of the result,
    only the entries of ``a`` are shuffled and no partial sums.

    Sums combine before the shuffle, which is by cell, so one heavy row spreads over tasks. ``ordered`` gives the same
    floating-point result on any cluster: products of ``ORDER_BLOCK`` neighbouring inner indexes are summed from the
    lowest to the highest, then these sums in the order of their blocks. So no group is longer than a block, or than the
    number of blocks."""
    if not ordered or kind.name not in ("double", "complex"):  # whole numbers come out the same in any order
        pairs = _pairs(a, b, salt, hot, by_rows).select(F.col("i").alias("row"), F.col("j").alias("col"), kind.product(F.col("x"), F.col("y")).alias("p"))
        total = pairs.groupBy("row", "col").agg(kind.total(F.col("p")).alias("val"))
        return total.select("row", "col", kind.settle(F.col("val")).alias("val"))
    lists = _block_sums(a, b, kind).groupBy("row", "col").agg(F.sort_array(F.collect_list(F.struct("block", "p"))).alias("terms"))
    rest = F.slice("terms", F.lit(2), F.size("terms"))
    total = F.aggregate(rest, F.col("terms")[0]["p"], lambda s, t: kind.plus(s, t["p"]))
    return lists.select("row", "col", kind.settle(total).alias("val"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def canonical(a: DataFrame, kind: Kind) -> DataFrame:
    """Without explicit zeros; NaN stays."""
    return a.where(~kind.is_zero(F.col("val")))


def differences(a: DataFrame, b: DataFrame, kind: Kind) -> DataFrame:
    """Cells whose values differ, absence counting as zero; NaN differs from everything, itself included."""
    sides = a.select("row", "col", F.col("val").alias("x")).join(b.select("row", "col", F.col("val").alias("y")), ["row", "col"], "full_outer")
    sides = sides.select("row", "col", F.coalesce("x", kind.lit(0)).alias("x"), F.coalesce("y", kind.lit(0)).alias("y"))
    if kind.name == "complex":
        same = (F.col("x.re") == F.col("y.re")) & (F.col("x.im") == F.col("y.im"))
    else:
        same = F.col("x") == F.col("y")
    return sides.where(~same | kind.is_nan(F.col("x")) | kind.is_nan(F.col("y")))


def structure_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries that one has and the other has not, explicit zeros included."""
    return a.select("row", "col", "val").exceptAll(b.select("row", "col", "val")).union(b.select("row", "col", "val").exceptAll(a.select("row", "col", "val")))
