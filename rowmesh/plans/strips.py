"""Products by strips of rows, so that no scalar product is ever shuffled.

Neighbouring rows of A form a strip with about ``STRIP_FLOPS`` scalar products. A strip is a partition: it gets its entries of
A, and of B each row that they meet, once and as arrays. Cells are summed there, in memory that the strip's work bounds, so
the shuffle is linear in the entries where strips share rows of B, and a few bytes a scalar product where they share none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import INT64, Kind

#: Scalar products that one strip is worth, and from which on a product is cut into strips at all.
STRIP_FLOPS = 2_000_000
#: Of so few cells, far fewer than scalar products, each task sums all.
FEW_CELLS = 65_536
#: Strips are made of groups of neighbouring rows, so many at most.
MOST_GROUPS = 16_384
#: A record holds so many entries of a row of B at most, on average.
RECORD = 50_000


@dataclass(frozen=True)
class Strips:
    """``of`` (g, first, parts): the first part of a group of ``width`` rows, and over how many parts its inner indexes are
    dealt, which is more than one for a group that outweighs a strip; ``parts`` in all; whether any group is ``cut``;
    ``groups``, the rows of ``of``, and scalar products in all. With the numbers of ``inner`` indexes and ``cols`` it is a plan for
    ``packs``."""

    of: DataFrame
    width: int
    parts: int
    cut: bool
    groups: tuple[tuple[int, int, int], ...] = ()
    flops: int = 0
    inner: int = 0
    cols: int = 0

    def group(self, row: Column) -> Column:
        return F.floor(row / F.lit(self.width)).cast("long")


def flops(a: DataFrame, b: DataFrame) -> int:
    """Scalar products of ``a @ b``: two aggregates and a join."""
    left = a.groupBy(F.col("col").alias("k")).agg(F.count("*").alias("x"))
    right = b.groupBy(F.col("row").alias("k")).agg(F.count("*").alias("y"))
    return int(left.join(right, "k").agg(F.sum(F.col("x").cast("decimal(38,0)") * F.col("y"))).first()[0] or 0)


def plan(a: DataFrame, b: DataFrame, rows: int, least: int = 1, strip: int = STRIP_FLOPS) -> Strips:
    """Strips of about equal work, ``least`` at least. One row for each of ``MOST_GROUPS`` groups reaches the driver."""
    width = max(1, ceil(rows / MOST_GROUPS))
    sizes = b.groupBy(F.col("row").alias("col")).agg(F.count("*").alias("n"))
    weights = a.select("row", "col").join(sizes, "col").groupBy(F.floor(F.col("row") / width).cast("long").alias("g")).agg(F.sum("n").alias("n"))
    found = sorted((r["g"], r["n"]) for r in weights.collect())
    share = max(1, min(strip, ceil(sum(n for _, n in found) / least)))
    of, at, load = [], 0, 0
    for g, n in found:
        if load and load + n > 1.25 * share:
            at, load = at + 1, 0
        parts = 1 if n <= 2 * share else ceil(n / share)
        of.append((g, at, parts))
        load += n
        if parts > 1:
            at, load = at + parts, 0
    parts = max((first + n for _, first, n in of), default=1)
    return Strips(a.sparkSession.createDataFrame(of, "g bigint, first int, parts int"), width, parts, any(n > 1 for *_, n in of), tuple(of), sum(n for _, n in found))


def _split(name: str, c: Column) -> list[Column]:
    """A whole number as its 16 low bits and the rest. In a sorted record the rest hardly changes, so it compresses to nothing."""
    return [F.shiftright(c, 16).alias(f"{name}_high"), (c.bitwiseAND(F.lit(65_535).cast("long")) - 32_768).cast("short").alias(f"{name}_low")]


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 16).bitwiseOR(low.cast("long") + 32_768)


def _deal(a: DataFrame, b: DataFrame, strips: Strips, waves: int = 1) -> DataFrame:
    """(part, k, ls, rs): the entries ``ls(i, x, w)`` of ``a`` in a part, which is a strip or ``waves`` neighbouring ones, and the records ``rs`` of the row of ``b``, which have an
    array for each of j_high, j_low and y, or y_high and y_low where values are 64-bit integers."""
    at = F.col("first") + F.when(F.col("parts") > 1, F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).otherwise(0)
    left = a.select(F.col("row").alias("i"), F.col("col").alias("k"), F.col("val").alias("x"), strips.group(F.col("row")).alias("g"))
    left = left.join(F.broadcast(strips.of), "g").select(F.floor(at / waves).cast("int").alias("part"), "k", "i", "x", F.pmod(at, F.lit(waves)).cast("byte").alias("w"))
    needed = left.select("k", "part").groupBy("k").agg(F.collect_set("part").alias("parts"))
    entries = b.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("val").alias("y")).repartition("k")
    counts = b.groupBy(F.col("row").alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > RECORD)
    long = counts.select("k", F.ceil(F.col("n") / RECORD).alias("segs"))
    entries = entries.join(F.broadcast(long), "k", "left").withColumn("seg", F.coalesce(F.pmod(F.xxhash64("j"), F.col("segs")), F.lit(0).cast("long")))
    fields = _split("j", F.col("j")) + (_split("y", F.col("y")) if dict(entries.dtypes)["y"] == "bigint" else [F.col("y")])
    records = entries.select("k", "seg", F.struct(*fields).alias("e")).groupBy("k", "seg").agg(F.sort_array(F.collect_list("e")).alias("e"))
    names = records.schema["e"].dataType.elementType.names
    right = records.join(needed, "k").select(F.explode("parts").alias("part"), "k", F.struct(*(F.col(f"e.{n}").alias(n) for n in names)).alias("r"))
    l_type, r_type = left.select(F.struct("i", "x", "w").alias("l")).schema["l"].dataType, right.schema["r"].dataType
    both = left.select("part", "k", F.struct("i", "x", "w").alias("l"), F.lit(None).cast(r_type).alias("r")).union(right.select("part", "k", F.lit(None).cast(l_type).alias("l"), "r"))
    lists = both.repartitionById(ceil(strips.parts / waves), F.col("part")).groupBy("part", "k").agg(F.collect_list("l").alias("ls"), F.collect_list("r").alias("rs"))
    return lists.where((F.size("ls") > 0) & (F.size("rs") > 0))


def cells(a: DataFrame, b: DataFrame, kind: Kind, strips: Strips) -> DataFrame:
    """(part, row, col, val) with sums of work values, each cell once in a part and in one part alone, if no group is cut."""
    return _sums(_deal(a, b, strips), kind)


def _sums(dealt: DataFrame, kind: Kind) -> DataFrame:
    pairs = dealt.select("part", "rs", F.inline("ls")).select("part", "i", "x", F.explode("rs").alias("r"))
    names = pairs.schema["r"].dataType.names
    pairs = pairs.select("part", F.col("i").alias("row"), "x", *(F.col(f"r.{n}").alias(n) for n in names), F.posexplode("r.j_low").alias("at", "low"))
    here = lambda n: F.get(n, F.col("at"))
    y = here("y") if "y" in names else _joined(here("y_high"), here("y_low"))
    products = pairs.select("part", "row", _joined(here("j_high"), F.col("low")).alias("col"), kind.product(F.col("x"), y).alias("p"))
    return products.groupBy("part", "row", "col").agg(kind.total(F.col("p")).alias("val"))


def sides(a: DataFrame, strips: Strips) -> tuple[DataFrame, DataFrame | None]:
    """The entries of ``a`` in groups that are whole, and those in groups that are cut, if there are any."""
    if not strips.cut:
        return a, None
    marked = a.withColumn("g", strips.group(F.col("row"))).join(F.broadcast(strips.of.select("g", "parts")), "g")
    return tuple(marked.where(c).select("row", "col", "val") for c in ("parts = 1", "parts > 1"))


def multiply(a: DataFrame, b: DataFrame, kind: Kind, strips: Strips, waves: int = 1) -> DataFrame:
    """(row, col, val) of the product. Only sums in groups that are cut are shuffled.

    With ``waves``, so many neighbouring strips share the records of ``b`` in the shuffle. Each strip has a task of its own
    that reads the share and takes what is the strip's, so less is written, more is read, and memory stays that of a strip."""
    whole, cut = sides(a, strips)
    dealt = _deal(whole, b, strips, waves)
    own = lambda n: dealt.withColumn("ls", F.filter("ls", lambda entry: entry["w"] == n)).where(F.size("ls") > 0)
    found = reduce(DataFrame.union, (_sums(own(n) if waves > 1 else dealt, kind) for n in range(waves))).select("row", "col", "val")
    if cut is not None:
        found = found.union(cells(cut, b, kind, strips).groupBy("row", "col").agg(kind.total(F.col("val")).alias("val")))
    return found.select("row", "col", kind.settle(F.col("val")).alias("val"))


def fill(a: DataFrame, b: DataFrame, strips: Strips) -> DataFrame:
    """(row, nnz) of the rows of the product that have entries."""
    ones = [m.select("row", "col", F.lit(1).cast("long").alias("val")) for m in (a, b)]
    return multiply(*ones, INT64, strips).groupBy("row").agg(F.count("*").alias("nnz"))
