"""Whether a matrix is a product, by random vectors (Freivalds, 1977): C x against A (B x).

Three products of a matrix with vectors take the place of a second product of matrices, so the work is linear in the entries
of A, B and C. All vectors go through each of the three at once, as columns of one aggregate; their elements are hashes of
the index, so no vector is stored or joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.kinds import Kind

#: Moduli for whole numbers, two primes below 2^31, so that products of two residues fit 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)


def _bit(index: Column, t: int, seed: int) -> Column:
    return F.call_function("getbit", F.xxhash64(F.lit(seed), index), F.lit(t))


def _mod(c: Column, p: int) -> Column:
    return F.pmod(c, F.lit(p).cast("long"))


def _vectors(kind: Kind, trials: int, seed: int):
    """Names, and how to weigh a value by the vectors' element at a column, multiply a value with a sum of such, and sum up."""
    names = [f"v{t}" for t in range(len(PRIMES) if kind.name == "int64" else trials)]
    if kind.name == "int64":
        weigh = lambda v, j, t: _mod(_mod(v, PRIMES[t]) * _mod(F.xxhash64(F.lit(seed), F.lit(t), j), PRIMES[t]), PRIMES[t])
        times = lambda v, y, t: _mod(_mod(v, PRIMES[t]) * y, PRIMES[t])
        total = lambda c, t: _mod(F.sum(c), PRIMES[t])
    elif kind.name in ("double", "complex"):
        nothing = kind.lit(0)
        weigh = lambda v, j, t: F.when(_bit(j, t, seed) == 1, v).otherwise(kind.minus(nothing, v))
        times, total = (lambda v, y, t: kind.product(v, y)), (lambda c, t: kind.total(c))
    else:
        weigh = lambda v, j, t: F.when(_bit(j, t, seed) == 1, kind.work(v)).otherwise(kind.work(kind.lit(0)))
        times, total = (lambda v, y, t: kind.product(v, y)), (lambda c, t: kind.settle(kind.total(c)))
    return names, weigh, times, total


def residuals(c: DataFrame, a: DataFrame, b: DataFrame, kind: Kind, trials: int, seed: int) -> DataFrame:
    """(row, w0, w1, ..., z0, z1, ...) for the rows of ``c`` and of the product: C x and A (B x) for each vector x."""
    names, weigh, times, total = _vectors(kind, trials, seed)

    def on(m: DataFrame) -> DataFrame:
        weighed = m.select("row", *(weigh(F.col("val"), F.col("col"), t).alias(n) for t, n in enumerate(names)))
        return weighed.groupBy("row").agg(*(total(F.col(n), t).alias(n) for t, n in enumerate(names)))

    bx = on(b).withColumnRenamed("row", "k")
    abx = a.select("row", F.col("col").alias("k"), F.col("val").alias("x")).join(bx, "k")
    abx = abx.select("row", *(times(F.col("x"), F.col(n), t).alias(n) for t, n in enumerate(names))).groupBy("row").agg(*(total(F.col(n), t).alias(n) for t, n in enumerate(names)))
    cx = on(c)
    for n in names:
        cx, abx = cx.withColumnRenamed(n, n.replace("v", "w")), abx.withColumnRenamed(n, n.replace("v", "z"))
    sides = cx.join(abx, "row", "full_outer")
    zero = F.lit(0).cast("long") if kind.name == "int64" else kind.lit(0)
    return sides.select("row", *(F.coalesce(s, zero).alias(s) for n in names for s in (n.replace("v", "w"), n.replace("v", "z"))))


def disagreement(c: DataFrame, a: DataFrame, b: DataFrame, kind: Kind, trials: int, seed: int) -> DataFrame:
    """(apart, nan_c, nan_product): how far the two sides are apart at most (of whole numbers: 1 or 0), and whether either
    has a NaN."""
    found = residuals(c, a, b, kind, trials, seed)
    names = [x for x in found.columns if x.startswith("w")]
    pairs = [(F.col(n), F.col(n.replace("w", "z"))) for n in names]
    if kind.name in ("double", "complex"):
        apart = F.greatest(*(F.when(kind.is_nan(w) | kind.is_nan(z), 0.0).otherwise(kind.magnitude(kind.minus(w, z))) for w, z in pairs), F.lit(0.0))
    else:
        apart = F.when(reduce(lambda x, y: x | y, (w != z for w, z in pairs)), 1.0).otherwise(0.0)
    some = lambda k: F.coalesce(F.bool_or(reduce(lambda x, y: x | y, (kind.is_nan(p[k]) for p in pairs))), F.lit(False))
    return found.agg(F.coalesce(F.max(apart), F.lit(0.0)).alias("apart"), some(0).alias("nan_c"), some(1).alias("nan_product"))


def _forms(cells: DataFrame, a: DataFrame, b: DataFrame, seed: int) -> DataFrame:
    """(name, f0, f1): y C x of every named matrix of ``cells(name, row, col, val)``, and (y A) (B x) without a name, modulo
    each prime. A task sums its own cells, fewer than 2^32, so no cell and no row's sum is shuffled."""
    names = [f"f{t}" for t in range(len(PRIMES))]
    element = lambda index, side, t: _mod(F.xxhash64(F.lit(seed), F.lit(side), F.lit(t), index), PRIMES[t])
    weigh = lambda v, index, side, t: _mod(_mod(v, PRIMES[t]) * element(index, side, t), PRIMES[t])
    total = lambda keys: lambda m: m.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names)).select("name", *(_mod(F.col(n), p).alias(n) for n, p in zip(names, PRIMES, strict=True)))

    def on(m: DataFrame, inner: str, index: str, side: str) -> DataFrame:
        weighed = m.select(F.col(inner).alias("k"), *(weigh(F.col("val"), F.col(index), side, t).alias(n) for t, n in enumerate(names)))
        return weighed.groupBy("k").agg(*(_mod(F.sum(n), p).alias(f"{side}{n}") for n, p in zip(names, PRIMES, strict=True)))

    product = on(a, "col", "row", "y").join(on(b, "row", "col", "x"), "k")
    product = product.select(F.lit(None).cast("string").alias("name"), *(_mod(F.col(f"y{n}") * F.col(f"x{n}"), p).alias(n) for n, p in zip(names, PRIMES, strict=True)))
    found = cells.select("name", *(_mod(weigh(F.col("val"), F.col("row"), "y", t) * element(F.col("col"), "x", t), PRIMES[t]).alias(n) for t, n in enumerate(names)))
    sides = [m.withColumn("task", F.spark_partition_id()).transform(total(["name", "task"])) for m in (found, product)]
    return sides[0].union(sides[1]).transform(total(["name"]))


def passing_cells(cells: DataFrame, a: DataFrame, b: DataFrame, kind: Kind, seed: int = 0) -> dict[str, bool]:
    """Which matrices of 64-bit integers, told apart by the name of each of their ``cells(name, row, col, val)``, pass as the
    product of ``a`` and ``b``. Matrices without a cell are not listed.

    Vectors stand on both sides: y C x against (y A) (B x), so a matrix costs two numbers a task, in whatever order its cells
    come, and what is made from one product is tested by one scan of it. By one prime a wrong matrix passes with a
    probability of 2^-30 at most, by both of 2^-60, and always if all differences are multiples of both."""
    if kind.name != "int64":
        raise ValueError("only for 64-bit integers")
    found = {r["name"]: r[1:] for r in _forms(cells, a, b, seed).collect()}
    expected = found.pop(None, (0,) * len(PRIMES))
    return {name: got == expected for name, got in found.items()}


def disagreements(candidates: dict[str, DataFrame], a: DataFrame, b: DataFrame, kind: Kind, trials: int, seed: int) -> dict[str, Row]:
    """``disagreement`` of several matrices with the product of ``a`` and ``b``. It is one job, so what they have in common is
    shuffled once, and so is the product with the vectors."""
    sides = [disagreement(c, a, b, kind, trials, seed).select(F.lit(name).alias("name"), "*") for name, c in candidates.items()]
    return {r["name"]: r for r in reduce(DataFrame.union, sides).collect()}


def passing(candidates: dict[str, DataFrame], a: DataFrame, b: DataFrame, kind: Kind, trials: int = 20, seed: int = 0) -> dict[str, bool]:
    """Which of several matrices of whole numbers pass as the product of ``a`` and ``b``, by one job. Those of 64-bit integers
    that are made from one another's cells are cheaper by ``passing_cells``."""
    if kind.name in ("double", "complex"):
        raise ValueError("only for whole numbers")
    return {name: r["apart"] == 0 for name, r in disagreements(candidates, a, b, kind, trials, seed).items()}
