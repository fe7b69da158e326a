"""SparseMatrix: a lazily evaluated entry table with a shape known to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DimensionError, MatrixIndexError, NanNormError, ProductMismatch, ShapeMismatch
from .functions.kinds import COMPLEX, DOUBLE, INT64, Kind, entry_schema
from .operators import access, algebra, checks, fingerprint, verify
from .plans import deal, fill, packs, strips, work


class SparseMatrix:
    """Entries ``(row, col, val)`` with unique cells inside ``rows`` x ``cols``. Zeros that are entries count as explicit.

    Nothing here changes a matrix: writing gives a new one. NaN values make a matrix unequal to every matrix."""

    def __init__(self, df: DataFrame, rows: int, cols: int, kind: Kind = INT64):
        if rows < 1 or cols < 1:
            raise DimensionError
        self.df, self._rows, self._cols, self.kind = df.select("row", "col", "val"), int(rows), int(cols), kind
        self._fingerprint: fingerprint.Fingerprint | None = None

    # construction

    @classmethod
    def empty(cls, spark: SparkSession, rows: int, cols: int | None = None, kind: Kind = INT64) -> SparseMatrix:
        return cls(spark.createDataFrame([], entry_schema(kind)), rows, rows if cols is None else cols, kind)

    @classmethod
    def identity(cls, spark: SparkSession, n: int, kind: Kind = INT64) -> SparseMatrix:
        if n < 1:
            raise DimensionError
        return cls(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), kind.lit(1).alias("val")), n, n, kind)

    @classmethod
    def of(cls, spark: SparkSession, entries: Iterable[tuple], rows: int, cols: int, kind: Kind = INT64) -> SparseMatrix:
        """From (row, col, value) tuples in memory."""
        wrap = (lambda v: (complex(v).real, complex(v).imag)) if kind is COMPLEX else (float if kind is DOUBLE else int)
        found = [(int(i), int(j), wrap(v)) for i, j, v in entries]
        if any(not (0 <= i < rows and 0 <= j < cols) for i, j, _ in found):
            raise MatrixIndexError
        return cls(spark.createDataFrame(found, entry_schema(kind)), rows, cols, kind)

    def like(self, df: DataFrame, rows: int | None = None, cols: int | None = None) -> SparseMatrix:
        return SparseMatrix(df, rows or self._rows, cols or self._cols, self.kind)

    # shape and access

    def rows(self) -> int:
        return self._rows

    def cols(self) -> int:
        return self._cols

    @property
    def shape(self) -> tuple[int, int]:
        return self._rows, self._cols

    def nnz(self) -> int:
        """Explicit entries, zeros included."""
        return self.df.count()

    def _within(self, i: int, j: int) -> None:
        if not (0 <= i < self._rows and 0 <= j < self._cols):
            raise MatrixIndexError

    def get(self, i: int, j: int):
        """The entry's value, or None where there is none."""
        self._within(i, j)
        got = access.element(self.df, i, j).first()
        return None if got is None else got["val"]

    def value(self, i: int, j: int):
        """The value with absence read as zero."""
        got = self.get(i, j)
        return got if got is not None else (0.0 if self.kind is DOUBLE else 0)

    def set(self, i: int, j: int, value, drop_zeros: bool = False) -> tuple[SparseMatrix, object]:
        """A matrix with the entry written, and the value that was there before. ``drop_zeros`` makes a zero delete."""
        before = self.get(i, j)
        new = self.df.sparkSession.range(1).select(F.lit(i).cast("long").alias("row"), F.lit(j).cast("long").alias("col"), self.kind.lit(value).alias("val"))
        return self.like(access.upsert(self.df, new, self.kind, drop_zeros)), before

    def set_many(self, new: DataFrame, drop_zeros: bool = False) -> SparseMatrix:
        """All entries of ``new(row, col, val)`` written at once, in one anti-join; its cells must be unique and inside."""
        outside = new.where((F.col("row") < 0) | (F.col("row") >= self._rows) | (F.col("col") < 0) | (F.col("col") >= self._cols))
        if not outside.isEmpty():
            raise MatrixIndexError
        return self.like(access.upsert(self.df, new, self.kind, drop_zeros))

    # order

    def ordered(self) -> DataFrame:
        return self.df.orderBy("row", "col")

    def reversed(self) -> DataFrame:
        return self.df.orderBy(F.desc("row"), F.desc("col"))

    def ranked(self) -> DataFrame:
        return access.ranked(self.df)

    def nth(self, n: int):
        """The n-th entry in order; negative n counts from the end."""
        n = self.nnz() + n if n < 0 else n
        got = self.ranked().where(F.col("pos") == n).first()
        if got is None:
            raise MatrixIndexError
        return got["row"], got["col"], got["val"]

    def __iter__(self) -> Iterator[tuple]:
        return ((r["row"], r["col"], r["val"]) for r in self.ordered().toLocalIterator())

    def __reversed__(self) -> Iterator[tuple]:
        return ((r["row"], r["col"], r["val"]) for r in self.reversed().toLocalIterator())

    # algebra

    def _same_shape(self, other: SparseMatrix) -> None:
        if self.shape != other.shape:
            raise ShapeMismatch

    def __add__(self, other: SparseMatrix) -> SparseMatrix:
        self._same_shape(other)
        return self.like(algebra.add(self.df, other.df, self.kind))

    def __sub__(self, other: SparseMatrix) -> SparseMatrix:
        self._same_shape(other)
        return self.like(algebra.sub(self.df, other.df, self.kind))

    def combine(self, other: SparseMatrix, f: Callable[[Column, Column], Column], left_alone: bool = True) -> SparseMatrix:
        self._same_shape(other)
        return self.like(algebra.combine(self.df, other.df, self.kind, f, left_alone))

    def multiply(self, other: SparseMatrix, salt: int | str = 1, ordered: bool = False, broadcast_entries: int = 0, waves: int = 1) -> SparseMatrix:
        """The product. Its scalar products are counted first, by a job; where they are more than one strip is worth, strips of
        rows are multiplied apart, a hot inner index in each of them, and there are at least ``salt`` strips. What follows is
        for smaller ones, and doubles that are ``ordered`` never go by strips. With ``waves``, so many strips share what is shuffled of
        the right side, and each of them reads it all: less disk, more reading.

        With ``salt`` the work of each inner index is measured; those that hold too much of it are dealt to ``salt`` tasks
        each, or to as many as it takes with ``"auto"``.

        With ``broadcast_entries``, the right side's entries are counted; up to so many they are broadcast and the rows of
        this matrix are dealt out once, unless one row would outweigh a task."""
        if self._cols != other._rows:
            raise ProductMismatch
        planned = None if ordered and self.kind.name in ("double", "complex") else self._strips(other, 1 if salt == "auto" else int(salt))
        if planned and planned.cols:
            return self.like(packs.multiply(self.df, other.df, self.kind, planned), self._rows, other._cols)
        if planned:
            return self.like(strips.multiply(self.df, other.df, self.kind, planned, waves), self._rows, other._cols)
        by_rows = broadcast_entries > 0 and work.fits_by_rows(self.df, other.df, broadcast_entries)
        factor, hot = 1, ()
        if salt != 1 and not by_rows:
            measured = work.estimate(self.df, other.df)
            factor, hot = (measured.salt if salt == "auto" else int(salt)), measured.hot
        return self.like(algebra.multiply(self.df, other.df, self.kind, factor, hot, ordered, by_rows), self._rows, other._cols)

    def _strips(self, other: SparseMatrix, least: int = 1) -> strips.Strips | None:
        """Strips for the product with ``other``, or None if it is worth no more than one, or if its cells are so few that tasks
        had better sum all of them; needs its scalar products."""
        flops = strips.flops(self.df, other.df)
        if flops <= strips.STRIP_FLOPS or self._rows * other._cols <= min(strips.FEW_CELLS, flops // 1000):
            return None
        least = max(least, self.df.sparkSession.sparkContext.defaultParallelism)
        if flops > packs.LEAST_FLOPS:
            return packs.plan(self.df, other.df, (*self.shape, other._cols), least)
        return strips.plan(self.df, other.df, self._rows, least)

    def multiply_balanced(self, other: SparseMatrix, parts: int | None = None) -> SparseMatrix:
        """The product on ``parts`` partitions of equal flops, or as many as flops and estimated fill are worth."""
        if self._cols != other._rows:
            raise ProductMismatch
        return self.like(deal.balanced(self.df, other.df, self.kind, (*self.shape, other._cols), parts), self._rows, other._cols)

    def multiply_on_grid(self, other: SparseMatrix, grid: tuple[int, int] | None = None) -> SparseMatrix:
        """The product by a grid of row strips times column strips; no sums are shuffled, entries are copied instead."""
        if self._cols != other._rows:
            raise ProductMismatch
        return self.like(deal.on_grid(self.df, other.df, self.kind, (*self.shape, other._cols), grid), self._rows, other._cols)

    def __matmul__(self, other: SparseMatrix) -> SparseMatrix:
        return self.multiply(other)

    __mul__ = __matmul__

    def squared(self) -> SparseMatrix:
        return self.multiply(self)

    def transpose(self) -> SparseMatrix:
        return self.like(algebra.transpose(self.df), self._cols, self._rows)

    def canonical(self) -> SparseMatrix:
        return self.like(algebra.canonical(self.df, self.kind))

    def equals(self, other: SparseMatrix) -> bool:
        """Same shape and all elements equal, absence being zero."""
        return self.shape == other.shape and algebra.differences(self.df, other.df, self.kind).isEmpty()

    def fingerprint(self) -> fingerprint.Fingerprint:
        """A sum of hashes of all elements but zeros, known after the first call or from storage."""
        if self._fingerprint is None:
            self._fingerprint = fingerprint.of(self.df, self.kind)
        return self._fingerprint

    def matches(self, other: SparseMatrix) -> bool:
        """As ``equals``, but matrices with different fingerprints are told apart without a join; where these are known no
        entry is read. Equal ones are compared exactly."""
        if self.shape != other.shape:
            return False
        if fingerprint.family(self.kind) == fingerprint.family(other.kind):
            mine = self.fingerprint()
            if mine.nans or mine != other.fingerprint():
                return False
        return self.equals(other)

    def __eq__(self, other: object) -> bool:
        """As ``equals``, by running a job; a matrix has no hash."""
        return self.equals(other) if isinstance(other, SparseMatrix) else NotImplemented

    def __ne__(self, other: object) -> bool:
        return not self.equals(other) if isinstance(other, SparseMatrix) else NotImplemented

    __hash__ = None

    def same_structure(self, other: SparseMatrix) -> bool:
        """Same shape and the same explicit entries."""
        return self.shape == other.shape and algebra.structure_differences(self.df, other.df).isEmpty()

    # forms

    def grouped(self, ordered: bool = True) -> DataFrame:
        return access.grouped(self.df, ordered)

    def multiply_grouped(self, other: SparseMatrix, ordered: bool = True) -> DataFrame:
        """The row-grouped form of the product; rows of one strip are grouped where they are summed."""
        if self._cols != other._rows:
            raise ProductMismatch
        planned = self._strips(other)
        if not planned or planned.cut:
            return self.multiply(other).grouped(ordered)
        if planned.cols:
            return packs.grouped(self.df, other.df, self.kind, planned)
        found = strips.cells(self.df, other.df, self.kind, planned).withColumn("val", self.kind.settle(F.col("val")))
        return access.grouped(found, ordered, ("part",))

    def offsets(self) -> DataFrame:
        return access.offsets(self.df, self._rows)

    @classmethod
    def from_grouped(cls, g: DataFrame, rows: int, cols: int, kind: Kind = INT64) -> SparseMatrix:
        return cls(access.ungrouped(g), rows, cols, kind)

    # checks

    def invariants(self, canonical: bool = False) -> dict[str, bool]:
        return checks.entry_invariants(self.df, self._rows, self._cols, self.kind, canonical).first().asDict()

    def inf_norm(self):
        return checks.inf_norm(self.df, self.kind)

    def is_good_product_of(self, lhs: SparseMatrix, rhs: SparseMatrix, n: str = "cols") -> bool:
        """Whether this is ``lhs @ rhs`` up to rounding. n is ``cols`` (columns of the result) or ``inner``.

        NaN here is good only where the product has some as well; then and where the operands have NaN, there is no norm."""
        expected = lhs @ rhs
        self._same_shape(expected)
        got = checks.difference_norm(expected.df, self.df, self.kind).first()
        if got["nan_y"] and not got["nan_x"]:
            return False
        bound = checks.error_bound(self._cols if n == "cols" else lhs._cols, lhs.inf_norm(), rhs.inf_norm())
        if got["nan"]:
            raise NanNormError
        return got["norm"] <= bound

    def passes_as_product_of(self, lhs: SparseMatrix, rhs: SparseMatrix, n: str = "cols", trials: int = 20, seed: int = 0) -> bool:
        """As ``is_good_product_of``, and for whole numbers whether this equals the product, but by random vectors instead of
        a second product. A good product always passes.

        Of doubles, a matrix that is off by more than the tolerance in some cell is found with a probability of at least
        1 - 2^-trials, in rings one with any wrong cell. Of 64-bit integers, two vectors of residues miss a wrong cell once
        in about 2^62, whatever ``trials`` says, and always if all differences are multiples of both moduli. The tolerance is
        the error bound and what rounding adds to the three products with vectors."""
        return passing_products({"": self}, lhs, rhs, n, trials, seed)[""]

    def dump(self) -> str:
        return checks.scientific_dump(self.df).first()["dump"]

    # work

    def flops_by_row(self, other: SparseMatrix) -> DataFrame:
        return work.flops_by_row(self.df, other.df, self._rows)

    def fill_by_row(self, other: SparseMatrix) -> DataFrame:
        return work.fill_by_row(self.df, other.df, self._rows, self._strips(other))

    def estimated_fill(self, other: SparseMatrix) -> DataFrame:
        """(row, estimate): about as many entries as each row of the product has, from sketches."""
        return fill.by_row(self.df, other.df, self._rows)

    def row_ranges(self, other: SparseMatrix, workers: int) -> DataFrame:
        return work.row_ranges(self.df, other.df, self._rows, workers)


def passing_products(candidates: dict[str, SparseMatrix], lhs: SparseMatrix, rhs: SparseMatrix, n: str = "cols", trials: int = 20, seed: int = 0) -> dict[str, bool]:
    """Which of several matrices pass as ``lhs @ rhs``, as by ``passes_as_product_of``, but by one job for all."""
    if lhs._cols != rhs._rows:
        raise ProductMismatch
    if any(m.shape != (lhs._rows, rhs._cols) for m in candidates.values()):
        raise ShapeMismatch
    if not 1 <= trials <= 64:
        raise ValueError("from 1 to 64 vectors")
    found, norms = {}, None
    kind = next(iter(candidates.values())).kind
    for name, got in verify.disagreements({name: m.df for name, m in candidates.items()}, lhs.df, rhs.df, kind, trials, seed).items():
        if got["nan_c"] and not got["nan_product"]:
            found[name] = False
        elif kind.name not in ("double", "complex"):
            found[name] = got["apart"] == 0
        else:
            norms = norms or (lhs.inf_norm(), rhs.inf_norm())
            if got["nan_c"] or got["nan_product"]:
                raise NanNormError
            found[name] = got["apart"] <= sum(checks.error_bound(k, *norms) for k in (rhs._cols if n == "cols" else lhs._cols, lhs._cols + rhs._cols))
    return found


def chain_product(matrices: list[SparseMatrix]) -> SparseMatrix:
    """The product of a chain in the order of least estimated work; needs one count of each matrix."""
    for a, b in zip(matrices, matrices[1:], strict=False):
        if a.cols() != b.rows():
            raise ProductMismatch
    parts = dict(enumerate(matrices))
    for left, right in work.chain_order([m.shape for m in matrices], [m.nnz() for m in matrices]):
        parts[left] = parts[left] @ parts.pop(right)
    return reduce(lambda a, b: a @ b, parts.values())
