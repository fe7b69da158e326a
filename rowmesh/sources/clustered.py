"""Matrices stored in an order, with a directory of their files, so that a read opens the files that it needs and no others.

In the order of rows, each entry is stored with its position, and the directory has the positions of each file: the n-th
entry, a slice and the rank of a cell read one block of files. In z-order, bits of row and column alternate, so that a file
covers a small rectangle, and the directory has its bounds: a point, a row, a column or a rectangle reads the files whose
rectangle it meets. ``save_by_index`` stores a matrix bucketed by row or column: products of two such matrices have no
exchange on the inner index.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MatrixError, MatrixIndexError
from ..functions.kinds import KINDS, Kind
from ..matrix import SparseMatrix
from ..plans import sized

#: Entries of a file.
FILE_ENTRIES = 2_000_000
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(c: Column) -> Column:
    """The low 31 bits of a number, each followed by a zero."""
    c = c.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    for shift, mask in _MASKS:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def z_order(row: Column, col: Column) -> list[Column]:
    """Sort keys that follow the z-curve: the high halves of row and column interleaved, then the low ones."""
    high = lambda c: F.shiftright(c, 31)
    return [F.shiftleft(_spread(high(row)), 1).bitwiseOR(_spread(high(col))), F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))]


class Clustered:
    """A stored matrix and its directory. ``order`` is ``rows`` or ``z``."""

    def __init__(self, spark: SparkSession, path: str):
        facts = spark.read.schema("rows bigint, cols bigint, kind string, nnz bigint, order string").json(f"{path}/shape").first()
        if facts is None:
            raise MatrixError("no shape beside the entries")
        self.spark, self.path, self.kind, self.order, self.nnz = spark, path, KINDS[facts["kind"]], facts["order"], facts["nnz"]
        self.shape = facts["rows"], facts["cols"]
        self.directory = spark.read.parquet(f"{path}/directory")

    @staticmethod
    def save(m: SparseMatrix, path: str, order: str = "rows", file_entries: int = FILE_ENTRIES) -> Clustered:
        """Store ``m`` below ``path``; needs a count. Files are cut where about ``file_entries`` are full.

        A task sorts the entries of several small files and writes these one after the other."""
        if order not in ("rows", "z"):
            raise ValueError("the order is rows or z")
        spark, nnz = m.df.sparkSession, m.nnz()
        files = max(1, ceil(nnz / file_entries))
        at_once = max(1, min(sized.PART_ROWS // file_entries, files // spark.sparkContext.defaultParallelism))
        tasks = ceil(files / at_once)
        if order == "rows":
            keyed = m.ranked().withColumn("task", F.floor(F.col("pos") / (at_once * file_entries)).cast("int"))
            dealt = keyed.repartitionById(tasks, F.col("task")).drop("task").sortWithinPartitions("pos")
        else:
            a, b = z_order(F.col("row"), F.col("col"))
            keyed = m.df.withColumns({"za": a, "zb": b, "pos": F.lit(None).cast("long")})
            dealt = keyed.repartitionByRange(tasks, "za", "zb").sortWithinPartitions("za", "zb").drop("za", "zb")
        (dealt.write.option("maxRecordsPerFile", file_entries) if at_once > 1 else dealt.write).parquet(f"{path}/entries")
        stored = spark.read.parquet(f"{path}/entries").withColumn("file", F.col("_metadata.file_path"))
        bounds = [f(c).alias(f"{name}_{c}") for c in ("pos", "row", "col") for name, f in (("first", F.min), ("last", F.max))]
        place = F.struct("row", "col") if order == "rows" else F.struct(*z_order(F.col("row"), F.col("col")))
        directory = stored.groupBy("file").agg(*bounds, F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        directory.repartition(1).sortWithinPartitions("first").write.parquet(f"{path}/directory")
        spark.createDataFrame([(m.rows(), m.cols(), m.kind.name, nnz, order)], "rows bigint, cols bigint, kind string, nnz bigint, order string").write.json(f"{path}/shape")
        return Clustered(spark, path)

    def files(self, where: Column) -> list[str]:
        return [r["file"] for r in self.directory.where(where).select("file").collect()]

    def _read(self, where: Column) -> DataFrame:
        """Entries of the files that fit ``where``; no file is opened to find out."""
        found = self.files(where)
        if not found:
            return self.spark.createDataFrame([], f"row bigint, col bigint, val {self.kind.type}, pos bigint")
        return self.spark.read.schema(f"row bigint, col bigint, val {self.kind.type}, pos bigint").parquet(*found)

    def matrix(self) -> SparseMatrix:
        return SparseMatrix(self._read(F.lit(True)), *self.shape, self.kind)

    def rectangle(self, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
        """(row, col, val) of the entries in rows[0] <= row < rows[1] and cols[0] <= col < cols[1]."""
        near = (F.col("first_row") < rows[1]) & (F.col("last_row") >= rows[0]) & (F.col("first_col") < cols[1]) & (F.col("last_col") >= cols[0])
        inside = (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
        return self._read(near).where(inside).select("row", "col", "val")

    def get(self, i: int, j: int):
        """The entry's value, or None where there is none; one file is read."""
        if not (0 <= i < self.shape[0] and 0 <= j < self.shape[1]):
            raise MatrixIndexError
        cell = [F.lit(x).cast("long") for x in (i, j)]
        key = F.struct(*(cell if self.order == "rows" else z_order(*cell)))
        got = self._read((F.col("first") <= key) & (F.col("last") >= key)).where((F.col("row") == i) & (F.col("col") == j)).first()
        return None if got is None else got["val"]

    def _ordered(self) -> None:
        if self.order != "rows":
            raise MatrixError("positions are stored in the order of rows only")

    def slice(self, start: int, stop: int) -> DataFrame:
        """(row, col, val, pos) of the entries at positions start to stop - 1; negative ones count from the end."""
        self._ordered()
        start, stop = (max(0, min(self.nnz, self.nnz + x if x < 0 else x)) for x in (start, stop))
        return self._read((F.col("first_pos") < stop) & (F.col("last_pos") >= start)).where((F.col("pos") >= start) & (F.col("pos") < stop))

    def nth(self, n: int) -> tuple:
        """The n-th entry in order; negative n counts from the end."""
        at = self.nnz + n if n < 0 else n
        got = self.slice(at, at + 1).first() if 0 <= at < self.nnz else None
        if got is None:
            raise MatrixIndexError
        return got["row"], got["col"], got["val"]

    def rank(self, i: int, j: int) -> int:
        """How many entries come before the cell (i, j), which need not be one."""
        self._ordered()
        cell = F.struct(F.lit(i).cast("long").alias("row"), F.lit(j).cast("long").alias("col"))
        before = self.directory.where(F.col("last") < cell).agg(F.sum("n")).first()[0] or 0
        return before + self._read((F.col("first") < cell) & (F.col("last") >= cell)).where(F.struct("row", "col") < cell).count()

    def step(self, i: int, j: int, n: int) -> tuple | None:
        """The entry ``n`` steps on from the first entry at (i, j) or after, or None beyond either end."""
        at = self.rank(i, j) + n
        return self.nth(at) if 0 <= at < self.nnz else None


def save_by_index(m: SparseMatrix, table: str, index: str, buckets: int) -> SparseMatrix:
    """``m`` as a table bucketed and sorted by ``row`` or ``col``. The product of a matrix by column with one by row, of as
    many buckets, has no exchange on the inner index."""
    if index not in ("row", "col"):
        raise ValueError("the index is row or col")
    m.df.repartition(buckets, index).write.bucketBy(buckets, index).sortBy(index).saveAsTable(table)
    return load_by_index(m.df.sparkSession, table, m.rows(), m.cols(), m.kind)


def load_by_index(spark: SparkSession, table: str, rows: int, cols: int, kind: Kind) -> SparseMatrix:
    return SparseMatrix(spark.table(table), rows, cols, kind)
