"""Matrix Market coordinate files, read and written by Spark.

Lines keep their order through (file, start of the split, number within the task), so no task needs the whole file.
Zero entries are dropped, a cell given twice keeps its last value that is not zero, symmetric files are mirrored, and the
entry count of the size line is not trusted unless ``strict``. With ``compat`` reading stops without a word at the first
line that is none, and complex files are never mirrored; otherwise such lines raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MatrixMarketError, ProductMismatch, ZeroDimensionError
from ..functions.kinds import COMPLEX, DOUBLE, INT64, Kind
from ..matrix import SparseMatrix
from ..plans import sized
from ..shared import shared_path

HEADER = re.compile(r"%%MatrixMarket matrix coordinate (integer|real|complex|pattern) (general|symmetric|skew-symmetric|hermitian)")
FLOAT = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:inf|nan)"
VALUES = {"integer": r"(-?\d+)", "real": rf"((?i:{FLOAT}))", "complex": rf"((?i:{FLOAT}))\s+((?i:{FLOAT}))"}
KIND = {"integer": INT64, "real": DOUBLE, "complex": COMPLEX}


def _number(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("^[+-]?nan$"), F.lit(float("nan"))).when(low.rlike("^-inf$"), F.lit(float("-inf"))).when(low.rlike(r"^\+?inf$"), F.lit(float("inf"))).otherwise(c.try_cast("double"))


def read(spark: SparkSession, path: str, compat: bool = False, strict: bool = False) -> SparseMatrix:
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n")).alias("at"), "value")
    lines = lines.withColumn("value", F.regexp_replace("value", "\r$", ""))
    top = lines.agg(F.min_by("value", "at").alias("header"), F.min_by(F.when(~F.col("value").startswith("%"), F.struct("at", "value")), F.when(~F.col("value").startswith("%"), F.col("at"))).alias("size")).first()
    header = HEADER.fullmatch(top["header"] or "")
    if not header:
        raise MatrixMarketError("the first line is no coordinate header")
    field, symmetry = header.groups()
    if field == "pattern" or symmetry in ("skew-symmetric", "hermitian"):
        raise MatrixMarketError(f"unsupported: {field} {symmetry}")
    size = re.fullmatch(r"\s*(\d+)\s+(\d+)\s+(\d+)\s*", top["size"]["value"] if top["size"] else "")
    if not size:
        raise MatrixMarketError("there is no size line")
    rows, cols, told = map(int, size.groups())
    if not rows or not cols:
        raise ZeroDimensionError
    start = F.struct(*(F.lit(x).alias(n) for x, n in zip(top["size"]["at"], "fsn", strict=True)))
    shape = rf"^\s*(\d+)\s+(\d+)\s+{VALUES[field]}\s*$"
    body = lines.where(F.col("at") > start)
    group = lambda i: F.regexp_extract("value", shape, i)
    kind = KIND[field]
    value = {"integer": lambda: group(3).try_cast("bigint"), "real": lambda: _number(group(3)), "complex": lambda: F.struct(_number(group(3)).alias("re"), _number(group(4)).alias("im"))}[field]()
    i, j = group(1).try_cast("bigint"), group(2).try_cast("bigint")
    parsed = body.select("at", "value", F.col("value").rlike(shape).alias("ok"), i.alias("i"), j.alias("j"), value.alias("val"))
    good = F.col("ok") & F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("val").isNotNull()
    facts = parsed.where("trim(value) <> ''").agg(
        F.min(F.when(~good, F.col("at"))).alias("bad"),
        F.min_by(F.when(~good, F.col("value")), F.when(~good, F.col("at"))).alias("line"),
        F.count_if(good).alias("n"),
    ).first()
    if facts["bad"] is not None and not compat:
        raise MatrixMarketError(f"malformed line: {facts['line']!r}")
    if strict and facts["n"] != told:
        raise MatrixMarketError(f"the size line tells of {told} entries, there are {facts['n']}")
    kept = parsed.where(good)
    if facts["bad"] is not None:
        kept = kept.where(F.col("at") < F.struct(*(F.lit(x).alias(n) for x, n in zip(facts["bad"], "fsn", strict=True))))
    outside = (F.col("i") < 1) | (F.col("i") > rows) | (F.col("j") < 1) | (F.col("j") > cols)
    if not kept.where(outside).isEmpty():
        raise MatrixMarketError("an index is outside the shape")
    kept = kept.where(~kind.is_zero(F.col("val"))).select((F.col("i") - 1).alias("row"), (F.col("j") - 1).alias("col"), "val", "at")
    if symmetry == "symmetric" and not (compat and field == "complex"):
        if rows != cols:
            raise MatrixMarketError("a symmetric matrix must be square")
        kept = kept.union(kept.where("row <> col").select("col", "row", "val", "at"))
    kept = sized.spread(kept, facts["n"] * (2 if symmetry == "symmetric" else 1), "row", "col")
    return SparseMatrix(kept.groupBy("row", "col").agg(F.max_by("val", "at").alias("val")), rows, cols, kind)


def read_folder(spark: SparkSession, folder: str, compat: bool = False) -> Iterator[tuple[str, SparseMatrix]]:
    """(path, matrix) of each file right below ``folder``, in order of paths; subfolders are passed over."""
    files = spark.read.format("binaryFile").load(folder).select("path").orderBy("path")
    return ((r["path"], read(spark, r["path"], compat)) for r in files.toLocalIterator())


@dataclass(frozen=True)
class Corpus:
    """The matrices of one element kind in a folder: ``entries`` (file, row, col, val) and ``shapes`` (file, rows, cols)."""

    entries: DataFrame
    shapes: DataFrame
    kind: Kind

    def matrix(self, file: str) -> SparseMatrix:
        shape = self.shapes.where(F.col("file") == file).first()
        if shape is None:
            raise MatrixMarketError(f"no such file: {file}")
        return SparseMatrix(self.entries.where(F.col("file") == file), shape["rows"], shape["cols"], self.kind)

    def squares(self) -> DataFrame:
        """(file, row, col, val) of the products of all matrices with themselves, in one join and one aggregate."""
        if not self.shapes.where("rows <> cols").isEmpty():
            raise ProductMismatch
        left = self.entries.select("file", "row", F.col("col").alias("k"), F.col("val").alias("x"))
        right = self.entries.select("file", F.col("row").alias("k"), "col", F.col("val").alias("y"))
        products = left.join(right, ["file", "k"]).select("file", "row", "col", self.kind.product(F.col("x"), F.col("y")).alias("p"))
        sums = products.groupBy("file", "row", "col").agg(self.kind.total(F.col("p")).alias("val"))
        return sums.select("file", "row", "col", self.kind.settle(F.col("val")).alias("val"))


def read_corpus(spark: SparkSession, folder: str, compat: bool = False) -> dict[str, Corpus]:
    """All files right below ``folder`` by the field of their header, as ``read`` reads each, but with one scan for all.

    Headers and size lines come from one aggregate by file, and so does what is wrong with any entry; entries are parsed
    once and stored. The first bad file, by its path, raises."""
    place = F.struct(F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), place.alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    told = ~F.col("value").startswith("%")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min_by(F.when(told, F.struct("at", "value")), F.when(told, F.col("at"))).alias("size"))
    size = r"^\s*(\d+)\s+(\d+)\s+(\d+)\s*$"
    part = lambda i: F.regexp_extract("header", f"^{HEADER.pattern}$", i)
    number = lambda i: F.regexp_extract("size.value", size, i).try_cast("bigint")
    heads = heads.select("file", part(1).alias("field"), part(2).alias("symmetry"), "size.at", number(1).alias("rows"), number(2).alias("cols"), number(3).alias("told"))
    heads = heads.withColumn(
        "error",
        F.when(F.col("field") == "", "the first line is no coordinate header")
        .when((F.col("field") == "pattern") | F.col("symmetry").isin("skew-symmetric", "hermitian"), F.concat_ws(" ", F.lit("unsupported:"), "field", "symmetry"))
        .when(F.col("rows").isNull() | F.col("cols").isNull() | F.col("told").isNull(), "there is no size line")
        .when((F.col("rows") == 0) | (F.col("cols") == 0), "a matrix must have at least one row and one column")
        .when((F.col("symmetry") == "symmetric") & (F.col("rows") != F.col("cols")) & ~(F.lit(compat) & (F.col("field") == "complex")), "a symmetric matrix must be square"),
    )
    path = shared_path(spark, "matrix-market-heads")
    heads.write.parquet(path)
    heads = spark.read.schema(heads.schema).parquet(path)
    _raise_first(heads)
    good = heads.withColumnRenamed("at", "start")
    body = lines.join(good, "file").where("at > start").select("file", "at", "value", "field", "symmetry", "rows", "cols")
    entry = r"^\s*(\d+)\s+(\d+)\s+(\S+)(?:\s+(\S+))?\s*$"
    piece = lambda i: F.regexp_extract("value", entry, i)
    body = body.withColumns({"i": piece(1).try_cast("bigint"), "j": piece(2).try_cast("bigint"), "x": piece(3), "y": piece(4)})
    whole, real = F.when(F.col("x").rlike(r"^-?\d+$"), F.col("x").try_cast("bigint")), lambda c: F.when(F.col(c).rlike(f"^(?i:{FLOAT})$"), _number(F.col(c)))
    body = body.withColumns({"whole": whole, "re": real("x"), "im": real("y")})
    single = F.col("y") == ""
    ok = F.when(F.col("field") == "integer", F.col("whole").isNotNull() & single).when(F.col("field") == "real", F.col("re").isNotNull() & single).otherwise(F.col("re").isNotNull() & F.col("im").isNotNull())
    parsed = body.withColumn("ok", ok & F.col("i").isNotNull() & F.col("j").isNotNull()).drop("x", "y")
    path = shared_path(spark, "matrix-market-entries")
    parsed.write.parquet(path)
    parsed = spark.read.schema(parsed.schema).parquet(path)
    bad = ~F.col("ok") & (F.trim("value") != "")
    ends = parsed.where(bad).groupBy("file").agg(F.min("at").alias("end"), F.min_by("value", "at").alias("line"))
    if not compat:
        _raise_first(ends.select("file", F.concat(F.lit("malformed line: "), F.col("line")).alias("error")))
    kept = parsed.where("ok").join(ends.select("file", "end"), "file", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    outside = (F.col("i") < 1) | (F.col("i") > F.col("rows")) | (F.col("j") < 1) | (F.col("j") > F.col("cols"))
    _raise_first(kept.where(outside).select("file", F.lit("an index is outside the shape").alias("error")))
    found = {}
    for field, kind in KIND.items():
        value = {"integer": F.col("whole"), "real": F.col("re"), "complex": F.struct("re", "im")}[field].alias("val")
        mine = kept.where(F.col("field") == field).select("file", (F.col("i") - 1).alias("row"), (F.col("j") - 1).alias("col"), value, "at", "symmetry").where(~kind.is_zero(F.col("val")))
        if not (compat and field == "complex"):
            mine = mine.union(mine.where("symmetry = 'symmetric' and row <> col").select("file", "col", "row", "val", "at", "symmetry"))
        entries = mine.groupBy("file", "row", "col").agg(F.max_by("val", "at").alias("val"))
        found[field] = Corpus(entries, heads.where(F.col("field") == field).select("file", "rows", "cols"), kind)
    return found


def _raise_first(errors: DataFrame) -> None:
    """Raise for the first file that has an error."""
    first = errors.where("error is not null").orderBy("file").first()
    if first is not None:
        raise (ZeroDimensionError() if "at least one row" in first["error"] else MatrixMarketError(f"{first['file']}: {first['error']}"))


def number_text(c: Column, kind) -> Column:
    """Whole numbers without a point or exponent, others as Spark shows them."""
    if kind is not DOUBLE:
        return c.cast("string")
    return F.when((c == F.floor(c)) & (F.abs(c) < 2.0**63), c.cast("decimal(20,0)").cast("string")).otherwise(F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("string")))


def entry_lines(m: SparseMatrix) -> DataFrame:
    """(row, col, line), lines as the file has them, indexes from 1."""
    value = F.concat_ws(" ", number_text(F.col("val.re"), DOUBLE), number_text(F.col("val.im"), DOUBLE)) if m.kind is COMPLEX else number_text(F.col("val"), m.kind)
    return m.df.select("row", "col", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, value).alias("line"))


def write(m: SparseMatrix, path: str) -> None:
    """A folder of part files that read in order of their names are one general file, row by row; needs one count."""
    field = {"double": "real", "complex": "complex"}.get(m.kind.name, "integer")
    spark = m.df.sparkSession
    nnz = m.nnz()
    head = spark.createDataFrame([(-2, -1, f"%%MatrixMarket matrix coordinate {field} general"), (-1, -1, f"{m.rows()} {m.cols()} {nnz}")], "row bigint, col bigint, line string")
    sized.in_order(head.union(entry_lines(m)), nnz, "row", "col").select("line").write.text(path)
