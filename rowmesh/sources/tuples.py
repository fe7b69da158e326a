"""Tuple text: ``(rows,cols,entries)`` on the first line, then a line of ``(row,col,value)`` for each row with entries.

The layout of the tuples is an assumption, as the specification shows it in pictures only. Indexes count from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TupleTextError
from ..functions.kinds import DOUBLE, INT64, Kind
from ..matrix import SparseMatrix
from .matrix_market import number_text

ENTRY = r"\((\d+),(\d+),([^()]+)\)"


def row_lines(m: SparseMatrix) -> DataFrame:
    """(row, line): the entries of each row that has some, by column, single spaces between."""
    shown = F.concat(F.lit("("), F.col("row"), F.lit(","), F.col("col"), F.lit(","), number_text(F.col("val"), m.kind), F.lit(")"))
    lists = m.df.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", shown.alias("s")))).alias("e"))
    return lists.select("row", F.array_join(F.col("e.s"), " ").alias("line"))


def write(m: SparseMatrix, path: str) -> None:
    head = m.df.sparkSession.createDataFrame([(-1, f"({m.rows()},{m.cols()},{m.nnz()})")], "row bigint, line string")
    head.union(row_lines(m)).orderBy("row").select("line").write.text(path)


def read(spark: SparkSession, path: str, kind: Kind = INT64) -> SparseMatrix:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"), "value")
    lines = lines.withColumn("at", F.struct("f", "s", "n"))
    first = lines.agg(F.min_by(F.struct("at", "value"), "at").alias("x")).first()["x"]
    head = re.fullmatch(r"\((\d+),(\d+),(\d+)\)", first["value"] if first else "")
    if not head:
        raise TupleTextError("the first line is no shape")
    start = F.struct(*(F.lit(x).alias(n) for x, n in zip(first["at"], "fsn", strict=True)))
    body = lines.where(F.col("at") > start)
    if not body.where(~F.col("value").rlike(rf"^{ENTRY}(?: {ENTRY})*$")).isEmpty():
        raise TupleTextError("a line is no row of entries")
    one = F.explode(F.regexp_extract_all("value", F.lit(ENTRY), F.lit(0))).alias("e")
    part = lambda i: F.regexp_extract("e", ENTRY, i)
    number = part(3).try_cast("double" if kind is DOUBLE else kind.type)
    entries = body.select(one).select(part(1).cast("bigint").alias("row"), part(2).cast("bigint").alias("col"), number.alias("val"))
    return SparseMatrix(entries, int(head[1]), int(head[2]), kind)
