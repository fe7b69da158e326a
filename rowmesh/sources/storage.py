"""Parquet entry tables with the shape beside them, and the fingerprint if wanted, sorted so that a row is found by few row
groups."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import MatrixError
from ..functions.kinds import KINDS
from ..matrix import SparseMatrix
from ..operators import fingerprint
from ..shared import shared_path

SHAPE = "rows bigint, cols bigint, kind string, fingerprint string, elements bigint, nans bigint"


def save(m: SparseMatrix, path: str, with_fingerprint: bool = False) -> None:
    """Store ``m``; a fingerprint is taken of the entries as they are stored, by one more scan of these."""
    spark = m.df.sparkSession
    m.df.repartitionByRange("row").sortWithinPartitions("row", "col").write.parquet(f"{path}/entries")
    known = (None, None, None)
    if with_fingerprint:
        found = fingerprint.of(spark.read.parquet(f"{path}/entries"), m.kind)
        known = (f"{found.value:032x}", found.elements, found.nans)
    spark.createDataFrame([(m.rows(), m.cols(), m.kind.name, *known)], SHAPE).write.json(f"{path}/shape")


def kept(m: SparseMatrix) -> SparseMatrix:
    """``m`` with its entries stored in a shared folder, so that what reads them more than once computes them once."""
    spark = m.df.sparkSession
    path = shared_path(spark, "matrix")
    m.df.write.parquet(path)
    return m.like(spark.read.parquet(path))


def load(spark: SparkSession, path: str) -> SparseMatrix:
    shape = spark.read.schema(SHAPE).json(f"{path}/shape").first()
    if shape is None:
        raise MatrixError("no shape beside the entries")
    m = SparseMatrix(spark.read.parquet(f"{path}/entries"), shape["rows"], shape["cols"], KINDS[shape["kind"]])
    if shape["fingerprint"] is not None:
        m._fingerprint = fingerprint.Fingerprint(int(shape["fingerprint"], 16), shape["elements"], shape["nans"])
    return m
