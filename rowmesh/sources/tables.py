"""Matrices that the driver's tables hold. Keys are dense and start at 0; shapes come from the dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kinds import COMPLEX, DOUBLE, WRAP8, WRAP64
from ..matrix import SparseMatrix
from ..plans import sized
from . import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quantities(spark: SparkSession, sf_dir: str, row: str, col: str, flag: str | None = None) -> DataFrame:
    """Quantities of lines by ``row`` and ``col``. Hardly any two lines share a cell, so they are dealt out as they are."""
    lineitem = table(spark, sf_dir, "lineitem")
    lines = lineitem.where(F.col("l_returnflag") == flag) if flag else lineitem
    lines = lines.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col("l_quantity").cast("long").alias("q"))
    return sized.spread(lines, lineitem.count(), "row", "col").groupBy("row", "col").agg(F.sum("q").alias("val"))


def supplier_part(spark: SparkSession, sf_dir: str, flag: str | None = None) -> SparseMatrix:
    """Quantity by supplier and part, of one return flag or of all."""
    return SparseMatrix(_quantities(spark, sf_dir, "l_suppkey", "l_partkey", flag), table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count())


def signs(m: SparseMatrix) -> SparseMatrix:
    """1 for even and -1 for odd values, so that products cancel."""
    return m.like(m.df.withColumn("val", F.when(F.col("val") % 2 == 0, 1).otherwise(-1).cast("long")))


def order_part(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Quantity by order and part; very sparse, and some orders have no line."""
    return SparseMatrix(_quantities(spark, sf_dir, "l_orderkey", "l_partkey"), table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "part").count())


def nation_nation(spark: SparkSession, sf_dir: str, flag: str | None = None) -> SparseMatrix:
    """Quantity by nation of the customer and of the supplier, of one return flag or of all.

    The entries are stored, as they are few and took a join of all lines. Lines meet their orders with the customers' nations
    already there, and are summed by supplier before they meet these."""
    lines = table(spark, sf_dir, "lineitem")
    lines = (lines.where(F.col("l_returnflag") == flag) if flag else lines).select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customers, "o_custkey").select("l_orderkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    sums = lines.join(orders, "l_orderkey").groupBy("c_nationkey", "l_suppkey").agg(F.sum("q").alias("q")).join(suppliers, "l_suppkey")
    found = sums.groupBy(F.col("c_nationkey").cast("long").alias("row"), F.col("s_nationkey").cast("long").alias("col")).agg(F.sum("q").alias("val"))
    n = table(spark, sf_dir, "nation").count()
    return storage.kept(SparseMatrix(found, n, n))


def user_event(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Events by user and type, types in alphabetical order."""
    events = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.orderBy("event_type")) - 1  # one row for each type
    types = events.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", place.cast("long").alias("col"))
    users = events.agg(F.max("user_id")).first()[0] + 1
    counts = events.groupBy(F.col("user_id").alias("row"), "event_type").agg(F.count("*").alias("val"))
    return SparseMatrix(counts.join(types, "event_type").select("row", "col", "val"), users, types.count())


def embedding(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Vectors as rows of doubles."""
    vectors = table(spark, sf_dir, "embeddings")
    cols = vectors.agg(F.max(F.size("embedding"))).first()[0]
    entries = vectors.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val"))
    return SparseMatrix(entries.select("row", F.col("col").cast("long"), F.col("val").cast("double")), vectors.count(), cols, DOUBLE)


def as_wrap8(m: SparseMatrix) -> SparseMatrix:
    return SparseMatrix(m.df.withColumn("val", (F.pmod(F.col("val") + 128, F.lit(256)) - 128).cast("tinyint")), m.rows(), m.cols(), WRAP8)


def as_wrap64(m: SparseMatrix, factor: int = 3_037_000_500) -> SparseMatrix:
    return SparseMatrix(m.df.withColumn("val", F.col("val") * factor), m.rows(), m.cols(), WRAP64)


def as_complex(m: SparseMatrix) -> SparseMatrix:
    """Value modulo 5 and 3 as real and imaginary parts."""
    value = F.struct((F.col("val") % 5).cast("double").alias("re"), (F.col("val") % 3).cast("double").alias("im"))
    return SparseMatrix(m.df.withColumn("val", value), m.rows(), m.cols(), COMPLEX)


