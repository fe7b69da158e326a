"""Invariants, norms and the error bound of floating-point products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NanNormError
from ..functions.kinds import Kind


def entry_invariants(a: DataFrame, rows: int, cols: int, kind: Kind, canonical: bool) -> DataFrame:
    """One row of booleans: in_bounds, unique_cells, and no_zeros (true where zeros are allowed)."""
    cells = a.groupBy("row", "col").agg(F.count("*").alias("n"), F.count_if(kind.is_zero(F.col("val"))).alias("zeros"))
    inside = (F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols)
    return cells.agg(
        (F.count_if(~inside) == 0).alias("in_bounds"),
        (F.count_if(F.col("n") > 1) == 0).alias("unique_cells"),
        ((F.coalesce(F.sum("zeros"), F.lit(0)) == 0) | F.lit(not canonical)).alias("no_zeros"),
    )


def grouped_invariants(g: DataFrame, rows: int, cols: int, ordered: bool) -> DataFrame:
    """One row of booleans about a row-grouped form: same_lengths, cols_in_bounds, row_order, rows_in_bounds, unique_rows."""
    distinct = F.size("indices") == F.size(F.array_distinct("indices"))
    order = F.col("indices") == F.array_sort(F.array_distinct("indices")) if ordered else distinct
    per_row = g.groupBy("row").agg(
        F.count("*").alias("n"),
        F.bool_and(F.size("indices") == F.size("vals")).alias("a"),
        F.bool_and(F.forall("indices", lambda c: (c >= 0) & (c < cols))).alias("b"),
        F.bool_and(order).alias("c"),
    )
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return per_row.agg(
        every(F.col("a")).alias("same_lengths"),
        every(F.col("b")).alias("cols_in_bounds"),
        every(F.col("c")).alias("row_order"),
        every((F.col("row") >= 0) & (F.col("row") < rows)).alias("rows_in_bounds"),
        every(F.col("n") == 1).alias("unique_rows"),
    )


def offset_invariants(o: DataFrame, rows: int, nnz: int) -> DataFrame:
    """One row of booleans about offsets: complete, starts_at_zero, non_decreasing, ends_at_nnz."""
    step = o.withColumn("block", F.floor(F.col("i") / 65_536))
    before = F.lag("offset").over(Window.partitionBy("block").orderBy("i"))
    steps = step.withColumn("ok", F.coalesce(F.col("offset") >= before, F.lit(True)))
    blocks = steps.groupBy("block").agg(F.bool_and("ok").alias("ok"), F.min_by("offset", "i").alias("head"), F.max_by("offset", "i").alias("tail"), F.count("*").alias("n"))
    joint = F.coalesce(F.col("head") >= F.lag("tail").over(Window.orderBy("block")), F.lit(True))
    return blocks.withColumn("joint", joint).agg(
        (F.sum("n") == rows + 1).alias("complete"),
        (F.min_by("head", "block") == 0).alias("starts_at_zero"),
        F.bool_and(F.col("ok") & F.col("joint")).alias("non_decreasing"),
        (F.max_by("tail", "block") == nnz).alias("ends_at_nnz"),
    )


def inf_norm_table(a: DataFrame, kind: Kind) -> DataFrame:
    """(norm, nan): the largest row sum of magnitudes, 0 without entries, and whether a row sum is NaN."""
    sums = a.groupBy("row").agg(F.sum(kind.magnitude(F.col("val"))).alias("s"))
    bad = F.isnan("s") if kind.name in ("double", "complex") else F.lit(False)
    return sums.agg(F.coalesce(F.max(F.when(~bad, F.col("s"))), F.lit(0).cast("double" if kind.name in ("double", "complex") else "bigint")).alias("norm"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("nan"))


def inf_norm(a: DataFrame, kind: Kind):
    got = inf_norm_table(a, kind).first()
    if got["nan"]:
        raise NanNormError
    return got["norm"]


def difference_norm(x: DataFrame, y: DataFrame, kind: Kind) -> DataFrame:
    """(norm, nan, nan_x, nan_y): the infinity norm of x - y and whether a row sum of it is NaN, and whether x and y hold
    NaN. Each side is read once."""
    left = x.select("row", "col", F.col("val").alias("x"), F.lit(None).cast(kind.type).alias("y"))
    right = y.select("row", "col", F.lit(None).cast(kind.type).alias("x"), F.col("val").alias("y"))
    cells = left.union(right).groupBy("row", "col").agg(*(F.max(c).alias(c) for c in ("x", "y")))
    cells = cells.select("row", *(kind.work(F.coalesce(c, kind.lit(0))).alias(c) for c in ("x", "y")))
    apart = kind.magnitude(kind.settle(kind.minus(F.col("x"), F.col("y"))))
    rows = cells.groupBy("row").agg(F.sum(apart).alias("s"), F.bool_or(kind.is_nan(F.col("x"))).alias("nan_x"), F.bool_or(kind.is_nan(F.col("y"))).alias("nan_y"))
    bad = F.isnan("s") if kind.name in ("double", "complex") else F.lit(False)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.agg(F.coalesce(F.max(F.when(~bad, F.col("s"))), F.lit(0)).alias("norm"), some(bad).alias("nan"), some(F.col("nan_x")).alias("nan_x"), some(F.col("nan_y")).alias("nan_y"))


def error_bound(n: int, lhs_norm: float, rhs_norm: float) -> float:
    """Twice gamma_n times the norms, with gamma_n = n u / (1 - n u) and u half the machine epsilon."""
    u = 2.0**-53
    return 0.0 if lhs_norm == 0 or rhs_norm == 0 else 2 * (n * u / (1 - n * u)) * lhs_norm * rhs_norm


def dump_lines(a: DataFrame) -> DataFrame:
    """(row, line) of the rows that have entries: ``(i, j, 1e0), ...`` in the order of columns."""
    from ..functions.scalar import scientific

    shown = a.select("row", "col", F.concat(F.lit("("), F.col("row"), F.lit(", "), F.col("col"), F.lit(", "), scientific(F.col("val")), F.lit(")")).alias("s"))
    lists = shown.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "s"))).alias("e"))
    return lists.select("row", F.array_join(F.transform("e", lambda e: e["s"]), ", ").alias("line"))


def scientific_dump(a: DataFrame) -> DataFrame:
    """One string ``{(i, j, 1e0), ...}`` in (row, col) order; for small matrices, as it is one cell. ``dump_lines`` has no
    such bound."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda e: e["line"])
    return dump_lines(a).agg(F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}")).alias("dump"))
