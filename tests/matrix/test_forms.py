"""Products tested by vectors on both sides."""

import pytest
from pyspark.sql import functions as F

from rowmesh import queries
from rowmesh.functions.kinds import COMPLEX, INT64, WRAP8
from rowmesh.operators import algebra, verify
from rowmesh.plans import strips
from rowmesh.sources import generate, tables

SF = "/root/testdata/sf0.001"


def shuffled_records(spark):
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_cells_of_the_cases_are_not_shuffled(spark, monkeypatch):
    """With strips as narrow as on large tables: what is shuffled are entries, not cells or sums by column of each strip."""
    monkeypatch.setattr(strips, "STRIP_FLOPS", 2_000)
    monkeypatch.setattr(strips.plan, "__defaults__", (1, 2_000))
    m = tables.order_part(spark, SF)
    cells = (m @ m.transpose()).nnz()
    before = shuffled_records(spark)
    found = {r["what"]: r["equal"] for r in queries.QUERIES["vector_cases_whole"](spark, SF).collect()}
    after = shuffled_records(spark)
    assert found == {"as it is": True, "one more": False, "one gone": False, "rows and columns": True}
    assert sum(n for k, n in after.items() if k not in before) < cells / 2


def test_wrong_matrices_are_found(spark):
    a, b = generate.product_pair(spark, 30, 20, 30, 200, seed=5)
    good = a.multiply(b).df
    i, j = good.orderBy("row", "col").first()[:2]
    here = (F.col("row") == i) & (F.col("col") == j)
    bump = lambda n: F.col("val") + F.when(here, n).otherwise(0)
    moved = good.withColumn("col", F.when(here, 29 - F.col("col")).otherwise(F.col("col")))
    cases = {
        "good": good,
        "zeros": good.union(spark.createDataFrame([(29, 40, 0)], good.schema)),
        "more": good.withColumn("val", bump(1)),
        "gone": good.where(~here),
        "moved": moved,
        "by a modulus": good.withColumn("val", bump(verify.PRIMES[0])),
        "large": good.withColumn("val", bump(-(2**62))),
        "transposed": good.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"),
        "rows swapped": good.withColumn("row", F.when(F.col("row") == i, 29).when(F.col("row") == 29, i).otherwise(F.col("row"))),
    }
    cells = None
    for name, df in cases.items():
        named = df.select(F.lit(name).alias("name"), "row", "col", "val")
        cells = named if cells is None else cells.union(named)
    for seed in range(2):
        assert verify.passing_cells(cells, a.df, b.df, a.kind, seed) == {name: name in ("good", "zeros") for name in cases}


def test_empty_products(spark):
    a = generate.product_pair(spark, 5, 5, 5, 5, seed=1)[0]
    none = a.df.where("false")
    zero = spark.createDataFrame([("zero", 1, 2, 0), ("one", 1, 2, 1)], "name string, row bigint, col bigint, val bigint")
    assert verify.passing_cells(zero, a.df, none, a.kind) == {"zero": True, "one": False}
    assert verify.passing_cells(zero.where("false"), a.df, none, a.kind) == {}
    with pytest.raises(ValueError):
        verify.passing_cells(zero, a.df, none, WRAP8)


def test_records_of_strips_are_packed(spark):
    """16 bits of columns and values go apart from the rest, which hardly changes in a record; any 64-bit integer comes back."""
    cols, vals = [0, 65_535, 65_536, 2**40 + 7, 2**62], [-(2**63), 2**63 - 1, -1, 0, 65_536, -65_537, 49]
    entries = [(0, j, v) for j, v in zip(cols, vals, strict=False)] + [(1, j + 1, v) for j, v in zip(cols, reversed(vals), strict=False)]
    b = spark.createDataFrame(entries, "row bigint, col bigint, val bigint")
    a = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (2, 0, 1)], "row bigint, col bigint, val bigint")
    planned = strips.plan(a, b, 3, least=3)
    got = {tuple(r) for r in strips.multiply(a, b, INT64, planned).collect()}
    assert got == {(i, j, v) for i, k in ((0, 0), (1, 1), (2, 0)) for row, j, v in entries if row == k}
    record = strips._deal(a, b, planned).schema["rs"].dataType.elementType
    assert {f.name: f.dataType.simpleString() for f in record} == {"j_high": "array<bigint>", "j_low": "array<smallint>", "y_high": "array<bigint>", "y_low": "array<smallint>"}


@pytest.mark.parametrize("kind", [INT64, COMPLEX], ids=lambda k: k.name)
def test_strips_that_share_records(spark, kind):
    """The same cells, and every record of the right side goes once to so many strips."""
    a, b = generate.product_pair(spark, 40, 30, 50, 400, seed=6, kind=kind)
    planned = strips.plan(a.df, b.df, 40, strip=200)
    cells = lambda df: sorted((r.row, r.col, tuple(r.val) if kind is COMPLEX else r.val) for r in df.collect())
    assert planned.parts > 8 and cells(strips.multiply(a.df, b.df, kind, planned, waves=4)) == cells(algebra.multiply(a.df, b.df, kind))
    copies = [strips._deal(a.df, b.df, planned, waves).agg(F.sum(F.size("rs"))).first()[0] for waves in (1, 4)]
    assert copies[1] < copies[0] / 2


def test_cut_rows_by_strips_that_share_records(spark):
    a = spark.createDataFrame([(0, k, k + 1) for k in range(60)] + [(i, i, 1) for i in range(1, 60)], "row bigint, col bigint, val bigint")
    b = spark.createDataFrame([(k, j, k - j) for k in range(60) for j in range(0, 60, 4)], a.schema)
    planned = strips.plan(a, b, 60, strip=100)
    assert planned.cut
    assert sorted(strips.multiply(a, b, INT64, planned, waves=4).collect()) == sorted(algebra.multiply(a, b, INT64).collect())
