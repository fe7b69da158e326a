"""Matrices that are stored before they are read more than once."""

import pytest
from pyspark.sql import functions as F

from rowmesh import queries
from rowmesh.matrix import SparseMatrix
from rowmesh.operators import verify
from rowmesh.plans import deal, strips
from rowmesh.sources import generate, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("flag", [None, "R"])
def test_the_nations_are_joined_once(spark, flag):
    m = tables.nation_nation(spark, SF, flag)
    assert "lineitem" not in m.df._jdf.queryExecution().toString()
    assert m.nnz() == m.df.select("row", "col").distinct().count() > 0


def test_stubs_are_never_broadcast(spark):
    """However few degrees there are, their stubs are sorted and merged; only the starts of buckets are broadcast."""
    sides = [spark.createDataFrame([(i, 400_000 // n) for i in range(n)], "id bigint, degree bigint") for n in (100, 4)]
    m = generate.with_degrees(*sides, 100, 4, seed=1)
    sums = m.df.groupBy("col").agg({"val": "sum"})
    assert sorted(map(tuple, sums.collect())) == [(j, 100_000) for j in range(4)]
    plan = sums._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert [line for line in joins if "[place" in line and "SortMergeJoin" in line]
    assert not [line for line in joins if "[place" in line and "SortMergeJoin" not in line]
    assert not [line for line in joins if "[id" in line]


@pytest.mark.parametrize(("name", "method", "least"), [("spgemm_balanced", "multiply_balanced", 8), ("spgemm_on_grid", "multiply_on_grid", 9)])
def test_parts_grow_with_the_work(spark, monkeypatch, name, method, least):
    used, real = [], getattr(SparseMatrix, method)
    monkeypatch.setattr(SparseMatrix, method, lambda m, other, parts: used.append(parts) or real(m, other, parts))
    monkeypatch.setattr(strips, "STRIP_FLOPS", 1_000)
    m = tables.order_part(spark, SF)
    work = strips.flops(m.df, m.transpose().df)
    queries.QUERIES[name](spark, SF)
    parts = used[0] if isinstance(used[0], int) else used[0][0] * used[0][1]
    assert parts > least and work / parts <= 1_000


def test_items_of_work_are_ranked_once(spark):
    m = tables.order_part(spark, SF)
    assert "Window" not in deal.plan(m.df, m.transpose().df, 4).items._jdf.queryExecution().toString()


def test_several_candidates_pass_by_one_job(spark):
    m = tables.supplier_part(spark, SF)
    got = m @ m.transpose()
    off = got.df.withColumn("val", F.col("val") + F.when((F.col("row") == 0) & (F.col("col") == 0), 1).otherwise(0))
    assert verify.passing({"good": got.df, "off": off}, m.df, m.transpose().df, m.kind) == {"good": True, "off": False}
