"""Products by packs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmesh.functions.kinds import COMPLEX, DOUBLE, INT64, WRAP8, WRAP64
from rowmesh.errors import ShapeMismatch
from rowmesh.matrix import SparseMatrix, passing_products
from rowmesh.operators import algebra
from rowmesh.plans import packs, strips
from rowmesh.sources import generate

KINDS = [INT64, WRAP8, WRAP64, DOUBLE, COMPLEX]


def listed(df):
    return sorted(((r.row, r.col, tuple(r.val) if isinstance(r.val, tuple) else r.val) for r in df.collect()), key=str)


def small(monkeypatch, flops=300, pack=40):
    monkeypatch.setattr(strips, "STRIP_FLOPS", 100)
    monkeypatch.setattr(packs, "LEAST_FLOPS", 100)
    monkeypatch.setattr(packs, "TASK_FLOPS", flops)
    monkeypatch.setattr(packs, "PACK", pack)
    monkeypatch.setattr(packs, "BATCH", 7)
    monkeypatch.setattr(packs, "BAND", 60)


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: k.name)
@pytest.mark.parametrize("dense", [0, 100])
def test_packs_like_the_plain_product(spark, monkeypatch, kind, dense):
    small(monkeypatch)
    monkeypatch.setattr(packs, "DENSE", dense)
    a, b = generate.product_pair(spark, 40, 30, 50, 400, seed=3, kind=kind)
    planned = packs.plan(a.df, b.df, (40, 30, 50))
    assert planned.parts > 5 and not planned.cut
    want = listed(algebra.multiply(a.df, b.df, kind))
    assert listed(a.multiply(b).df) == want == listed(packs.multiply(a.df, b.df, kind, planned, (10, 33)))
    rows = {r.row: list(zip(r.indices, r.vals, strict=True)) for r in a.multiply_grouped(b).collect()}
    assert sorted(((i, j, tuple(v) if isinstance(v, tuple) else v) for i, found in rows.items() for j, v in found), key=str) == want
    assert all([j for j, _ in found] == sorted(j for j, _ in found) for found in rows.values())
    assert {r.row: r.nnz for r in a.fill_by_row(b).where("nnz > 0").collect()} == {i: len(found) for i, found in rows.items()}


def test_entries_are_shuffled_once_whatever_the_strips(spark, monkeypatch):
    """Records are as many with a strip as with dozens; each strip reads them."""
    a, b = generate.product_pair(spark, 60, 30, 50, 900, seed=4)
    written = []
    for flops in (10**6, 300):
        small(monkeypatch, flops)
        got = a.multiply(b).df
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan
        written.append(packs.plan(a.df, b.df, (60, 30, 50), 1).parts)
        assert listed(got) == listed(algebra.multiply(a.df, b.df, INT64))
    assert written[0] == 1 and written[1] > 20


@pytest.mark.parametrize("kind", [INT64, WRAP64, COMPLEX], ids=lambda k: k.name)
def test_a_row_that_outweighs_a_strip_is_cut(spark, monkeypatch, kind):
    small(monkeypatch, 100)
    of = lambda entries: SparseMatrix.of(spark, entries, 60, 60, kind)
    a = of([(0, k, k + 1) for k in range(60)] + [(i, i, 1) for i in range(1, 60)])
    b = of([(k, j, k - j) for k in range(60) for j in range(0, 60, 4)])
    assert packs.plan(a.df, b.df, (60, 60, 60)).cut
    assert listed(a.multiply(b).df) == listed(algebra.multiply(a.df, b.df, kind))
    assert a.fill_by_row(b).agg(F.sum("nnz")).first()[0] == a.multiply(b).nnz()


def test_hot_indexes_and_few_columns(spark, monkeypatch):
    """A dense product whose few inner indexes are all hot."""
    small(monkeypatch, 3000, 64)
    m = SparseMatrix.of(spark, [(i, k, i * k - 70) for i in range(150) for k in range(3)], 150, 3)
    assert listed(m.multiply(m.transpose(), salt=4).df) == listed(algebra.multiply(m.df, m.transpose().df, INT64))


@pytest.mark.parametrize("dense", [0, 100])
def test_integers_raise_on_overflow_and_only_then(spark, monkeypatch, dense):
    small(monkeypatch)
    monkeypatch.setattr(packs, "DENSE", dense)
    big = 3_000_000_000
    m = lambda v: SparseMatrix.of(spark, [(i, k, v if k else -v) for i in range(12) for k in range(4)], 12, 4)
    fits = m(1_500_000_000)
    assert set(v for *_, v in listed(fits.multiply(fits.transpose()).df)) == {4 * 1_500_000_000**2}
    for v in (big, 2_000_000_000):  # a product, or a sum, that is too large
        with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
            m(v).multiply(m(v).transpose()).df.collect()


def test_records_hold_what_they_are_given():
    for v in (np.array([0.1, 2.0]), np.array([0.5, np.nan]), np.array([1e300, 1.0]), np.array([-128, 127]), np.array([0, 2**40])):
        assert np.array_equal(packs._wide(packs._narrow(v), len(v), v.dtype.kind == "f").astype(v.dtype), v, equal_nan=True)
    assert len(packs._narrow(np.array([-128, 127]))) == 2 and len(packs._narrow(np.array([0.5, 2.0]))) == 8


def test_a_grid_writes_no_copies(spark):
    """Each side has one exchange by its strips; what places of the grid share is read again, not written again."""
    a, b = generate.product_pair(spark, 40, 30, 50, 400, seed=6)
    got = a.multiply_on_grid(b, (4, 5)).df
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode(sequence" not in plan
    assert listed(got) == listed(algebra.multiply(a.df, b.df, INT64))


def test_few_cells_are_summed_in_every_task_from_one_exchange(spark, monkeypatch):
    """A gram of long vectors: no entry is copied for the rows of the result, and both sides are one exchange."""
    monkeypatch.setattr(strips, "STRIP_FLOPS", 100)
    m = SparseMatrix(spark.range(6000).select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("c")).selectExpr("id AS row", "cast(c AS bigint) AS col", "cast(id % 7 + c AS double) AS val"), 6000, 2, DOUBLE)
    got = m.transpose().multiply(m)
    want = {(i, j): sum((k % 7 + i) * (k % 7 + j) for k in range(6000)) for i in range(2) for j in range(2)}
    assert {(i, j): v for i, j, v in got} == want
    assert not m.transpose()._strips(m)


def test_matrices_told_apart_by_one_job(spark):
    a, b = generate.product_pair(spark, 9, 8, 11, 60, seed=5, kind=DOUBLE)
    p = a @ b
    i, j, _ = p.nth(4)
    here = (F.col("row") == i) & (F.col("col") == j)
    off = lambda v: p.like(p.df.withColumn("val", F.when(here, v).otherwise(F.col("val"))))
    cases = {"as it is": p, "one off": off(F.col("val") + 1), "a NaN": off(F.lit(float("nan")))}
    assert passing_products(cases, a, b) == {name: m.passes_as_product_of(a, b) for name, m in cases.items()} == {"as it is": True, "one off": False, "a NaN": False}
    with pytest.raises(ShapeMismatch):
        passing_products({"": a}, a, b)
