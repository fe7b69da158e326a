"""Products by strips of rows."""

import pytest
from pyspark.sql import functions as F

from rowmesh.functions.kinds import COMPLEX, INT64, WRAP8, WRAP64
from rowmesh.matrix import SparseMatrix
from rowmesh.operators import algebra
from rowmesh.plans import strips
from rowmesh.sources import generate


def listed(df):
    return sorted(((r.row, r.col, tuple(r.val) if isinstance(r.val, tuple) else r.val) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", [INT64, WRAP8, WRAP64, COMPLEX], ids=lambda k: k.name)
def test_strips_like_the_plain_product(spark, monkeypatch, kind):
    monkeypatch.setattr(strips, "RECORD", 3)
    a, b = generate.product_pair(spark, 40, 30, 50, 400, seed=3, kind=kind)
    planned = strips.plan(a.df, b.df, 40, strip=200)
    assert planned.parts > 5 and not planned.cut
    assert listed(strips.multiply(a.df, b.df, kind, planned)) == listed(algebra.multiply(a.df, b.df, kind))


def test_a_row_that_outweighs_a_strip_is_cut(spark):
    a = SparseMatrix.of(spark, [(0, k, k + 1) for k in range(60)] + [(i, i, 1) for i in range(1, 60)], 60, 60)
    b = SparseMatrix.of(spark, [(k, j, k - j) for k in range(60) for j in range(0, 60, 4)], 60, 60)
    planned = strips.plan(a.df, b.df, 60, strip=100)
    assert planned.cut
    assert listed(strips.multiply(a.df, b.df, INT64, planned)) == listed(algebra.multiply(a.df, b.df, INT64))
    assert strips.fill(a.df, b.df, planned).agg(F.sum("nnz")).first()[0] == (a @ b).nnz()


def test_no_scalar_product_is_shuffled(spark, monkeypatch):
    """Cells are summed on the partitions that their strips were dealt to."""
    monkeypatch.setattr(strips, "STRIP_FLOPS", 200)
    a, b = generate.product_pair(spark, 40, 30, 50, 400, seed=4)
    for df in (a.multiply(b).df, a.multiply_grouped(b)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan.split("Generate posexplode")[0].lower()
    rows = {r.row: list(zip(r.indices, r.vals, strict=True)) for r in a.multiply_grouped(b).collect()}
    assert sorted(((i, j, v) for i, found in rows.items() for j, v in found), key=str) == listed(algebra.multiply(a.df, b.df, INT64))
    assert all(found == sorted(found) for found in rows.values())
    assert a.multiply(b, salt=3).equals(a.like(algebra.multiply(a.df, b.df, INT64), 40, 50))
    assert a.fill_by_row(b).agg(F.sum("nnz")).first()[0] == len(listed(algebra.multiply(a.df, b.df, INT64)))
