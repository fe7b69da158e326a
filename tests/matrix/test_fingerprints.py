"""Fingerprints and random matrices with given degrees."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowmesh import errors
from rowmesh.functions.kinds import COMPLEX, DOUBLE, INT64, WRAP8, WRAP64
from rowmesh.matrix import SparseMatrix
from rowmesh.operators import algebra, fingerprint
from rowmesh.plans import work
from rowmesh.sources import generate, storage

KINDS = [INT64, WRAP8, WRAP64, DOUBLE, COMPLEX]


@pytest.mark.parametrize("kind", KINDS)
def test_order_partitions_and_zeros_do_not_count(spark, kind):
    m = generate.random_matrix(spark, 30, 20, 300, seed=4, kind=kind, drop_zeros=False)
    print_ = m.fingerprint()
    assert print_ == fingerprint.of(m.df.repartition(7).sortWithinPartitions(F.desc("col")), kind) == m.canonical().fingerprint() == m.transpose().transpose().fingerprint()
    assert print_.elements == m.canonical().nnz() and m.matches(m.canonical()) and m.canonical().matches(m)
    assert not m.matches(m.like(m.df, 31)) and not m.matches(m + m)


@pytest.mark.parametrize("kind", KINDS)
def test_writes_and_unions_are_sums(spark, kind):
    m = generate.random_matrix(spark, 8, 9, 40, seed=5, kind=kind)
    i, j, _ = m.nth(3)
    cell = (F.col("row") == i) & (F.col("col") == j)
    written, _ = m.set(i, j, 3)
    old, new = fingerprint.of(m.df.where(cell), kind), fingerprint.of(written.df.where(cell), kind)
    assert written.fingerprint() == m.fingerprint() - old + new
    assert fingerprint.of(m.df.where("row < 4"), kind) + fingerprint.of(m.df.where("row >= 4"), kind) == m.fingerprint()


def test_every_single_change_shows(spark):
    rng = random.Random(2)
    cells = {(rng.randrange(20), rng.randrange(20)): rng.randrange(1, 5) for _ in range(60)}
    prints = {SparseMatrix.of(spark, [(*k, v) for k, v in cells.items()], 20, 20).fingerprint()}
    for k in list(cells)[:8]:
        prints.add(SparseMatrix.of(spark, [(*c, v + (c == k)) for c, v in cells.items()], 20, 20).fingerprint())
    moved = [(j, i, v) for (i, j), v in cells.items()]
    prints.add(SparseMatrix.of(spark, moved, 20, 20).fingerprint())
    assert len(prints) == 10


def test_signed_zeros_nan_and_empty(spark):
    of = lambda entries, kind: SparseMatrix.of(spark, entries, 3, 3, kind)
    assert of([(0, 0, -0.0), (1, 1, 2.0)], DOUBLE).matches(of([(1, 1, 2.0)], DOUBLE))
    assert of([(0, 0, complex(1, -0.0))], COMPLEX).matches(of([(0, 0, 1 + 0j)], COMPLEX))
    nan = of([(0, 0, float("nan"))], DOUBLE)
    assert nan.fingerprint().nans == 1 and not nan.matches(nan)
    empty = SparseMatrix.empty(spark, 3)
    assert empty.fingerprint() == fingerprint.Fingerprint(0, 0, 0) and empty.matches(of([(0, 0, 0)], INT64))
    assert of([(0, 0, 5)], WRAP8).matches(of([(0, 0, 5)], INT64))


def test_different_fingerprints_need_no_join(spark, tmp_path, monkeypatch):
    m = generate.random_matrix(spark, 30, 20, 300, seed=6)
    other, _ = m.set(1, 1, 99)
    for name, side in (("m", m), ("again", m), ("other", other)):
        storage.save(side, f"{tmp_path}/{name}", with_fingerprint=True)
    m, again, other = (storage.load(spark, f"{tmp_path}/{n}") for n in ("m", "again", "other"))
    assert m.matches(again)
    monkeypatch.setattr(algebra, "differences", lambda *a: pytest.fail("a join"))
    monkeypatch.setattr(fingerprint, "of", lambda *a: pytest.fail("a scan"))
    assert not m.matches(other)


def test_equal_fingerprints_are_compared_exactly(spark):
    a, b = (SparseMatrix.of(spark, [(0, 0, v)], 2, 2) for v in (1, 2))
    a._fingerprint = b._fingerprint = fingerprint.Fingerprint(1, 1, 0)
    assert not a.matches(b)


def degrees(spark, numbers):
    return spark.createDataFrame(list(numbers.items()), "id bigint, degree bigint")


def test_degrees_are_met_on_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(generate, "BLOCK", 16)  # several buckets and pieces
    rows, cols = {0: 200, 3: 1, 5: 0, 7: 99}, {1: 150, 2: 148, 9: 2}
    m = generate.with_degrees(degrees(spark, rows), degrees(spark, cols), 8, 10, seed=1)
    cells = {(i, j): v for i, j, v in m}
    found = [Counter(), Counter()]
    for cell, v in cells.items():
        for side, k in zip(found, cell, strict=True):
            side[k] += v
    assert found[0] == {k: v for k, v in rows.items() if v} and found[1] == cols
    again = generate.with_degrees(degrees(spark, rows).repartition(5), degrees(spark, cols).coalesce(1), 8, 10, seed=1)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert {(i, j): v for i, j, v in again} == cells
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(i, j): v for i, j, v in generate.with_degrees(degrees(spark, rows), degrees(spark, cols), 8, 10, seed=2)} != cells


def test_stubs_meet_at_random(spark):
    """200 rows and 200 columns of 10 stubs: cells are near to a Poisson distribution with mean 10 * 10 / 2000."""
    even = {k: 10 for k in range(200)}
    m = generate.with_degrees(degrees(spark, even), degrees(spark, even), 200, 200, seed=3)
    assert 1900 < m.nnz() < 1990  # 40,000 * (1 - exp(-0.05)) = 1951, standard deviation 7


def test_a_hot_column_makes_salt_act(spark):
    rows, cols = {k: 30 for k in range(300)}, {0: 3000} | {k: 12 for k in range(1, 501)}
    m = generate.with_degrees(degrees(spark, rows), degrees(spark, cols), 300, 501)
    measured = work.estimate(m.df, m.transpose().df)
    assert measured.hot == (0,) and measured.salt > 1
    assert m.multiply(m.transpose(), salt="auto").same_structure(m @ m.transpose())


def test_degrees_that_make_no_matrix(spark):
    good = degrees(spark, {0: 2, 1: 1})
    for bad in ({0: 2}, {0: 2, 1: 2}):
        with pytest.raises(errors.MatrixError, match="sum to"):
            generate.with_degrees(good, degrees(spark, bad), 2, 2)
    for bad in ({2: 3}, {0: 4, 1: -1}, {-1: 3}, {0: 3, 1: None}):
        with pytest.raises(errors.MatrixIndexError):
            generate.with_degrees(good, degrees(spark, bad), 2, 2)
    with pytest.raises(errors.MatrixError, match="two degrees"):
        generate.with_degrees(good, degrees(spark, {0: 2}).union(degrees(spark, {0: 1})), 2, 2)
    assert generate.with_degrees(degrees(spark, {}), degrees(spark, {}), 2, 2).nnz() == 0
