"""Random matrices against NumPy and plain dictionaries, many in one job through a case number."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmesh import errors
from rowmesh.functions import scalar as S
from rowmesh.functions.kinds import COMPLEX, DOUBLE, INT64, WRAP8, WRAP64
from rowmesh.functions.scans import prefix_sums
from rowmesh.matrix import SparseMatrix, chain_product
from rowmesh.operators import access, algebra, checks
from rowmesh.plans import work
from rowmesh.sources import generate


def dense(m):
    out = np.zeros(m.shape, complex if m.kind is COMPLEX else object if m.kind is not DOUBLE else float)
    for i, j, v in m:
        out[i, j] = complex(v["re"], v["im"]) if m.kind is COMPLEX else v
    return out


def wrapped(x, bits):
    return (x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


@pytest.mark.parametrize("kind", [INT64, WRAP8, WRAP64, DOUBLE, COMPLEX])
def test_operators_against_dense(spark, kind):
    a, b = generate.product_pair(spark, 7, 5, 9, 40, seed=1, kind=kind)
    c = generate.random_matrix(spark, 7, 5, 30, seed=9, kind=kind)
    x, y, z = dense(a), dense(b), dense(c)
    ring = {"wrap8": lambda v: wrapped(v, 8), "wrap64": lambda v: wrapped(v, 64)}.get(kind.name, lambda v: v)
    fix = np.vectorize(ring, otypes=[x.dtype])
    for got, want in [(a @ b, fix(x.dot(y))), (a.multiply(b, salt=3), fix(x.dot(y))), (a.multiply(b, ordered=True), fix(x.dot(y))), (a.multiply(b, salt="auto"), fix(x.dot(y))), (a.multiply(b, broadcast_entries=1000), fix(x.dot(y))), (a.multiply(b, broadcast_entries=1), fix(x.dot(y))), (a + c, fix(x + z)), (a - c, fix(x - z)), (a.transpose(), x.T), (a * b, fix(x.dot(y)))]:
        assert got.shape == want.shape and np.array_equal(dense(got), want)
        assert all(got.invariants().values())
    assert (SparseMatrix.identity(spark, 7, kind) @ a).equals(a) and a.transpose().transpose().same_structure(a)
    assert a.equals(a) and not a.equals(c) and not a.equals(a.transpose())
    assert (a - a).equals(SparseMatrix.empty(spark, 7, 5, kind)) and (a - a).nnz() == a.nnz() and (a - a).canonical().nnz() == 0


def test_many_small_pairs_in_one_job(spark):
    """A case number in the row keeps the cases apart: rows of case k start at 16 k."""
    rng = random.Random(4)
    cases = []
    for k in range(60):
        n, m, p = (rng.randint(1, 6) for _ in range(3))
        a = {(rng.randrange(n), rng.randrange(m)): rng.randint(-9, 9) for _ in range(rng.randint(0, 2 * n * m))}
        b = {(rng.randrange(m), rng.randrange(p)): rng.randint(-9, 9) for _ in range(rng.randint(0, 2 * m * p))}
        cases.append((k, a, b))
    left = SparseMatrix.of(spark, [(16 * k + i, 16 * k + j, v) for k, a, _ in cases for (i, j), v in a.items()], 960, 960)
    right = SparseMatrix.of(spark, [(16 * k + i, 16 * k + j, v) for k, _, b in cases for (i, j), v in b.items()], 960, 960)
    want, union = {}, {}
    for k, a, b in cases:
        for (i, j), v in a.items():
            for (r, c), w in b.items():
                if j == r:
                    want[16 * k + i, 16 * k + c] = want.get((16 * k + i, 16 * k + c), 0) + v * w
        for cell in a.keys() | b.keys():
            union[16 * k + cell[0], 16 * k + cell[1]] = a.get(cell, 0) - b.get(cell, 0)
    assert {(i, j): v for i, j, v in left @ right} == want and 0 in want.values()
    assert {(i, j): v for i, j, v in left - right} == union and 0 in union.values()


def test_shapes_and_errors(spark):
    a, b = SparseMatrix.empty(spark, 2, 3), SparseMatrix.empty(spark, 3, 2)
    for bad, error, text in [
        (lambda: a + b, errors.ShapeMismatch, "matrices must have identical dimensions"),
        (lambda: a - b, errors.ShapeMismatch, "matrices must have identical dimensions"),
        (lambda: a.combine(b, F.greatest), errors.ShapeMismatch, "matrices must have identical dimensions"),
        (lambda: a @ a, errors.ProductMismatch, "LHS cols() != RHS rows()"),
        (lambda: a.get(2, 0), errors.MatrixIndexError, "values are not in bounds"),
        (lambda: a.get(0, -1), errors.MatrixIndexError, "values are not in bounds"),
        (lambda: a.set(0, 3, 1), errors.MatrixIndexError, "values are not in bounds"),
        (lambda: SparseMatrix.identity(spark, 0), errors.DimensionError, "number of dimensions must be greater than zero"),
        (lambda: SparseMatrix.empty(spark, 0, 1), errors.DimensionError, "number of dimensions must be greater than zero"),
        (lambda: SparseMatrix.of(spark, [(2, 0, 1)], 2, 3), errors.MatrixIndexError, "values are not in bounds"),
        (lambda: a.set_many(spark.createDataFrame([(0, 5, 1)], "row bigint, col bigint, val bigint")), errors.MatrixIndexError, "values are not in bounds"),
        (lambda: a.nth(0), errors.MatrixIndexError, "values are not in bounds"),
    ]:
        with pytest.raises(error, match=text.replace("(", r"\(").replace(")", r"\)")):
            bad()
        assert issubclass(error, errors.MatrixError)
    assert (a.rows(), a.cols(), a.nnz(), a.shape) == (2, 3, 0, (2, 3)) and SparseMatrix.empty(spark, 4).shape == (4, 4)


def test_equality_operators(spark):
    a = generate.random_matrix(spark, 5, 6, 20, seed=2, drop_zeros=False)
    b, c = a.set(4, 4, 99)[0], SparseMatrix.empty(spark, 5, 7)
    assert a == a.canonical() and not a != a.canonical() and a != b and not a == b and a != c
    assert a != "a matrix" and not a == 5 and (a == b) is False
    with pytest.raises(TypeError):
        hash(a)


def test_only_hot_indexes_are_salted(spark):
    """One inner index holds nearly all products; no other entry of the right side is copied."""
    a = SparseMatrix.of(spark, [(i, 7, i + 1) for i in range(300)] + [(i, i % 7, 1) for i in range(300)], 300, 10)
    b = SparseMatrix.of(spark, [(7, j, j + 1) for j in range(40)] + [(k, k, 2) for k in range(7)], 10, 40)
    found = work.estimate(a.df, b.df)
    assert found.hot == (7,) and found.salt == min(work.MOST_SALT, round(12_000 / 12_300 / work.HOT_SHARE))
    pairs = algebra._pairs(a.df, b.df, 8, found.hot, False)
    assert pairs.count() == 300 * 40 + 300 and a.multiply(b, salt=8).equals(a @ b) and a.multiply(b, salt="auto").equals(a @ b)
    even = SparseMatrix.identity(spark, 100)
    assert work.estimate(even.df, even.df) == work.Estimate(100, 1, 1)


def test_ordered_sums_run_block_by_block(spark):
    """Sums over blocks of neighbouring inner indexes, then over the blocks, to the last bit and however the data lie."""
    rng = random.Random(12)
    n = 3 * algebra.ORDER_BLOCK + 5
    x, y = [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(n)], [rng.gauss(0, 1) for _ in range(n)]
    a, b = SparseMatrix.of(spark, [(0, k, v) for k, v in enumerate(x)], 1, n, DOUBLE), SparseMatrix.of(spark, [(k, 0, v) for k, v in enumerate(y)], n, 1, DOUBLE)
    blocks = [0.0] * 4
    for k in range(n):
        blocks[k // algebra.ORDER_BLOCK] += x[k] * y[k]
    want = 0.0
    for s in blocks:
        want += s
    for parts in (1, 5):
        shuffled = a.like(a.df.repartition(parts, F.rand(parts)))
        assert shuffled.multiply(b, ordered=True).get(0, 0) == want


@pytest.mark.parametrize("kind", [DOUBLE, COMPLEX], ids=lambda k: k.name)
def test_ordered_products_shuffle_no_scalar_products(spark, monkeypatch, kind):
    """Blocks are summed in pieces where their entries meet; the sums are those of a loop over ascending inner indexes."""
    a, b = generate.product_pair(spark, 20, 2 * algebra.ORDER_BLOCK + 30, 15, 900, seed=6, kind=kind)
    left, right = [{(r.row, r.col): complex(*r.val) if kind is COMPLEX else r.val for r in m.df.collect()} for m in (a, b)]
    blocks = {}
    for (i, k), x in sorted(left.items(), key=lambda e: e[0][1]):
        for j in range(15):
            if (k, j) in right:
                y, cell = right[k, j], (i, j, k // algebra.ORDER_BLOCK)
                p = complex(x.real * y.real - x.imag * y.imag, x.real * y.imag + x.imag * y.real) if kind is COMPLEX else x * y
                blocks[cell] = blocks[cell] + p if cell in blocks else p
    want = {}
    for (i, j, _), p in sorted(blocks.items(), key=lambda e: e[0]):
        want[i, j] = want[i, j] + p if (i, j) in want else p
    for piece in (2_000_000, 50):
        monkeypatch.setattr(algebra, "PIECE", piece)
        got = a.multiply(b, ordered=True)
        assert {(r.row, r.col): complex(*r.val) if kind is COMPLEX else r.val for r in got.df.collect()} == want
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_steps_and_comparison_of_positions(spark):
    m = generate.random_matrix(spark, 12, 9, 40, seed=8)
    entries = [(i, j) for i, j, _ in m]
    steps = {(r.row, r.col): (r.next_row, r.next_col) for r in access.steps(m.df).collect()}
    assert steps == dict(zip(entries, [*entries[1:], (None, None)], strict=True))
    pairs = spark.createDataFrame([(*p, *q) for p in entries[:9] for q in entries[:9]], "a long, b long, c long, d long")
    for r in pairs.select("*", access.compare_positions("a", "b", "c", "d").alias("o")).collect():
        assert r.o == ((r.a, r.b) > (r.c, r.d)) - ((r.a, r.b) < (r.c, r.d))


def test_get_and_set(spark):
    m = SparseMatrix.of(spark, [(0, 1, 5), (2, 2, 0)], 3, 3)
    assert (m.get(0, 1), m.get(2, 2), m.get(1, 1), m.value(1, 1)) == (5, 0, None, 0)
    n, before = m.set(0, 1, 7)
    assert before == 5 and list(n) == [(0, 1, 7), (2, 2, 0)] and list(m) == [(0, 1, 5), (2, 2, 0)]
    n, before = m.set(1, 0, 4)
    assert before is None and list(n) == [(0, 1, 5), (1, 0, 4), (2, 2, 0)]
    assert list(m.set(0, 1, 0)[0]) == [(0, 1, 0), (2, 2, 0)] and list(m.set(0, 1, 0, drop_zeros=True)[0]) == [(2, 2, 0)]
    new = spark.createDataFrame([(0, 1, 0), (1, 1, 3)], "row bigint, col bigint, val bigint")
    assert list(m.set_many(new)) == [(0, 1, 0), (1, 1, 3), (2, 2, 0)] and list(m.set_many(new, drop_zeros=True)) == [(1, 1, 3), (2, 2, 0)]


def test_order_and_forms(spark):
    m = generate.random_matrix(spark, 9, 6, 40, seed=3, drop_zeros=False)
    entries = list(m)
    assert entries == sorted(entries) and list(reversed(m)) == entries[::-1]
    assert [tuple(r)[:3] for r in m.ranked().orderBy("pos").collect()] == entries and m.nth(4) == entries[4] and m.nth(-1) == entries[-1]
    g = m.grouped()
    assert {r.row: list(zip(r.indices, r.vals, strict=True)) for r in g.collect()} == {i: [(c, v) for r, c, v in entries if r == i] for i in {e[0] for e in entries}}
    assert SparseMatrix.from_grouped(m.grouped(ordered=False), 9, 6).same_structure(m)
    offsets = [r.offset for r in m.offsets().orderBy("i").collect()]
    assert offsets == [sum(e[0] < i for e in entries) for i in range(10)]
    assert all(checks.grouped_invariants(g, 9, 6, True).first()) and all(checks.offset_invariants(m.offsets(), 9, len(entries)).first())
    bad = spark.createDataFrame([(0, [2, 1], [1, 1]), (0, [7], [1, 2]), (9, [1, 1], [1, 1])], "row bigint, indices array<bigint>, vals array<bigint>")
    assert not any(checks.grouped_invariants(bad, 9, 6, True).first())
    shuffled = spark.createDataFrame([(0, [2, 1], [1, 1])], bad.schema)
    assert list(checks.grouped_invariants(shuffled, 9, 6, False).first()) == [True] * 5
    broken = spark.createDataFrame([(0, 1), (1, 0), (2, 5)], "i bigint, offset bigint")
    assert not any(checks.offset_invariants(broken, 3, 4).first())
    twice = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (9, 0, 1)], "row bigint, col bigint, val bigint")
    assert not any(checks.entry_invariants(twice, 9, 6, INT64, True).first())


def test_prefix_sums_cross_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    got = [r.s for r in prefix_sums(df, "i", F.col("v"), "s", block=64).orderBy("i").collect()]
    assert got == list(np.cumsum([i % 7 for i in range(1000)]))


def test_explicit_zeros_and_overflow(spark):
    a = SparseMatrix.of(spark, [(0, 0, 1), (0, 1, 1)], 1, 2)
    b = SparseMatrix.of(spark, [(0, 0, 1), (1, 0, -1)], 2, 1)
    assert list(a @ b) == [(0, 0, 0)] and list((a @ b).canonical()) == []
    assert list(a + SparseMatrix.of(spark, [(0, 0, -1)], 1, 2)) == [(0, 0, 0), (0, 1, 1)]
    assert (a @ b).equals(SparseMatrix.empty(spark, 1, 1)) and not (a @ b).same_structure(SparseMatrix.empty(spark, 1, 1))
    big = [(0, 0, 2**62), (0, 1, 2**62)]
    ones = [(0, 0, 1), (1, 0, 1)]
    with pytest.raises(Exception, match="OVERFLOW"):
        list(SparseMatrix.of(spark, big, 1, 2) @ SparseMatrix.of(spark, ones, 2, 1))
    assert list(SparseMatrix.of(spark, big, 1, 2, WRAP64) @ SparseMatrix.of(spark, ones, 2, 1, WRAP64)) == [(0, 0, -(2**63))]
    low = SparseMatrix.of(spark, [(0, 0, -128)], 1, 1, WRAP8)
    assert list(SparseMatrix.empty(spark, 1, 1, WRAP8) - low) == [(0, 0, -128)] and list(low @ low) == [(0, 0, 0)]


def test_work_analysis(spark):
    a, b = generate.product_pair(spark, 12, 8, 10, 60, seed=5)
    x, y = list(a), list(b)
    flops = [sum(1 for i, k, _ in x if i == r for q, _, _ in y if q == k) for r in range(12)]
    fill = [len({j for i, k, _ in x if i == r for q, j, _ in y if q == k}) for r in range(12)]
    assert [r.flops for r in a.flops_by_row(b).orderBy("row").collect()] == flops
    assert [r.nnz for r in a.fill_by_row(b).orderBy("row").collect()] == fill
    assert work.largest_row(a.df, b.df, 12).first()[0] == max(fill)
    scan = [0, *np.cumsum(flops).tolist()]
    for workers in (1, 2, 4, 30):
        average = -(-scan[-1] // workers)
        want = [0] + [sum(s <= average * i for s in scan) - 1 for i in range(1, workers)] + [12]
        assert [r.first_row for r in a.row_ranges(b, workers).orderBy("part").collect()] == want
    got = work.estimate(a.df, b.df)
    assert got.products == sum(flops) and got.salt > 1
    assert work.estimate(a.df.where("false"), b.df) == work.Estimate(0, 0, 1)


def test_by_rows_only_where_it_fits(spark):
    a = generate.random_matrix(spark, 100, 40, 900, seed=1)
    b = generate.random_matrix(spark, 40, 30, 200, seed=2)
    assert work.fits_by_rows(a.df, b.df, 200) and not work.fits_by_rows(a.df, b.df, b.nnz() - 1)
    assert not work.fits_by_rows(a.df.where("row < 3"), b.df, 200) and work.fits_by_rows(a.df.where("false"), b.df, 200)
    assert np.array_equal(dense(a.multiply(b, broadcast_entries=200)), dense(a).dot(dense(b)))
    plan = algebra.multiply(a.df, b.df, INT64, by_rows=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(i" not in plan


def test_chain(spark):
    assert work.chain_order([(10, 1000), (1000, 10), (10, 1000)], [5000, 5000, 5000]) == [(0, 1), (0, 2)]
    assert work.chain_order([(1000, 10), (10, 1000), (1000, 2)], [5000, 5000, 1000]) == [(1, 2), (0, 1)]
    parts = [generate.random_matrix(spark, r, c, 20, seed=s) for s, (r, c) in enumerate([(4, 6), (6, 3), (3, 5)])]
    assert np.array_equal(dense(chain_product(parts)), dense(parts[0]).dot(dense(parts[1])).dot(dense(parts[2])))


def test_norm_and_error_bound(spark):
    a, b = generate.product_pair(spark, 6, 6, 6, 30, seed=8, kind=DOUBLE)
    assert a.inf_norm() == np.abs(dense(a)).sum(1).max() and SparseMatrix.empty(spark, 2, 2, DOUBLE).inf_norm() == 0
    for n in ("cols", "inner"):
        assert (a @ b).is_good_product_of(a, b, n) and not (a @ b).set(0, 0, 1e6)[0].is_good_product_of(a, b, n)
    nan = SparseMatrix.of(spark, [(0, 0, math.nan)], 6, 6, DOUBLE)
    assert not nan.is_good_product_of(a, b) and not nan.equals(nan)
    with pytest.raises(errors.NanNormError):
        nan.inf_norm()
    zero = SparseMatrix.empty(spark, 6, 6, DOUBLE)
    assert zero.is_good_product_of(zero, b)
    assert SparseMatrix.of(spark, [(1, 0, -0.00012), (0, 1, 12345.678), (0, 0, 0.0)], 2, 2, DOUBLE).dump() == "{(0, 0, 0e0), (0, 1, 1.2345678e4), (1, 0, -1.2e-4)}"


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    from rowmesh.sources import storage

    m = generate.random_matrix(spark, 50, 50, 400, seed=2)
    storage.save(m, str(tmp_path / "m"))
    back = storage.load(spark, str(tmp_path / "m"))
    assert back.same_structure(m) and back.kind is INT64
    plan = access.element((back @ back).df, 3, 7)._jdf.queryExecution().toString()
    assert "EqualTo(row,3)" in plan and "EqualTo(col,7)" in plan


def test_canonical_product_has_one_shuffle_by_cell(spark):
    a = spark.range(10).select(F.col("id").alias("row"), F.col("id").alias("col"), F.col("id").alias("val"))
    plan = algebra.multiply(a, a, INT64)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_scalars(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.5, -2.5, 2.5, 3.7, 1e300, -1e300, 5e-324, 1e-310, math.inf, -math.inf, math.nan, 12345678.0]
    df = spark.createDataFrame([(i, v, w) for i, v in enumerate(values) for w in (0.0, -3.0, math.nan)] + [(99, None, None)], "i int, x double, y double")

    def got(c):
        return {(r.i, repr(r.y)): r.c for r in df.select("i", "y", c.alias("c")).collect()}

    def check(c, want):
        for (i, y), v in got(c).items():
            w = None if i == 99 else want(values[i], float(y))
            assert v == w or (v is not None and w is not None and v != v and w != w), (i, y, v, w)

    sign = lambda x: math.copysign(1.0, x)
    check(S.divide("x", "y"), lambda x, y: x / y if y else math.nan if x == 0 or x != x else math.copysign(math.inf, sign(x) * sign(y)))
    check(S.remainder("x", "y"), lambda x, y: math.fmod(x, y) if y and math.isfinite(x) else math.nan)
    check(S.signum("x"), lambda x, y: x if x != x else sign(x))
    check(S.is_sign_negative("x"), lambda x, y: x == x and sign(x) < 0)
    check(S.floor("x"), lambda x, y: float(math.floor(x)) if math.isfinite(x) else x)
    check(S.ceil("x"), lambda x, y: float(math.ceil(x)) if math.isfinite(x) else x)
    check(S.trunc("x"), lambda x, y: float(math.trunc(x)) if math.isfinite(x) else x)
    check(S.rounded("x"), lambda x, y: math.copysign(math.floor(abs(x) + 0.5), x) if math.isfinite(x) else x)
    check(S.ln("x"), lambda x, y: math.nan if x < 0 or x != x else -math.inf if x == 0 else math.log(x) if math.isfinite(x) else x)
    check(S.maximum("x", "y"), lambda x, y: y if x != x else x if y != y else max(x, y))
    check(S.minimum("x", "y"), lambda x, y: y if x != x else x if y != y else min(x, y))
    check(S.compare("x", "y"), lambda x, y: None if x != x or y != y else (x > y) - (x < y))
    check(S.classify("x"), lambda x, y: "nan" if x != x else "infinite" if math.isinf(x) else "zero" if x == 0 else "normal" if abs(x) >= 2.3e-308 else "subnormal")
    check(S.to_i64("x"), lambda x, y: int(x) if math.isfinite(x) and abs(x) < 2**63 else None)
    check(S.to_u64("x"), lambda x, y: int(x) if math.isfinite(x) and -1 < x < 2**64 else None)
    decoded = got(S.integer_decode("x"))
    for i, v in enumerate(values):
        if math.isfinite(v):
            m = decoded[i, "0.0"]
            assert m["sign"] * int(m["mantissa"]) * Fraction(2) ** m["exponent"] == Fraction(v)
    shown = got(S.scientific("x"))
    assert [shown[i, "0.0"] for i in (0, 1, 4, 5, 8, 10, 12, 14, 15)] == ["0e0", "-0e0", "5e-1", "-2.5e0", "1e300", "5e-324", "inf", "NaN", "1.2345678e7"]
