"""Clustered files with their directory, bucketed products and logs of writes."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from rowmesh import errors
from rowmesh.functions.kinds import COMPLEX, DOUBLE
from rowmesh.matrix import SparseMatrix
from rowmesh.sources import clustered, generate, log


@pytest.fixture(scope="module")
def matrix(spark):
    m = generate.random_matrix(spark, 300, 200, 4000, seed=8, drop_zeros=False)
    return m, sorted((r["row"], r["col"], r["val"]) for r in m.df.collect())


@pytest.fixture(scope="module")
def by_rows(matrix, tmp_path_factory):
    return clustered.Clustered.save(matrix[0], f"{tmp_path_factory.mktemp('rows')}/m", file_entries=250)


@pytest.fixture(scope="module")
def by_z(matrix, tmp_path_factory):
    return clustered.Clustered.save(matrix[0], f"{tmp_path_factory.mktemp('z')}/m", order="z", file_entries=250)


def test_positions_read_one_file(by_rows, matrix):
    entries = matrix[1]
    assert by_rows.nnz == len(entries) and by_rows.directory.count() == -(-len(entries) // 250)
    for n in (0, 249, 250, 1234, len(entries) - 1, -1, -251):
        assert by_rows.nth(n) == entries[n]
        assert len(by_rows.slice(n, n + 1 if n != -1 else len(entries)).inputFiles()) == 1
    assert [tuple(r)[:3] for r in by_rows.slice(240, 520).orderBy("pos").collect()] == entries[240:520] and len(by_rows.slice(240, 520).inputFiles()) == 3
    assert [tuple(r)[:3] for r in by_rows.slice(-5, len(entries)).orderBy("pos").collect()] == entries[-5:] and by_rows.slice(9, 3).count() == 0
    for n in (len(entries), -len(entries) - 1):
        with pytest.raises(errors.MatrixIndexError):
            by_rows.nth(n)


def test_ranks_and_steps(by_rows, matrix):
    entries = matrix[1]
    for i, j in ((0, 0), (17, 5), (299, 199), entries[777][:2], entries[0][:2]):
        before = sum((x, y) < (i, j) for x, y, _ in entries)
        assert by_rows.rank(i, j) == before
        for n in (0, 1, -1, 300):
            assert by_rows.step(i, j, n) == (entries[before + n] if 0 <= before + n < len(entries) else None)


def test_rectangles_read_few_files(by_z, by_rows, matrix):
    entries, files = matrix[1], by_z.directory.count()
    for rows, cols in (((0, 40), (0, 40)), ((130, 150), (60, 80)), ((0, 300), (199, 200)), ((299, 300), (0, 200)), ((5, 5), (0, 200))):
        want = [(i, j, v) for i, j, v in entries if rows[0] <= i < rows[1] and cols[0] <= j < cols[1]]
        for stored in (by_z, by_rows):
            assert sorted(map(tuple, stored.rectangle(rows, cols).collect())) == want
    assert len(by_z.rectangle((130, 150), (60, 80)).inputFiles()) <= 4 < files
    assert len(by_z.rectangle((0, 300), (100, 102)).inputFiles()) <= 0.75 * files and len(by_z.rectangle((100, 102), (0, 200)).inputFiles()) <= 0.75 * files
    i, j, v = entries[1000]
    assert by_z.get(i, j) == by_rows.get(i, j) == v
    key = F.struct(*clustered.z_order(F.lit(i).cast("long"), F.lit(j).cast("long")))
    assert len(by_z.files((F.col("first") <= key) & (F.col("last") >= key))) == 1
    assert by_z.matrix().same_structure(matrix[0]) and by_rows.matrix().same_structure(matrix[0])
    with pytest.raises(errors.MatrixIndexError):
        by_z.get(300, 0)
    with pytest.raises(errors.MatrixError):
        by_z.nth(3)


def test_z_order_interleaves(spark):
    rng = random.Random(1)
    cells = [(rng.randrange(1 << 40), rng.randrange(1 << 40)) for _ in range(300)]
    keys = lambda i, j: int("".join(a + b for a, b in zip(f"{i:062b}", f"{j:062b}", strict=True)), 2)
    df = spark.createDataFrame(cells, "row bigint, col bigint")
    assert [tuple(r) for r in df.orderBy(*clustered.z_order(F.col("row"), F.col("col"))).collect()] == sorted(cells, key=lambda c: keys(*c))


def test_empty_matrices_can_be_stored(spark, tmp_path):
    for order in ("rows", "z"):
        stored = clustered.Clustered.save(SparseMatrix.empty(spark, 3, 4, DOUBLE), f"{tmp_path}/{order}", order)
        assert stored.matrix().nnz() == 0 and stored.get(1, 1) is None and stored.shape == (3, 4) and stored.kind is DOUBLE


def test_product_of_bucketed_matrices_has_no_exchange_on_the_inner_index(spark, matrix):
    m, names = matrix[0], [f"m_{uuid.uuid4().hex}" for _ in range(2)]
    a, b = clustered.save_by_index(m, names[0], "col", 5), clustered.save_by_index(m.transpose(), names[1], "row", 5)
    product = a.multiply(b)
    pairs = a.df.join(b.df.select(F.col("row").alias("col"), F.col("col").alias("j")).hint("merge"), "col")
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert product.same_structure(m @ m.transpose())
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_log_of_writes(spark, tmp_path):
    """Batches of single writes against a dictionary, with compaction on the way, and every version as it was."""
    rng, cells = random.Random(5), {(i, i): i for i in range(20)}
    kept = log.MatrixLog.create(SparseMatrix.of(spark, [(i, j, v) for (i, j), v in cells.items()], 20, 30), f"{tmp_path}/log", fanout=3)
    versions = {kept.version: dict(cells)}
    for _ in range(8):
        writes = [(rng.randrange(20), rng.randrange(30), rng.choice([None, 0, 1, 2, 3])) for _ in range(60)]
        kept = kept.write(writes, drop_zeros=rng.random() < 0.5 and all(v != 0 for *_, v in writes))
        for i, j, v in writes:
            cells.pop((i, j), None)
            if v is not None:
                cells[i, j] = v
        versions[kept.version] = dict(cells)
        assert all(len(level) < 3 for level in kept.levels) and len(kept.runs()) <= 2 * len(kept.levels)
    assert len(kept.levels) >= 3
    for version, want in versions.items():
        assert {(i, j): v for i, j, v in log.MatrixLog.open(spark, kept.path, version).matrix()} == want
    last = log.MatrixLog.open(spark, kept.path)
    assert last.version == kept.version and all(last.get(i, j) == cells.get((i, j)) for i, j in ((0, 0), (3, 7), (19, 29)))
    last.vacuum()
    assert {(i, j): v for i, j, v in log.MatrixLog.open(spark, kept.path).matrix()} == cells
    with pytest.raises(errors.MatrixIndexError):
        last.write([(20, 0, 1)])


def test_ten_thousand_writes_have_a_plan_of_constant_depth(spark, tmp_path):
    rng = random.Random(9)
    start = log.MatrixLog.create(SparseMatrix.empty(spark, 100, 100), f"{tmp_path}/many")
    writes = [(rng.randrange(100), rng.randrange(100), rng.randrange(1, 9)) for _ in range(10_000)]
    one, many = start.write(writes[:1]), None
    many = one.write(writes[1:])
    depth = lambda m: m.df._jdf.queryExecution().executedPlan().toString().count("\n")
    assert abs(depth(many.matrix()) - depth(one.matrix())) <= 2
    want = {(i, j): v for i, j, v in writes}
    assert {(i, j): v for i, j, v in many.matrix()} == want


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    start = log.MatrixLog.create(SparseMatrix.empty(spark, 3, kind=COMPLEX), f"{tmp_path}/two")
    start.write([(0, 0, 1 + 2j)])
    with pytest.raises(Exception, match="exist"):
        start.write([(1, 1, 3j)])
    assert log.MatrixLog.open(spark, f"{tmp_path}/two").get(0, 0).asDict() == {"re": 1.0, "im": 2.0}
    with pytest.raises(errors.MatrixError):
        log.MatrixLog.open(spark, f"{tmp_path}/none")
