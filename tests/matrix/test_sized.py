"""Partitions and tasks that follow from the number of entries."""

from math import ceil

import pytest

from rowmesh import queries
from rowmesh.matrix import SparseMatrix
from rowmesh.operators import algebra
from rowmesh.plans import sized
from rowmesh.sources import clustered, generate, matrix_market, tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["add_canonical", "add_explicit", "sub_canonical", "sub_explicit"])
def test_sums_have_partitions_by_their_lines(spark, monkeypatch, name):
    want = sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(sized, "PART_ROWS", 300)
    df = queries.QUERIES[name](spark, SF)
    parts = ceil(tables.table(spark, SF, "lineitem").count() / 300)
    assert plan_of(df).count(f", {parts}), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan_of(df)
    assert sorted(map(tuple, df.collect())) == want


def test_text_has_files_and_partitions_by_its_lines(spark, monkeypatch, tmp_path):
    m = generate.random_matrix(spark, 60, 50, 900, seed=3)
    monkeypatch.setattr(sized, "PART_ROWS", 50)
    matrix_market.write(m, str(tmp_path / "m"))
    files = sorted((tmp_path / "m").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert len(files) > spark.sparkContext.defaultParallelism and lines[0].startswith("%%") and len(lines) == m.nnz() + 2
    cells = [tuple(map(int, line.split()[:2])) for line in lines[2:]]
    assert cells == sorted(cells)
    got = matrix_market.read(spark, str(tmp_path / "m"), strict=True)
    assert "REPARTITION_BY_NUM" in plan_of(got.df) and got.equals(m.canonical())


def test_repeats_are_sorted_by_ranges_of_lines(spark, monkeypatch):
    want = sorted(map(tuple, queries.QUERIES["mm_repeats"](spark, SF).collect()))
    monkeypatch.setattr(sized, "PART_ROWS", 60)
    df = queries.QUERIES["mm_repeats"](spark, SF)
    assert "REPARTITION_BY_NUM" in plan_of(df) and sorted(map(tuple, df.collect())) == want


@pytest.mark.parametrize("order", ["rows", "z"])
def test_a_task_writes_several_small_files(spark, tmp_path, order):
    m = generate.random_matrix(spark, 90, 80, 3000, seed=4)
    stored = clustered.Clustered.save(m, str(tmp_path / "c"), order=order, file_entries=40)
    names = [r["file"].rpartition("/")[2] for r in stored.directory.select("file").collect()]
    assert len(names) >= m.nnz() / 40 and len({n.split("-")[1] for n in names}) <= len(names) / 2
    sizes = [r["n"] for r in stored.directory.select("n").collect()]
    assert max(sizes) <= 40 and sum(sizes) == m.nnz()
    inside = sorted((r.row, r.col, r.val) for r in stored.rectangle((10, 40), (5, 30)).collect())
    assert inside == sorted((i, j, v) for i, j, v in m if 10 <= i < 40 and 5 <= j < 30)
    if order == "rows":
        assert [(r.row, r.col) for r in stored.slice(95, 210).orderBy("pos").collect()] == [(i, j) for i, j, _ in m][95:210]


def test_pieces_of_ordered_products_are_spread_by_records(spark, monkeypatch):
    a, b = generate.product_pair(spark, 20, 600, 15, 900, seed=7)
    a, b = (SparseMatrix(m.df.withColumn("val", m.df.val / 8), m.rows(), m.cols(), queries.DOUBLE) for m in (a, b))
    want = {(r.row, r.col): r.val for r in a.multiply(b, ordered=True).df.collect()}
    monkeypatch.setattr(sized, "PART_ROWS", 100)
    monkeypatch.setattr(algebra, "PIECE", 40)
    got = a.multiply(b, ordered=True).df
    assert "REPARTITION_BY_NUM" in plan_of(got) and {(r.row, r.col): r.val for r in got.collect()} == want
