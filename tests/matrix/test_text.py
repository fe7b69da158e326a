import pytest

from rowmesh import errors
from rowmesh.errors import MatrixMarketError, TupleTextError, ZeroDimensionError
from rowmesh.functions.kinds import COMPLEX, DOUBLE, INT64
from rowmesh.sources import generate, matrix_market, tuples

TOP = "%%MatrixMarket matrix coordinate "


@pytest.fixture
def read(spark, tmp_path):
    def go(text, **how):
        (tmp_path / "m.mtx").write_text(text)
        return matrix_market.read(spark, str(tmp_path / "m.mtx"), **how)

    return go


def test_general_integers_zeros_and_repeats(read):
    m = read(TOP + "integer general\n% a comment\n%\n3 4 9\n1 1 5\n2 3 -7\n1 1 6\n3 4 0\n2 3 0\n1 2 8")
    assert m.shape == (3, 4) and m.kind is INT64 and list(m) == [(0, 0, 6), (0, 1, 8), (1, 2, -7)]


def test_reals(read):
    m = read(TOP + "real general\n2 2 4\n1 1 1.5e3\n1 2 .5\n2 1 -2\n2 2 +3.25E-2\n")
    assert m.kind is DOUBLE and list(m) == [(0, 0, 1500.0), (0, 1, 0.5), (1, 0, -2.0), (1, 1, 0.0325)]


def test_symmetric_files_are_mirrored_and_the_last_line_wins(read):
    m = read(TOP + "integer symmetric\n3 3 4\n1 1 1\n2 1 2\n3 2 3\n1 2 9\n")
    assert list(m) == [(0, 0, 1), (0, 1, 9), (1, 0, 9), (1, 2, 3), (2, 1, 3)]


def test_complex(read):
    text = TOP + "complex symmetric\n2 2 2\n1 1 1 0\n2 1 0.5 -2\n"
    m = read(text)
    assert m.kind is COMPLEX and [(i, j, tuple(v)) for i, j, v in m] == [(0, 0, (1.0, 0.0)), (0, 1, (0.5, -2.0)), (1, 0, (0.5, -2.0))]
    assert read(text, compat=True).nnz() == 2


def test_malformed_lines(read):
    text = TOP + "integer general\n2 2 3\n1 1 5\n1 x 6\n2 2 7\n"
    with pytest.raises(MatrixMarketError, match="malformed"):
        read(text)
    assert list(read(text, compat=True)) == [(0, 0, 5)]
    for bad in ("integer general\n2 2 1\n0 1 5\n", "integer general\n2 2 1\n3 1 5\n", "integer general\n2 2 1\n1 1 1.5\n", "integer general\n", "integer symmetric\n2 3 1\n1 1 1\n"):
        with pytest.raises(MatrixMarketError):
            read(TOP + bad)
    for bad in ("pattern general", "real skew-symmetric", "complex hermitian"):
        with pytest.raises(MatrixMarketError, match="unsupported"):
            read(TOP + bad + "\n1 1 1\n1 1 1\n")
    for bad in ("", "%%MatrixMarket matrix array real general\n1 1\n1\n", "1 1 1\n"):
        with pytest.raises(MatrixMarketError):
            read(bad)
    with pytest.raises(ZeroDimensionError):
        read(TOP + "integer general\n0 2 0\n")
    with pytest.raises(MatrixMarketError, match="size line"):
        read(TOP + "integer general\n2 2 2\n1 1 1\n", strict=True)


@pytest.mark.parametrize("kind", [INT64, DOUBLE, COMPLEX])
def test_round_trips(spark, tmp_path, kind):
    m = generate.random_matrix(spark, 40, 30, 500, seed=6, kind=kind)
    matrix_market.write(m, str(tmp_path / "mm"))
    back = matrix_market.read(spark, str(tmp_path / "mm"), strict=True)
    assert back.same_structure(m) and back.kind is kind
    lines = [x for p in sorted((tmp_path / "mm").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[0].startswith(TOP) and lines[1] == f"40 30 {m.nnz()}"
    assert [tuple(map(int, x.split()[:2])) for x in lines[2:]] == [(i + 1, j + 1) for i, j, _ in m]
    if kind is not COMPLEX:
        tuples.write(m, str(tmp_path / "t"))
        assert tuples.read(spark, str(tmp_path / "t"), kind).same_structure(m)


def test_tuple_text(spark, tmp_path):
    (tmp_path / "t").write_text("(3,4,3)\n(0,1,5) (0,3,-2)\n(2,0,7)")
    m = tuples.read(spark, str(tmp_path / "t"))
    assert m.shape == (3, 4) and list(m) == [(0, 1, 5), (0, 3, -2), (2, 0, 7)]
    assert [r.line for r in tuples.row_lines(m).orderBy("row").collect()] == ["(0,1,5) (0,3,-2)", "(2,0,7)"]
    for bad in ("", "3 4 3\n", "(3,4,1)\n(0,1)\n"):
        (tmp_path / "t").write_text(bad)
        with pytest.raises(TupleTextError):
            tuples.read(spark, str(tmp_path / "t"))


def test_folder_of_files(spark, tmp_path):
    """Each file is read by its own header and squared, as a benchmark over a corpus does."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.mtx").write_text(TOP + "integer general\n2 2 2\n1 2 3\n2 1 4\n")
    (tmp_path / "a.mtx").write_text(TOP + "real symmetric\n2 2 2\n1 1 .5\n2 1 2\n")
    found = [(p.rsplit("/", 1)[1], m.kind, list(m.squared())) for p, m in matrix_market.read_folder(spark, str(tmp_path))]
    assert found == [("a.mtx", DOUBLE, [(0, 0, 4.25), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 4.0)]), ("b.mtx", INT64, [(0, 0, 12), (1, 1, 12)])]


def test_a_folder_is_read_by_one_scan_like_file_by_file(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate"
    files = {
        "a.mtx": f"{head} integer general\n% note\n3 3 4\n1 1 5\n2 3 -7\n2 3 0\n3 1 9\n3 1 8\n",
        "b.mtx": f"{head} integer symmetric\n2 2 2\n2 1 4\n2 2 1\n",
        "c.mtx": f"{head} real general\n2 4 2\n1 4 .5e1\n2 1 -inf\n",
        "d.mtx": f"{head} complex symmetric\n3 3 2\n3 1 1 -2\n2 2 0 1e0\n",
        "e.mtx": f"{head} integer general\n5 5 0\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = matrix_market.read_corpus(spark, str(tmp_path))
    assert [found[f].shapes.count() for f in ("integer", "real", "complex")] == [3, 1, 1]
    for path, alone in matrix_market.read_folder(spark, str(tmp_path)):
        field = {"c.mtx": "real", "d.mtx": "complex"}.get(path.rsplit("/", 1)[1], "integer")
        file = next(r["file"] for r in found[field].shapes.collect() if r["file"].rsplit("/", 1)[1] == path.rsplit("/", 1)[1])
        assert found[field].matrix(file).same_structure(alone)
    squares = found["integer"].squares().collect()
    for path, alone in matrix_market.read_folder(spark, str(tmp_path)):
        if path.rsplit("/", 1)[1] in ("a.mtx", "b.mtx", "e.mtx"):
            assert {(r["row"], r["col"]): r["val"] for r in squares if r["file"].endswith(path.rsplit("/", 1)[1])} == {(i, j): v for i, j, v in alone.squared()}
    with pytest.raises(errors.ProductMismatch):
        found["real"].squares()


@pytest.mark.parametrize("text,error", [("nothing", "header"), ("pattern", "unsupported"), ("size", "size line"), ("zero", "at least one"), ("line", "malformed line: 1 x 3"), ("bounds", "outside"), ("square", "square")])
def test_a_bad_file_in_a_folder_is_named(spark, tmp_path, text, error):
    head = "%%MatrixMarket matrix coordinate"
    bad = {
        "nothing": "1 1 1\n", "pattern": f"{head} pattern general\n1 1 1\n1 1\n", "size": f"{head} integer general\n% only\n", "zero": f"{head} integer general\n0 2 0\n",
        "line": f"{head} integer general\n2 2 2\n1 1 3\n1 x 3\n2 2 2\n", "bounds": f"{head} integer general\n2 2 1\n3 1 3\n", "square": f"{head} integer symmetric\n2 3 1\n1 1 3\n",
    }
    (tmp_path / "good.mtx").write_text(f"{head} integer general\n2 2 1\n1 1 3\n")
    (tmp_path / "other.mtx").write_text(bad[text])
    with pytest.raises(errors.MatrixMarketError, match=error):
        matrix_market.read_corpus(spark, str(tmp_path))
    if text == "line":
        found = matrix_market.read_corpus(spark, str(tmp_path), compat=True)["integer"]
        assert sorted(r["val"] for r in found.entries.collect()) == [3, 3]
