"""The data source of Matrix Market files against the reader of text lines, byte ranges of all sizes included."""

import random

import pytest

from rowmesh import errors
from rowmesh.functions.kinds import COMPLEX, DOUBLE, INT64
from rowmesh.sources import generate, matrix_market, matrix_market_source

HEAD = "%%MatrixMarket matrix coordinate "


def spans(path, size, **options):
    return [s for *_, found in matrix_market_source.plan(str(path), range_bytes=size, **options) for s in found]


def lines_of(path, size):
    system = matrix_market_source._system(str(path))[0]
    return [(at, text) for s in spans(path, size) for at, text in matrix_market_source._batches(s, system)]


@pytest.mark.parametrize("batch", [1, 7, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "", "\r\n", "\n\n\n"])
def test_each_line_is_in_one_range(tmp_path, monkeypatch, end, batch):
    rng = random.Random(3)
    entries = [f"{rng.randrange(1, 10 ** rng.randrange(1, 6))} {i + 1} {rng.randrange(99)}" for i in range(40)]
    path = tmp_path / "m.mtx"
    text = HEAD + "integer general\n% a comment\n99999 40 40\n" + "\n".join(entries) + end
    path.write_bytes(text.encode())
    monkeypatch.setattr(matrix_market_source, "BATCH_BYTES", batch)
    for size in (1, 2, 3, 11, 64, 10_000):
        found = lines_of(path, size)
        assert b"".join(x for _, x in found) == text.encode()[text.index(entries[0]) :]
        assert all(text.encode()[at : at + len(x)] == x for at, x in found)


@pytest.mark.parametrize("kind", [INT64, DOUBLE, COMPLEX])
def test_same_as_the_reader_of_lines(spark, tmp_path, kind):
    m = generate.random_matrix(spark, 40, 30, 500, seed=6, kind=kind)
    matrix_market.write(m, f"{tmp_path}/m")
    got = matrix_market_source.read(spark, f"{tmp_path}/m")
    assert got.kind is kind and got.shape == m.shape and got.same_structure(matrix_market.read(spark, f"{tmp_path}/m")) and got.same_structure(m)
    matrix_market_source.register(spark)
    small = spark.read.format("matrix_market").option("rangeBytes", 200).load(f"{tmp_path}/m")
    assert small.rdd.getNumPartitions() > 10 and small.count() == m.nnz()
    assert small.schema["val"].dataType == m.df.schema["val"].dataType


CASES = {
    "repeats": ("integer general", "3 3 9", "1 1 4\n2 2 5\n1 1 7\n2 2 0\n3 1 0\n"),
    "symmetric": ("integer symmetric", "3 3 9", "1 1 4\n2 1 5\n3 2 -7\n3 3 1\n"),
    "complex symmetric": ("complex symmetric", "2 2 2", "1 1 1 0\n2 1 0 -2.5e1\n"),
    "reals": ("real general", "3 4 9", "1 1 +.5\n1 2 1.\n1 3 2E+1\n2 1 -Inf\n2 2 +inf\n3 1 5\n3 2 -0.0\n"),
    "no entries": ("integer general", "3 3 0", ""),
    "no entries, no end": ("integer general", "3 3 0", None),
}


@pytest.mark.parametrize("case", CASES)
def test_files(spark, tmp_path, case):
    kind, size, body = CASES[case]
    path = tmp_path / "m.mtx"
    path.write_text(f"{HEAD}{kind}\n%\n{size}" + ("" if body is None else "\n" + body))
    got, want = matrix_market_source.read(spark, str(path)), matrix_market.read(spark, str(path))
    assert got.shape == want.shape and got.kind is want.kind and sorted(map(str, got)) == sorted(map(str, want))


def test_nan_stays(spark, tmp_path):
    (tmp_path / "m.mtx").write_text(HEAD + "real general\n1 2 1\n1 2 NaN\n")
    [(i, j, v)] = matrix_market_source.read(spark, str(tmp_path / "m.mtx"))
    assert (i, j) == (0, 1) and v != v


@pytest.mark.parametrize("text", ["", "1 1 1\n", HEAD + "pattern general\n1 1 1\n", HEAD + "integer skew-symmetric\n1 1 1\n", HEAD + "integer general\n% no size\n", HEAD + "integer general\n1 1\n", HEAD + "integer general\n0 1 1\n", HEAD + "integer symmetric\n1 2 1\n"])
def test_headers_that_are_refused(spark, tmp_path, text):
    path = tmp_path / "m.mtx"
    path.write_text(text)
    with pytest.raises(errors.MatrixMarketError):
        matrix_market_source.read(spark, str(path))


@pytest.mark.parametrize(("line", "message"), [("1 two 3", "malformed line: '1 two 3'"), ("1 1 1.5", "malformed"), ("0 1 1", "outside"), ("1 4 1", "outside"), ("1 1 99999999999999999999", "malformed"), ("1 1 1 1", "malformed")])
def test_entries_that_are_refused(spark, tmp_path, line, message):
    path = tmp_path / "m.mtx"
    path.write_text(f"{HEAD}integer general\n3 3 2\n1 1 1\n{line}\n")
    with pytest.raises(Exception, match=message):
        matrix_market_source.read(spark, str(path)).nnz()


def test_folder_with_a_matrix_a_file(spark, tmp_path):
    for n, m in enumerate(generate.random_matrix(spark, 9, 9, 40, seed=s) for s in (1, 2)):
        body = "".join(f"{i + 1} {j + 1} {v}\n" for i, j, v in m)
        (tmp_path / f"{n}.mtx").write_text(f"{HEAD}integer general\n9 9 {m.nnz()}\n{body}")
    got, want = matrix_market_source.read_corpus(spark, str(tmp_path)), matrix_market.read_corpus(spark, str(tmp_path))["integer"]
    rows = lambda df: sorted((r["file"].rpartition("/")[2], r["row"], r["col"], r["val"]) for r in df.collect())
    assert rows(got.entries) == rows(want.entries) and rows(got.squares()) == rows(want.squares())
    (tmp_path / "2.mtx").write_text(HEAD + "real general\n1 1 1\n1 1 1\n")
    with pytest.raises(Exception, match="different fields"):
        matrix_market_source.read_corpus(spark, str(tmp_path)).entries.count()
