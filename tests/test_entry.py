"""The entry module: names, oracles, and life without the corpus folders."""

import subprocess
import sys
import textwrap
import threading
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from rowmesh import queries, shared

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_like_its_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    want = oracle.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    rows = sorted((tuple(map(shown, r)) for r in df.collect()), key=str)
    assert rows == sorted((tuple(shown(r[i]) for i in order) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_folders(tmp_path):
    for p in (*ROOT.glob("*.py"), *ROOT.glob("rowmesh/**/*.py")):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py":
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = textwrap.dedent("""
        import __spark_entry__ as e
        assert "spgemm_supplier_gram" in e.queries() and not [n for n in e.queries() if n.startswith("op1") or n == "pipeline"]
    """)
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_scopes(spark):
    there = lambda paths: [Path(p.removeprefix("file:")).exists() for p in paths]

    def folder():
        path = shared.shared_path(spark, "x")
        spark.range(1).write.parquet(path)
        return path

    with shared.Scope(spark) as outer:
        first = folder()
        with shared.Scope(spark) as inner:
            paths = [folder() for _ in range(3)]
            inner.discard(keep=1)
            assert there(paths) == [False, False, True]
        assert outer.paths == [first, paths[2]]
        with pytest.raises(ValueError), shared.Scope(spark):
            lost, name = folder(), shared.shared_table(shared.shared_path(spark, "t"))
            spark.range(3).write.saveAsTable(name)
            raise ValueError
        assert there([lost, first]) == [False, True] and not spark.catalog.tableExists(name)
    assert there([first, paths[2]]) == [True, True]


def test_scopes_of_threads_are_apart(spark):
    """One thread's clearing up leaves the other's folders alone, however they interleave."""
    gate, left = threading.Barrier(2), {}

    def work(name):
        with shared.Scope(spark) as scope:
            path = shared.shared_path(spark, name)
            spark.range(5).write.parquet(path)
            gate.wait(60)
            if name == "a":
                scope.discard()
            gate.wait(60)
            left[name] = Path(path.removeprefix("file:")).exists(), len(scope.paths)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert left == {"a": (False, 0), "b": (True, 1)}


def test_shared_folders(spark):
    assert shared.shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "yarn"})

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared.shared_path(Session, "x")
    Session.sparkContext.master = "local[8]"
    assert "rowmesh-shared" in shared.shared_path(Session, "x")
