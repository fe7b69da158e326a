"""Every corpus query that has SQL, against that SQL."""

from pathlib import Path

import duckdb
import pytest

from rowmesh.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_like_its_sql(spark, oracle, name):
    df, want = catalog.QUERIES[name](spark, SF), oracle.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    shown = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    rows = sorted((shown(r) for r in df.collect()), key=str)
    assert rows == sorted((shown([r[i] for i in order]) for r in want.fetchall()), key=str) and rows
