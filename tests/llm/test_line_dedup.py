import hashlib
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rowmesh.llm import common, line_dedup, simhash

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def plain(rows, min_chars=40, min_docs=5):
    """rows: (id, text); (id, lines, dropped, kept text) by counting in memory."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(A_Z)
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs.setdefault(key(line), set()).add(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df, **how):
    found = line_dedup.dedup_lines(df, **how).select("row.doc_id", "n_lines", "n_dropped", F.coalesce("kept", F.lit("")).alias("kept"))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    long, other = "A line of more than forty code points, É or not", "another line that is longer than forty code points"
    few = "only four documents hold this one, all the same it is long"
    made = [(i, f"{long}\nshort {i}\n  {long.upper().replace('É', 'É')} \x0b\n{other if i % 2 else ''}") for i in range(1, 10)]
    made += [(20 + i, f"{few}\n{few}\nx") for i in range(4)]
    made += [(30, None), (31, ""), (32, "\n\n"), (None, long), (None, other), (5, other), (5, f"{long}\n{long}"), (33, "x" * 39), (34, ("y" * 40 + "\n") * 2000 + long)]
    return made


@pytest.mark.parametrize("how", [{}, {"batches": 1}, {"batches": 9, "fanout": 2}])
def test_like_counting_in_memory(spark, rows, how):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, n_lines int, row string")
    assert got(df, **how) == plain(rows)


def test_runs_are_compacted_and_keys_stay_single(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    for i in range(6):
        runs.add(spark.createDataFrame([(k, k, 1, 10 * i + k) for k in (1, 2, i + 10)], "a bigint, b bigint, n bigint, last bigint"))
    assert all(len(level) < 2 for level in runs.levels) and len(runs.levels) >= 3
    held = sorted((r.a, r.n, r["last"]) for run in runs.runs() for r in run.collect())
    assert held == [(1, 1, 1), (2, 1, 2)] + [(i + 10, 1, 11 * i + 10) for i in range(6)]
    assert {(r.a, r.n, r["last"]) for r in runs.crowded(6).collect()} == {(1, 6, 51), (2, 6, 52)}
    assert len(runs.crowded(1).collect()) == 8


def test_the_anti_join_decides(spark, rows, monkeypatch):
    """Were a batch appended as it is, a key would be in several runs and its documents would not add up."""
    monkeypatch.setattr(line_dedup.LineRuns, "unseen", lambda self, batch: batch)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, n_lines int, row string")
    assert got(df) != plain(rows)


def test_joins_with_runs_have_no_exchange(spark):
    batches = spark.range(400).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), F.lit(1).cast("long").alias("n"), F.col("id").alias("last"), (F.col("id") % 3).alias("batch"))
    batches = common.bucketed(batches, ["a", "b"], 5, "batches", partition_by="batch")
    runs = line_dedup.LineRuns(spark, fanout=3, buckets=5)
    for i in range(2):
        runs.add(batches.where(F.col("batch") == i))
    plan = runs.unseen(batches.where("batch = 2").select("a", "b", "n", "last"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan


def test_threads_and_failures_leave_each_other_alone(spark, tmp_path, monkeypatch):
    """Line dedup and near-duplicates side by side, and a line dedup that fails: right results, and no folder or table left
    of the failed one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {"lines": got(docs), "near": sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())}
    found: dict = {}

    def lines():
        found["lines"] = got(docs)

    def near():
        found["near"] = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())

    threads = [threading.Thread(target=f) for f in (lines, near)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert found == want
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before, tables = set(shared.iterdir()), {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(line_dedup.LineRuns, "crowded", lambda self, n: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.dedup_lines(docs)
    assert set(shared.iterdir()) == before and {t.name for t in spark.catalog.listTables()} == tables


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain(docs)]
    found = line_dedup.query(spark, SF)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
