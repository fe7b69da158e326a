import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rowmesh.llm import common, warc

ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""), (9, "http://d/", "one\r\n\r\ntwo"), (9, "http://d/", "one\r\n\r\ntwo"), (None, "http://e/", "<p>é</p>"), (None, "http://f/", "null only"), (None, "http://g/", "null only"), (7, "http://h/", "x" * 300_000)]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def archive(spark):
    folder = common.shared_path(spark, "warc-test")
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in ROWS], "page_id bigint, url string, html string, type string")
    return folder, warc.write_archives(df, folder)


def test_read_back(spark, archive):
    folder, index = archive
    got = sorted(((r.id, r.payload_bytes, r.digest, r.type, r.refers_to) for r in warc.read_records(index, folder).collect()), key=str)
    most = {}
    for i, _, h in ROWS:
        if i is not None:
            most[h or ""] = max(i, most.get(h or "", i))
    want = []
    for i, _, h in ROWS:
        m = most.get(h or "")
        revisit = m is not None and i != m
        want.append((i, len((h or "").encode()), sha(h), "revisit" if revisit else "response", m if revisit else None))
    assert got == sorted(want, key=str)


def test_files_are_gzip_members_in_index_order(archive):
    folder, index = archive
    for file in {r.file for r in index.collect()}:
        raw = Path(folder, file).read_bytes()
        rows = sorted((r for r in index.collect() if r.file == file), key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) == len(raw)
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_a_selection_reads_only_its_ranges(archive):
    folder, index = archive
    got = warc.read_records(index.where("id = 7"), folder).collect()
    assert [bytes(r.payload) for r in got] == [b"x" * 300_000] and got[0].url == "http://h/"


def test_coalescing():
    near = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES, 5), ("a", 30 + 3 * warc.GAP_BYTES, 5), ("b", 0, 5)]
    assert warc.coalesced(near) == [("a", 0, 25 + warc.GAP_BYTES, 3), ("a", 30 + 3 * warc.GAP_BYTES, 35 + 3 * warc.GAP_BYTES, 1), ("b", 0, 5, 1)]
    assert warc.coalesced([("a", 0, warc.READ_BYTES), ("a", warc.READ_BYTES, 1)]) == [("a", 0, warc.READ_BYTES, 1), ("a", warc.READ_BYTES, warc.READ_BYTES + 1, 1)]


def test_smallest_payload_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    folder = common.shared_path(spark, "warc-test")
    index = warc.write_archives(df, folder, min_bytes=3)
    assert {r.id: r.refers_to for r in index.collect()} == {1: None, 2: None, 3: 4, 4: None}
    folder = common.shared_path(spark, "warc-test")
    assert warc.read_records(warc.write_archives(df.where(F.lit(False)), folder), folder).count() == 0


def test_folders_are_named_as_spark_names_them(monkeypatch):
    """Spark's names of S3 reach Arrow's file system of that kind; others go as they are."""
    asked = []
    monkeypatch.setattr(warc.pyarrow.fs, "FileSystem", type("Fake", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (None, uri))}))
    for name in ("s3a://bucket/x", "s3n://bucket/x", "s3://bucket/x", "hdfs://host/x", "file:///x/s3a://y"):
        warc.store_of(name)
    assert asked == ["s3://bucket/x"] * 3 + ["hdfs://host/x", "file:///x/s3a://y"]


def test_the_file_system_of_s3a_is_that_of_s3():
    fs, path = warc.store_of("s3a://key:secret@bucket/folder?region=us-east-1")
    assert fs.type_name == "s3" and path == "bucket/folder"
