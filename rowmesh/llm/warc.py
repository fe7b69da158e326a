"""WARC archives with the index first.

Writing gives one index row for each record: file, offset, length, URL and digest. Any selection from that index is read
back by byte ranges: sorted by file and offset, neighbouring ranges coalesce into one read. Records are gzip members of
their own, as usual, so each range stands alone. Records with equal payloads are written once, as the response of the
largest id; the others become revisit records that refer to it.

Files go through ``pyarrow.fs`` to a folder that all executors share. A task writes under a name of its own and its
index rows count only once it ends well, so retried and speculative tasks leave files that no index names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
FILE_BYTES = 1 << 30
#: Ranges this close together are read at once, in reads of at most so many bytes unless one record is longer.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: A task reads about so many bytes of a file.
TASK_BYTES = 64 << 20

INDEX = "id {kind}, url string, file string, offset bigint, length bigint, digest string, type string, refers_to {kind}"


def _digest(hex_sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def record(kind: str, key, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record, not compressed. A revisit keeps the response's HTTP header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, payload length by the HTTP header, and the payload (empty in a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return headers, size, payload


def store_of(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and the path there. Hadoop's names of S3, ``s3a`` and ``s3n``, are ``s3`` to Arrow."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def _packed(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def roles(pages: DataFrame, id_col: str, html_col: str, min_bytes: int = 0) -> DataFrame:
    """(revisit_id, revisit_sha, refers_to) of the pages that repeat a payload of ``min_bytes`` or more."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    ids = common.stored(pages.select(F.col(id_col).alias("id"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("bytes")), "payload-digests")
    shared = ids.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("refers_to")).where("n > 1 and refers_to is not null")
    shared = common.stored(shared, "shared-payloads")  # so that the partition of a very common payload can be split
    again = ids.join(shared, "sha").where(~F.col("id").eqNullSafe(F.col("refers_to")))
    return common.stored(again.select(F.col("id").alias("revisit_id"), F.col("sha").alias("revisit_sha"), "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write one record for each row of ``pages`` below ``folder`` and return the stored index.

    Payloads are the html in UTF-8; null is empty. Among equal payloads of ``min_bytes`` or more the largest id is the
    response; rows that share that id as well are responses too. Null ids are never the largest; where all ids of a
    payload are null, all are responses. An empty table gives an empty index."""
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    again = roles(pages, id_col, html_col, min_bytes)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("revisit_id")) & (F.col("sha") == F.col("revisit_sha")), "left")
    rows = rows.select("id", "url", "payload", "sha", F.col("revisit_sha").isNotNull().alias("repeats"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(folder)
        out, name, at = None, "", 0
        for b in batches:
            found = []
            for key, url, body, sha, repeats, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    fs.create_dir(base, recursive=True)
                    name, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                digest, type_ = _digest(sha), "revisit" if repeats else "response"
                member = _packed(record(type_, key, url.replace("\r", "%0D").replace("\n", "%0A"), body, digest, refers))
                out.write(member)
                found.append((key, url, name, at, len(member), digest, type_, refers))
                at += len(member)
            if found:
                columns = list(zip(*found, strict=True))
                types = [b.schema.field("id").type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), b.schema.field("refers_to").type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "url", "file", "offset", "length", "digest", "type", "refers_to"])
        if out is not None:
            out.close()

    return common.stored(rows.mapInArrow(run, INDEX.format(kind=kind)), "warc-index")


def coalesced(ranges: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(file, start, end, ranges in it) of the reads for sorted (file, offset, length)."""
    reads: list[list] = []
    for file, offset, length in ranges:
        last = reads[-1] if reads else None
        if last and last[0] == file and offset - last[2] <= GAP_BYTES and offset + length - last[1] <= READ_BYTES:
            last[2], last[3] = max(last[2], offset + length), last[3] + 1
        else:
            reads.append([file, offset, offset + length, 1])
    return [tuple(r) for r in reads]


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the records that ``index`` (any selection of its rows) names: id, url, type, digest, payload_bytes, refers_to, payload.

    A response's payload is digested again and must fit its record. ``payloads=False`` leaves the payload out."""
    kind = index.select("id").schema[0].dataType.simpleString()
    wanted = index.select("id", "url", "file", "offset", "length", "refers_to", F.floor(F.col("offset") / TASK_BYTES).alias("piece"))
    total = index.agg(F.sum("length")).first()[0] or 0  # the rows are few bytes, so their number alone would make too few tasks
    wanted = wanted.repartition(max(1, ceil(total / TASK_BYTES)), "file", "piece").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(folder)
        source, opened = None, ""
        for b in batches:
            rows = b.select(["id", "url", "file", "offset", "length"]).to_pylist()
            types, at = [b.schema.field("id").type, pa.string(), pa.string(), pa.string(), pa.int64(), b.schema.field("refers_to").type, pa.binary()], 0
            for file, start, end, n in coalesced([(r["file"], r["offset"], r["length"]) for r in rows]):
                if file != opened:
                    if source is not None:
                        source.close()
                    source, opened = fs.open_input_file(f"{base}/{file}"), file
                source.seek(start)
                data, found = source.read(end - start), []
                for r, refers in zip(rows[at : at + n], b.column("refers_to")[at : at + n].to_pylist(), strict=True):
                    raw = zlib.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]], 31)
                    headers, size, payload = parse(raw)
                    type_, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if type_ == "response" and (len(payload) != size or _digest(hashlib.sha1(payload).hexdigest()) != digest):
                        raise ValueError(f"{file} at {r['offset']}: the payload does not fit its digest")
                    if type_ == "revisit" and headers["WARC-Refers-To"] != f"<urn:page:{refers}>":
                        raise ValueError(f"{file} at {r['offset']}: the index names another response")
                    found.append((r["id"], r["url"], type_, digest, size, refers if type_ == "revisit" else None, payload if payloads else None))
                at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["id", "url", "type", "digest", "payload_bytes", "refers_to", "payload"])
        if source is not None:
            source.close()

    return wanted.mapInArrow(run, f"id {kind}, url string, type string, digest string, payload_bytes bigint, refers_to {kind}, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all pages written as WARC records and read back."""
    folder = common.shared_path(spark, "warc")
    index = write_archives(common.table(spark, sf_dir, "pages"), folder)
    back = read_records(index, folder, payloads=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS most FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest,
  CASE WHEN page_id = most OR most IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = most OR most IS NULL THEN NULL ELSE most END AS refers_to
FROM m
"""
