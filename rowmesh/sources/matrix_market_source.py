"""Matrix Market as a data source: ``spark.read.format("matrix_market").load(path)``.

A file is cut into ranges of bytes, one task each. A task reads the lines that start in its range, parses them in Arrow
batches and gives ``(file, part, at, row, col, val)``: the name of the matrix's file, and the part and byte at which an
entry's line starts, so that the order of lines is known. Indexes are from 0, symmetric files are mirrored and zeros are
left out, as in ``matrix_market.read``; of repeated cells all lines are given, of which ``read`` keeps the last.

The schema follows from the header. A folder is one matrix cut into part files, in order of their names, or with the
option ``corpus`` one matrix a file. Headers and sizes are read where the query is planned, a few KB a matrix; entries are
read once, by tasks only. A task that meets a malformed line or an index outside the shape fails, and the query with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import MatrixMarketError, ZeroDimensionError
from ..matrix import SparseMatrix
from .matrix_market import FLOAT, HEADER, KIND, Corpus

FORMAT = "matrix_market"
RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_INDEXES = r"^\s*(?P<i>\d+)\s+(?P<j>\d+)\s+"
LINE = {
    "integer": _INDEXES + r"(?P<x>-?\d+)\s*$",
    "real": rf"{_INDEXES}(?P<x>(?i:{FLOAT}))\s*$",
    "complex": rf"{_INDEXES}(?P<x>(?i:{FLOAT}))\s+(?P<y>(?i:{FLOAT}))\s*$",
}


@dataclass(frozen=True)
class Head:
    """What precedes the entries of a matrix; they start in part ``part`` at byte ``start``."""

    field: str
    symmetric: bool
    rows: int
    cols: int
    entries: int
    part: int
    start: int


@dataclass(frozen=True)
class Span(InputPartition):
    """The lines of part ``number`` that start at a byte from ``first`` up to ``end``, this not included."""

    root: str
    name: str
    head: Head
    path: str
    number: int
    first: int
    end: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; Spark's names of S3 are Arrow's ``s3``."""
    path = re.sub("^file:/+", "/", re.sub("^s3[an]://", "s3://", path))
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _files(system: fs.FileSystem, base: str) -> list[fs.FileInfo]:
    """The files at or right below ``base`` in order of their names, without hidden and empty ones."""
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base))
    return sorted((f for f in found if f.type == fs.FileType.File and f.size and f.base_name[0] not in "_."), key=lambda f: f.path)


def _head(system: fs.FileSystem, parts: list[fs.FileInfo]) -> Head:
    """The header and the size line, after any comments, which may run over several parts."""
    header = None
    for number, part in enumerate(parts):
        with system.open_input_file(part.path) as f:
            at, rest, more = 0, b"", True
            while more:
                block = f.read(1 << 16)
                more = bool(block)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines + ([rest] if not more and rest else []):
                    at += len(line) + 1
                    text = line.decode("utf-8", "replace").removesuffix("\r")
                    if header is None:
                        header = HEADER.fullmatch(text)
                        if not header:
                            raise MatrixMarketError("the first line is no coordinate header")
                        field, symmetry = header.groups()
                        if field == "pattern" or symmetry in ("skew-symmetric", "hermitian"):
                            raise MatrixMarketError(f"unsupported: {field} {symmetry}")
                    elif not text.startswith("%"):
                        size = re.fullmatch(r"\s*(\d+)\s+(\d+)\s+(\d+)\s*", text)
                        if not size:
                            raise MatrixMarketError("there is no size line")
                        rows, cols, told = map(int, size.groups())
                        if not rows or not cols:
                            raise ZeroDimensionError
                        if symmetry == "symmetric" and rows != cols:
                            raise MatrixMarketError("a symmetric matrix must be square")
                        return Head(field, symmetry == "symmetric", rows, cols, told, number, at)
    raise MatrixMarketError("there is no size line" if header else "the first line is no coordinate header")


def plan(path: str, corpus: bool = False, range_bytes: int = RANGE_BYTES) -> list[tuple[str, Head, list[Span]]]:
    """(file, head, spans) of each matrix at ``path``."""
    system, base = _system(path)
    files, found = _files(system, base), []
    if not files:
        raise MatrixMarketError("there is no file")
    for parts in [[f] for f in files] if corpus else [files]:
        head = _head(system, parts)
        spans = []
        for number, part in enumerate(parts):
            start = 0 if number > head.part else head.start if number == head.part else part.size
            spans += [Span(path, parts[0].path, head, part.path, number, at, min(at + range_bytes, part.size)) for at in range(start, part.size, range_bytes)]
        found.append((parts[0].path, head, spans))
    return found


def _batches(span: Span, system: fs.FileSystem) -> Iterator[tuple[int, bytes]]:
    """(byte, lines): whole lines that start within the span, some MB at a time."""
    with system.open_input_file(span.path) as f:
        at = span.first
        if at > (span.head.start if span.number == span.head.part else 0):
            f.seek(at - 1)  # a line that starts before belongs to the span before
            while True:
                block = f.read(1 << 16)
                cut = block.find(b"\n")
                if cut >= 0 or not block:
                    break
                at += len(block)
            if not block:
                return
            at += cut
        f.seek(at)
        rest = b""
        while at < span.end:
            block = f.read(BATCH_BYTES)
            lines = rest + block
            last = len(lines) if not block else lines.rfind(b"\n") + 1
            if at + last > span.end:  # the line that holds the last byte of the span ends it
                stop = lines.find(b"\n", span.end - at - 1)
                last = stop + 1 if stop >= 0 else last if not block else 0
            if last:
                yield at, lines[:last]
            at, rest = at + last, lines[last:]
            if not block:
                return


def _double(text: pa.Array) -> pa.Array:
    return pc.cast(pc.utf8_lower(pc.replace_substring_regex(text, r"^\+", "")), pa.float64())


def _index(text: pa.Array) -> pa.Array:
    return pc.subtract(pc.cast(text, pa.int64()), 1)


def _parsed(span: Span, at: int, lines: bytes, schema: pa.Schema) -> pa.RecordBatch:
    head = span.head
    raw = lines.split(b"\n")
    sizes = pa.array([len(x) + 1 for x in raw], pa.int64())
    starts = pc.add(pc.subtract(pc.cumulative_sum(sizes), sizes), at)
    text = pa.array(lines.decode("utf-8", "replace").split("\n"), pa.string())
    full = pc.not_equal(pc.utf8_trim_whitespace(text), "")
    text, starts = text.filter(full), starts.filter(full)
    found = pc.extract_regex(text, LINE[head.field])
    if found.null_count:
        raise MatrixMarketError(f"malformed line: {text.filter(pc.is_null(found))[0].as_py()!r}")
    part = lambda name: pc.struct_field(found, name)
    try:
        i, j = _index(part("i")), _index(part("j"))
        values = [pc.cast(part("x"), pa.int64())] if head.field == "integer" else [_double(part(n)) for n in ("xy" if head.field == "complex" else "x")]
    except pa.ArrowInvalid as error:
        raise MatrixMarketError(f"malformed line: {error}") from error
    outside = [pc.any(pc.or_(pc.less(k, 0), pc.greater_equal(k, n))).as_py() for k, n in ((i, head.rows), (j, head.cols))]
    if any(outside):
        raise MatrixMarketError("an index is outside the shape")
    keep = pc.not_equal(values[0], 0) if len(values) == 1 else pc.or_(pc.not_equal(values[0], 0), pc.not_equal(values[1], 0))
    i, j, starts, *values = (c.filter(keep) for c in (i, j, starts, *values))
    if head.symmetric:
        off = pc.not_equal(i, j)
        i, j = pa.concat_arrays([i, j.filter(off)]), pa.concat_arrays([j, i.filter(off)])
        starts, *values = (pa.concat_arrays([c, c.filter(off)]) for c in (starts, *values))
    val = values[0] if len(values) == 1 else pa.StructArray.from_arrays(values, fields=list(schema.field("val").type))
    n = len(i)
    return pa.RecordBatch.from_arrays([pa.repeat(span.name, n), pa.repeat(pa.scalar(span.number, pa.int32()), n), starts, i, j, val], schema=schema)


class Reader(DataSourceReader):
    def __init__(self, field: str, spans: list[Span]):
        self.field, self.spans = field, spans

    def partitions(self) -> list[Span]:
        return self.spans

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # no entries at all
            return
        value = {"integer": pa.int64(), "real": pa.float64(), "complex": pa.struct([("re", pa.float64()), ("im", pa.float64())])}[self.field]
        schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("row", pa.int64()), ("col", pa.int64()), ("val", value)])
        for at, lines in _batches(span, _system(span.root)[0]):
            yield _parsed(span, at, lines, schema)


class MatrixMarketSource(DataSource):
    """Options: ``path``; ``corpus`` for one matrix a file, all of one field; ``rangeBytes`` for the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _plan(self) -> list[tuple[str, Head, list[Span]]]:
        found = plan(self.options["path"], self.options.get("corpus", "false").lower() == "true", int(self.options.get("rangeBytes", RANGE_BYTES)))
        if len({head.field for _, head, _ in found}) > 1:
            raise MatrixMarketError("the files of a corpus have different fields")
        return found

    def schema(self) -> str:
        return f"file string, part int, at bigint, row bigint, col bigint, val {KIND[self._plan()[0][1].field].type}"

    def reader(self, schema) -> Reader:
        found = self._plan()
        return Reader(found[0][1].field, [s for _, _, spans in found for s in spans])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixMarketSource)


def _last(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.max_by("val", F.struct("part", "at")).alias("val"))


def read(spark: SparkSession, path: str) -> SparseMatrix:
    """The matrix at ``path``, as ``matrix_market.read`` gives it, with one scan of the entries, when they are asked for.

    What is wrong with the header is raised here, what is wrong with an entry by the job that reads it."""
    [(_, head, _)] = plan(path)
    register(spark)
    return SparseMatrix(_last(spark.read.format(FORMAT).load(path), "row", "col"), head.rows, head.cols, KIND[head.field])


def read_corpus(spark: SparkSession, folder: str) -> Corpus:
    """All files right below ``folder``, a matrix each and of one field, with one scan of their entries."""
    found = plan(folder, corpus=True)
    heads = [(name, head.rows, head.cols) for name, head, _ in found]
    register(spark)
    entries = _last(spark.read.format(FORMAT).option("corpus", True).load(folder), "file", "row", "col")
    return Corpus(entries, spark.createDataFrame(heads, "file string, rows bigint, cols bigint"), KIND[found[0][1].field])
