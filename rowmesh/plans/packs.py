"""Large products, with each entry of either side in the shuffle once, however many rows of the result it is needed for.

Neighbouring rows of A form strips of about ``TASK_FLOPS`` scalar products, as in ``strips``. B is sorted by the inner index and
packed, some ``PACK`` entries to a record with an offset for each index, and the records are shuffled once. A task
has the entries of one strip and reads past all records, or those of one strip of columns, so what is copied is read and not
written: disk is linear in the entries, and memory is that of a strip's cells. Reading grows with the number of strips.

The pairing of strips and records is a join that replicates neither side (``shuffle_replicate_nl``); scalar products are
made and summed by NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import WRAP8, Kind
from . import sized, strips

#: Scalar products from which on a product goes by packs, and those of a strip.
LEAST_FLOPS = 16_000_000
TASK_FLOPS = 8_000_000
#: Entries of a record, about; a record has the indexes of one block.
PACK = 200_000
MOST_WIDTH = 1 << 18
#: Rows of a batch that a task gives out.
BATCH = 200_000
#: Scalar products that are sorted at once.
BAND = 1_000_000
#: A strip whose rows and columns have at most so many cells for each scalar product is summed in place.
DENSE = 2

_INTS = (np.int8, np.int16, np.int32, np.int64)
_FLOATS = (np.float32, np.float64)


def _fields(kind: Kind) -> list[str]:
    return ["val.re", "val.im"] if kind.name == "complex" else ["val"]


def _narrow(v: np.ndarray) -> bytes:
    """The bytes of ``v`` in the smallest type that holds all of it; the size of an element tells which."""
    if v.dtype.kind == "f":
        with np.errstate(over="ignore"):
            small = v.astype(np.float32)
        return (small if ((small == v) | np.isnan(v)).all() else v).tobytes()
    return v.astype(next(t for t in _INTS if np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)).tobytes()


def _wide(data: bytes, n: int, real: bool) -> np.ndarray:
    return np.frombuffer(data, {np.dtype(t).itemsize: t for t in (_FLOATS if real else _INTS)}[len(data) // n])


def _pack(width: int, values: int, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of entries that come in the order of c, the strip of columns, and k."""

        def starts(t: pa.Table) -> np.ndarray:
            c, block = t["c"].to_numpy(), t["k"].to_numpy() // width
            return np.append(0, np.flatnonzero((np.diff(c) != 0) | (np.diff(block) != 0)) + 1)

        def records(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c, k, j = (t[n].to_numpy() for n in ("c", "k", "j"))
            ends = np.append(starts(t), len(k))
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                block, first = int(k[low]) // width, int(j[low:high].min())
                offsets = np.searchsorted(k[low:high], np.arange(width + 1) + block * width).astype(np.uint32)
                data = [_narrow(t[f"y{v}"].to_numpy()[low:high]) for v in range(values)]
                arrays = [pa.array([int(x)], pa.int64()) for x in (c[low], block, first)] + [pa.array([x], pa.binary()) for x in (offsets.tobytes(), _narrow(j[low:high] - first), *data)]
                yield pa.RecordBatch.from_arrays(arrays, ["c", "kb", "j0", "offsets", "js", *(f"ys{v}" for v in range(values))])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:  # a block is closed when the next one begins, or when it has enough for a record
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n < size:
                    continue
                t = pa.Table.from_batches(held)
                last = int(starts(t)[-1]) or n  # the last block may go on, unless it is all there is
                yield from records(t.slice(0, last))
                held, n = t.slice(last).to_batches(), n - last
        if n:
            yield from records(pa.Table.from_batches(held))

    return pack


class _Strip:
    """The cells of one strip: scalar products are kept as they come and summed at the end, or added up in place if the strip is
    ``dense``. Where 64-bit integers may not fit, Python's are taken."""

    def __init__(self, kind: Kind, low: int, high: int, cols: int, dense: bool):
        self.kind, self.low, self.cols = kind, low, cols
        self.real, self.values = kind.name in ("double", "complex"), len(_fields(kind))
        self.keys: list[np.ndarray] = []
        self.sums: list[list[np.ndarray]] = [[] for _ in range(self.values)]
        self.x_most = self.y_most = self.terms = 0
        self.grid = None
        if dense:
            self.grid = [np.zeros((high - low + 1) * cols, float if self.real else np.int64) for _ in range(self.values)]
            self.met = np.zeros((high - low + 1) * cols, bool)

    def _products(self, x: list, y: list) -> list:
        if self.kind.name == "complex":
            return [x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0]]
        if self.unsure and np.abs(x[0] * y[0].astype(float)).max() >= 2**62:
            found = x[0].astype(object) * y[0].astype(object)
            _fits(found)
            return [found.astype(np.int64)]
        return [x[0] * y[0]]

    @property
    def unsure(self) -> bool:
        """Whether products or sums might not fit 64 bits."""
        return self.kind.name == "int64" and self.x_most * self.y_most * max(1, self.terms) >= 2**63

    def add(self, i: np.ndarray, start: np.ndarray, n: np.ndarray, x: list[np.ndarray], j: np.ndarray, y: list[np.ndarray], j0: int) -> None:
        """Rows ``i`` with values ``x`` meet the ``n`` entries ``j``, ``y`` of the record from ``start`` on."""
        if not self.real:
            self.x_most = max(self.x_most, abs(int(x[0].min())), abs(int(x[0].max())))
            self.y_most = max(self.y_most, 2 ** (8 * y[0].itemsize - 1) if y[0].itemsize < 8 else max(abs(int(y[0].min())), abs(int(y[0].max()))))
            self.terms += int(len(i))  # a cell has at most one term of each entry
        wide = np.float64 if self.real else np.int64
        if self.grid is not None and not self.unsure and n.mean() >= 64:
            for at in range(len(i)):
                s, e = start[at], start[at] + n[at]
                cell = (int(i[at]) - self.low) * self.cols + j0 + j[s:e].astype(np.int64)
                self.met[cell] = True
                for total, p in zip(self.grid, self._products([v[at] for v in x], [v[s:e].astype(wide) for v in y]), strict=True):
                    total[cell] += p  # the columns of a row of B differ
            return
        left = np.repeat(np.arange(len(i)), n)
        right = np.arange(len(left)) + np.repeat(start - (np.cumsum(n) - n), n)
        cell = (i[left] - self.low) * self.cols + (j[right].astype(np.int64) + j0)
        found = self._products([v[left] for v in x], [v[right].astype(wide) for v in y])
        if self.grid is not None and not self.unsure:
            self.met[cell] = True
            for total, p in zip(self.grid, found, strict=True):
                np.add.at(total, cell, p)
            return
        self.keys.append(cell)
        for kept, p in zip(self.sums, found, strict=True):
            kept.append(p if self.real or self.x_most * self.y_most >= 2**31 else p.astype(np.int32))

    def cells(self, band: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """The cells' keys, ascending, and their sums, in bands of whole rows with about ``band`` scalar products."""
        if self.grid is not None:
            for low in range(0, len(self.met), max(1, band // self.cols) * self.cols):
                key = np.flatnonzero(self.met[low : low + max(1, band // self.cols) * self.cols]) + low
                if self.keys:
                    self.keys.append(key)
                    for kept, total in zip(self.sums, self.grid, strict=True):
                        kept.append(total[key])
                elif len(key):
                    yield key, [total[key] for total in self.grid]
            self.grid = None
        if not self.keys:
            return
        n = sum(map(len, self.keys))
        some = np.sort(np.concatenate([k[::997] for k in self.keys]))
        cuts = np.unique(some[np.arange(1, max(1, n // band)) * len(some) // max(1, n // band)] // self.cols * self.cols)
        for low, high in zip(np.append(0, cuts), np.append(cuts, 2**63 - 1), strict=True):
            here = [np.flatnonzero((k >= low) & (k < high)) for k in self.keys]
            key = np.concatenate([k[at] for k, at in zip(self.keys, here, strict=True)])
            if not len(key):
                continue
            order = np.argsort(key)
            key = key[order]
            starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
            sums = []
            for kept in self.sums:
                p = np.concatenate([p[at] for p, at in zip(kept, here, strict=True)])[order]
                p = p if self.real else p.astype(np.int64)
                if self.unsure and np.add.reduceat(np.abs(p.astype(float)), starts).max() >= 2**62:
                    p = p.astype(object)
                sums.append(np.add.reduceat(p, starts))
                if p.dtype == object:
                    _fits(sums[-1])
            yield key[starts], sums


def _fits(v: np.ndarray) -> None:
    if len(v) and (v.max() >= 2**63 or v.min() < -(2**63)):
        raise OverflowError("[ARITHMETIC_OVERFLOW] a 64-bit integer of a product")


def _value(kind: Kind, sums: list[np.ndarray]) -> pa.Array:
    """Sums as the kind stores them."""
    if kind.name == "complex":
        return pa.StructArray.from_arrays([pa.array(s.astype(float)) for s in sums], ["re", "im"])
    if kind.name == "double":
        return pa.array(sums[0].astype(float))
    s = sums[0].astype(np.int64)
    return pa.array((((s + 128) & 255) - 128).astype(np.int8) if kind.name == "wrap8" else s)


def _cells(kind: Kind, cols: int, strip: _Strip, size: int, band: int) -> Iterator[pa.RecordBatch]:
    for key, sums in strip.cells(band):
        for at in range(0, len(key), size):
            k = key[at : at + size]
            yield pa.RecordBatch.from_arrays([pa.array(k // cols + strip.low), pa.array(k % cols), _value(kind, [s[at : at + size] for s in sums])], ["row", "col", "val"])


def _rows(kind: Kind, cols: int, strip: _Strip, size: int, band: int) -> Iterator[pa.RecordBatch]:
    for key, sums in strip.cells(band):
        row = key // cols
        starts = np.append(0, np.flatnonzero(np.diff(row)) + 1)
        ends = np.append(starts[1:], len(row))
        at = 0
        while at < len(ends):
            upto = max(at + 1, int(np.searchsorted(ends, starts[at] + size, "right")))
            low, high = starts[at], ends[upto - 1]
            offsets = pa.array(np.append(starts[at:upto], high) - low, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(key[low:high] % cols), _value(kind, [s[low:high] for s in sums]))]
            yield pa.RecordBatch.from_arrays([pa.array(row[starts[at:upto]] + strip.low), *lists], ["row", "indices", "vals"])
            at = upto


def _counts(kind: Kind, cols: int, strip: _Strip, size: int, band: int) -> Iterator[pa.RecordBatch]:
    for key, _ in strip.cells(band):
        row, n = np.unique(key // cols, return_counts=True)
        for at in range(0, len(row), size):
            yield pa.RecordBatch.from_arrays([pa.array(row[at : at + size] + strip.low), pa.array(n[at : at + size])], ["row", "nnz"])


def _task(kind: Kind, cols: int, width: int, spans: list[tuple[int, int]], dense: int, size: int, band: int, give):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one strip: records, and the strip's entries of the same block beside each of them."""
        found, values = None, len(_fields(kind))
        real, wide = kind.name in ("double", "complex"), np.float64 if kind.name in ("double", "complex") else np.int64
        with np.errstate(all="ignore"):
            for batch in batches:
                for at in range(batch.num_rows):
                    one = batch.slice(at, 1)
                    if found is None:
                        low, high = spans[one["part"][0].as_py()]
                        found = _Strip(kind, low, high, cols, (high - low + 1) * cols <= dense)
                    k, i = (one[n].flatten().to_numpy() for n in ("k", "i"))
                    x = [one[f"x{v}"].flatten().to_numpy().astype(wide) for v in range(values)]
                    k = k - one["kb"][0].as_py() * width
                    offsets = np.frombuffer(one["offsets"][0].as_buffer(), np.uint32).astype(np.int64)
                    start = offsets[k]
                    n = offsets[k + 1] - start
                    meets = n > 0
                    if not meets.all():
                        i, start, n, x = i[meets], start[meets], n[meets], [v[meets] for v in x]
                    if not len(i):
                        continue
                    entries = int(offsets[-1])
                    j = _wide(one["js"][0].as_buffer(), entries, False)
                    y = [_wide(one[f"ys{v}"][0].as_buffer(), entries, real) for v in range(values)]
                    found.add(i, start, n, x, j, y, one["j0"][0].as_py())
            if found is not None:
                yield from give(kind, cols, found, size, band)

    return task


def _streamed(left: DataFrame, b: DataFrame, kind: Kind, spans: list[tuple[int, int]], inner: int, cols: int, flops: int, give, schema: str, col_bounds: Sequence[int] = ()) -> DataFrame:
    """What ``give`` makes of the cells of each strip of ``left(part, k, i, x)`` times ``b(k, j, y)``; ``inner`` is the
    number of indexes k. ``spans`` has the first and last row of each part."""
    entries = b.count()
    width = max(1, min(MOST_WIDTH, ceil(inner * PACK / max(PACK, entries))))
    values = len(_fields(kind))
    apart = lambda name: [F.col(f.replace("val", name)).alias(f"{name}{v}") for v, f in enumerate(_fields(kind))]
    strip = sum(((F.col("j") >= bound).cast("long") for bound in col_bounds), F.lit(0).cast("long")).alias("c")
    sorted_b = b.select("k", "j", *apart("y")).repartitionByRange(max(1, ceil(entries / sized.PART_ROWS)), "k", "j").select(strip, "*").sortWithinPartitions("c", "k", "j")
    names = ", ".join(f"ys{v} binary" for v in range(values))
    packs = sorted_b.mapInArrow(_pack(width, values, PACK), f"c bigint, kb bigint, j0 bigint, offsets binary, js binary, {names}")
    packs = packs.repartitionById(len(col_bounds) + 1, F.col("c").cast("int")).drop("c")
    fields = F.struct("k", "i", *apart("x"))
    own = left.select(F.col("part").cast("int").alias("part"), F.floor(F.col("k") / width).cast("long").alias("b"), fields.alias("e"))
    own = own.repartitionById(len(spans), F.col("part")).groupBy("part", "b").agg(F.collect_list("e").alias("e"))
    own = own.select("part", "b", *(F.col(f"e.{n}").alias(n) for n in ("k", "i", *(f"x{v}" for v in range(values)))))
    dense = 2 * DENSE * TASK_FLOPS if (spans[-1][1] - spans[0][0] + 1) * cols <= DENSE * flops else 0
    both = packs.hint("shuffle_replicate_nl").join(own, F.col("kb") == F.col("b"))
    return both.mapInArrow(_task(kind, cols, width, spans, dense, BATCH, BAND, give), schema)


def cells(left: DataFrame, right: DataFrame, kind: Kind, spans: list[tuple[int, int]], shape: tuple[int, int], flops: int, col_bounds: Sequence[int] = ()) -> DataFrame:
    """(row, col, val) of the cells of each part of ``left(part, k, i, x)`` times ``right(k, j, y)``, of so many indexes k and
    columns; a part's ``spans`` are its first and last row."""
    return _streamed(left, right, kind, spans, *shape, flops, _cells, f"row bigint, col bigint, val {kind.type}", col_bounds)


def _side(b: DataFrame) -> DataFrame:
    return b.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("val").alias("y"))


def _spans(planned: strips.Strips) -> list[tuple[int, int]]:
    """The first and last row of each part, as groups come in their order."""
    found: list[tuple[int, int]] = [(0, 0)] * planned.parts
    seen = set()
    for g, first, n in planned.groups:
        for part in range(first, first + n):
            found[part] = (found[part][0] if part in seen else g * planned.width, (g + 1) * planned.width - 1)
            seen.add(part)
    return found


def _left(a: DataFrame, planned: strips.Strips) -> DataFrame:
    """Entries with the part of their strip; the inner indexes of a group that is cut are dealt over its parts."""
    at = F.col("first") + F.when(F.col("parts") > 1, F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).otherwise(0)
    left = a.select(F.col("row").alias("i"), F.col("col").alias("k"), F.col("val").alias("x"), planned.group(F.col("row")).alias("g"))
    return left.join(F.broadcast(planned.of), "g").select(at.cast("int").alias("part"), "k", "i", "x")


def plan(a: DataFrame, b: DataFrame, shape: tuple[int, int, int], least: int = 1) -> strips.Strips:
    """Strips for the product of ``shape``: rows, inner indexes, columns."""
    rows, inner, cols = shape
    return replace(strips.plan(a, b, rows, least, TASK_FLOPS), inner=inner, cols=cols)


def multiply(a: DataFrame, b: DataFrame, kind: Kind, planned: strips.Strips, col_bounds: Sequence[int] = ()) -> DataFrame:
    """(row, col, val) of the product. Only sums in groups that are cut are shuffled."""
    whole, cut = strips.sides(a, planned)
    spans = _spans(planned)
    product = lambda m: cells(_left(m, planned), _side(b), kind, spans, (planned.inner, planned.cols), planned.flops, col_bounds)
    found = product(whole)
    if cut is None:
        return found
    sums = product(cut).groupBy("row", "col").agg(kind.total(kind.work(F.col("val"))).alias("val"))
    return found.union(sums.select("row", "col", kind.settle(F.col("val")).alias("val")))


def grouped(a: DataFrame, b: DataFrame, kind: Kind, planned: strips.Strips) -> DataFrame:
    """(row, indices, vals) of the rows of the product that have entries, columns ascending, if no group is cut."""
    return _streamed(_left(a, planned), _side(b), kind, _spans(planned), planned.inner, planned.cols, planned.flops, _rows, f"row bigint, indices array<bigint>, vals array<{kind.type}>")


def fill(a: DataFrame, b: DataFrame, planned: strips.Strips) -> DataFrame:
    """(row, nnz) of the rows of the product that have entries."""
    ones = [m.select("row", "col", WRAP8.lit(1).alias("val")) for m in (a, b)]
    if planned.cut:
        return multiply(*ones, WRAP8, planned).groupBy("row").agg(F.count("*").alias("nnz"))
    return _streamed(_left(ones[0], planned), _side(ones[1]), WRAP8, _spans(planned), planned.inner, planned.cols, planned.flops, _counts, "row bigint, nnz bigint")
