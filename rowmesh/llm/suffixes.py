"""Repeated byte strings by a suffix array of the collection, built column by column.

Spark brings together what can be equal. Every string of ``LEAST`` bytes, a *window*, picks the smallest hash among its
``GRAM``-byte substrings as its anchor (the rightmost of equals), so equal windows pick equal anchors at equal places.
Neighbouring windows with one anchor are a *piece* of text; pieces whose anchor stands once in the corpus hold no repeat and
go no further. Equal pieces are counted and kept once, and all pieces of one anchor meet in one task.

There they are aligned at the anchor and sorted column by column, from the right: each round puts one symbol of every piece
in front of its suffix, and one stable sort by that symbol turns the order of the suffixes, which is the column of the
collection's Burrows-Wheeler transform, and their common prefixes into those of the next column. Suffixes that share
``LEAST`` bytes are neighbours then, and their windows are repeated. As equal windows stand in one column, suffixes of other
columns need not stay in the order: a round takes time for the pieces, not for all suffixes so far.

Texts that have copies are kept once with their number; of these, every window is repeated. An anchor with very many
different pieces is not left to one task: its windows are counted by their hashes, spread over all tasks. Whole texts are
never stored again, only the pieces whose anchor is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 200
GRAM = 64
#: Bytes that are hashed together; with what overlaps, less than 2 ** 21.
BUFFER = 1 << 17
#: Different pieces of one anchor that may meet in a task.
PIECES = 20_000
#: Bytes of the pieces that are sorted together, and of those of a task.
COLLECTION_BYTES = 1 << 20
TASK_BYTES = 8 << 20
#: A table of keys of at most so many bytes is broadcast; a larger one is joined by a shuffle, as texts always are.
BROADCAST_BYTES = 64 << 20
#: Of a row of it, as a broadcast holds it.
KEY_BYTES = 48
ROOT = 0x9E3779B97F4A7C15
LOW = (1 << 21) - 1


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, and a random number for each byte."""
    n = 4 * BUFFER
    up, down = np.full(n, ROOT, np.uint64), np.full(n, pow(ROOT, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(0).integers(0, 1 << 64, 256, np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each substring of ``gram`` bytes."""
    up, down, numbers = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, by minima to both sides within strips of that width."""
    n = len(values) - width + 1
    strips = np.full((-(-len(values) // width), width), np.iinfo(values.dtype).max, values.dtype)
    strips.ravel()[: len(values)] = values
    ahead = np.minimum.accumulate(strips, axis=1).ravel()
    behind = np.minimum.accumulate(strips[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces_of(data: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, place of the anchor in the piece, its hash) of the pieces of texts that stand one behind the other and end at ``ends``."""
    n = len(data) - least + 1
    h = gram_hashes(data, gram)
    order = (h & np.uint64(~LOW & 0xFFFFFFFFFFFFFFFF)) | (np.uint64(LOW) - np.arange(len(h), dtype=np.uint64))
    at = np.uint64(LOW) - (sliding_min(order, least - gram + 1) & np.uint64(LOW))
    start = np.arange(n)
    text = np.searchsorted(ends, start, "right")
    inside = start + least <= ends[text]
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]
    first = start[inside & np.r_[True, new[1:] | ~inside[:-1]]]
    count = np.diff(np.r_[np.flatnonzero(new[inside] | np.r_[True, np.diff(start[inside]) > 1]), inside.sum()])
    return first, count, at[first].astype(np.int64) - first, h[at[first]].view(np.int64)


def _anchors(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(x for *_, x in held), np.uint8)
            ends = np.cumsum([len(x) for *_, x in held])
            first, count, place, anchor = pieces_of(data, ends, least, gram)
            text = np.searchsorted(ends, first, "right")
            ta, tb, base = (np.array(column)[text] for column in list(zip(*held, strict=True))[:3])
            at = (base + first - np.r_[0, ends][text]) << 16 | place << 8 | (count - 1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ta, tb, at, anchor)], ["ta", "tb", "at", "anchor"])

        for batch in batches:
            for ta, tb, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = memoryview(text.as_buffer())
                for base in range(0, len(text) - least + 1, BUFFER):  # windows that start in this stretch
                    held.append((ta, tb, base, text[base : base + BUFFER + least - 1]))
                    size += len(held[-1][3])
                    if size >= BUFFER // 2:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return run


def columns(pieces: list[bytes], place: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols of all pieces column by column, 0 for none, aligned so that place ``place[i]`` of piece i is in the
    column that is returned too."""
    length = np.array([len(s) for s in pieces])
    left = int(place.max())
    wide = left + int((length - place).max())
    out = np.zeros((len(pieces), wide), np.uint16)
    start = np.cumsum(length) - length
    where = np.repeat(np.arange(len(pieces)) * wide + left - place - start, length) + np.arange(length.sum())
    out.ravel()[where] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    return np.ascontiguousarray(out.T), left


def insert(symbols: np.ndarray, group: np.ndarray, order: np.ndarray, common_bytes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the order of the suffixes that start one column further left, and the bytes that each shares with the one
    above it (``cap`` at most), from those of the suffixes behind.

    ``symbols`` has one symbol for each piece, and ``group`` the ascending group of each place of the order; suffixes of
    different groups share nothing, and those that have not begun or are over share nothing with any."""
    symbol = symbols[order]
    key = group * 257 + symbol
    moved = np.argsort(key, kind="stable")
    key, symbol = key[moved], symbol[moved]
    shared = np.zeros(len(order), np.int32)
    same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] > 0)) + 1
    old, above = moved[same], moved[same - 1]
    near = old == above + 1
    shared[same[near]] = common_bytes[old[near]] + 1
    if not near.all():  # of what lay between, all have other symbols; they share the least of it
        ranges = np.stack([above[~near] + 1, old[~near] + 1], 1).ravel()
        shared[same[~near]] = np.minimum.reduceat(np.append(common_bytes, 0), ranges)[::2] + 1
    return order[moved], np.minimum(shared, cap)


def repeated(pieces: list[bytes], place: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of the windows of ``least`` bytes that another piece of the same group holds in the same column;
    ``group`` ascends."""
    symbols, left = columns(pieces, place)
    order, shared = np.arange(len(pieces)), np.zeros(len(pieces), np.int32)
    found = np.zeros((len(pieces), len(symbols)), bool)
    for column in range(len(symbols) - 1, -1, -1):
        order, shared = insert(symbols[column], group, order, shared, least)
        hit = np.flatnonzero(shared >= least)
        found[order[hit], column] = found[order[hit - 1], column] = True
    piece, column = np.nonzero(found)
    return piece, column - (left - place[piece])


def stretches(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of the runs of neighbouring numbers in sorted ``places``."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > 1) + 1
    starts, ends = places[np.r_[0, cuts]], places[np.r_[cuts - 1, len(places) - 1]]
    return list(zip(starts.tolist(), (ends - starts + 1).tolist(), strict=True))


RANGES = "array<struct<first:bigint,n:bigint>>"
RANGES_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))


def _compared(least: int, collection_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None

        def out() -> pa.RecordBatch:
            _, sa, sb, place, pieces, copies = zip(*held, strict=True)
            group = np.cumsum([i > 0 and held[i][0] != held[i - 1][0] for i in range(len(held))])
            piece, start = repeated(pieces, np.array(place), group, least)
            bounds = np.searchsorted(piece, np.arange(len(held) + 1))
            ranges = [[(0, len(s) - least + 1)] if n > 1 else stretches(start[bounds[i] : bounds[i + 1]]) for i, (s, n) in enumerate(zip(pieces, copies, strict=True))]
            some = [i for i, r in enumerate(ranges) if r]
            listed = [[{"first": x, "n": n} for x, n in ranges[i]] for i in some]
            return pa.RecordBatch.from_arrays([pa.array([sa[i] for i in some], pa.int64()), pa.array([sb[i] for i in some], pa.int64()), pa.array(listed, RANGES_ARROW)], ["sa", "sb", "ranges"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= collection_bytes and row[0] != anchor:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size, anchor = size + len(row[4]), row[0]
        if held:
            yield out()

    return run


def _settled(least: int):
    """What is left of each text without the bytes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ta, tb, text, ranges in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), batch.column("text"), batch.column("windows"), strict=True):
                text, ranges = memoryview(text.as_buffer()), ranges.as_py()
                spans: list[list[int]] = []
                for r in ranges:
                    end = r["first"] + r["n"] - 1 + least
                    if spans and r["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([r["first"], end])
                digest, at = hashlib.sha256(), 0
                for start, end in spans:
                    digest.update(text[at:start])
                    at = end
                digest.update(text[at:])
                out.append((ta, tb, [{"first": a, "n": b - a} for a, b in spans], digest.hexdigest()))
            ta, tb, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ta, pa.int64()), pa.array(tb, pa.int64()), pa.array(spans, RANGES_ARROW), pa.array(sha, pa.string())], ["ta", "tb", "spans", "kept_sha256"])

    return run


def _sized(small: DataFrame) -> DataFrame:
    """``small``, marked for a broadcast if its rows are few enough; needs a count."""
    return F.broadcast(small) if small.count() * KEY_BYTES <= BROADCAST_BYTES else small


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, pieces: int = PIECES, collection_bytes: int = COLLECTION_BYTES) -> DataFrame:
    """(id, n_bytes, spans, kept_sha256) of each row: spans (first, n) are the runs of bytes that lie in a string of
    ``least`` bytes which also starts anywhere else in the table, and kept_sha256 is the digest of the others.

    Strings are judged on the table as it is, in bytes of UTF-8, and never cross rows. Null texts are empty; texts of fewer
    bytes than ``least`` keep all. Equal texts lose everything if they are long enough; rows that repeat are equal texts,
    whatever their ids. An empty table gives an empty result; further columns are ignored."""
    if not (1 <= gram <= least and least - gram < 255):
        raise ValueError("windows pick their anchors from 1 to 255 substrings")
    key = ["ta", "tb"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("ta"), F.xxhash64(F.lit("text"), "text").alias("tb"), F.octet_length("text").cast("long").alias("n_bytes"))
    facts = common.stored(rows.select("id", *key, "n_bytes", F.sha2("text", 256).alias("whole")), "text-digests")
    rows = rows.where(F.col("n_bytes") >= least)
    copied = facts.where(F.col("n_bytes") >= least).groupBy(*key).agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")).where("copies > 1")
    copied = common.stored(copied, "copied-texts")
    some = _sized(copied.select(*key, "copies"))
    once = rows.join(some, key, "left_semi").groupBy(*key).agg(F.first("text").alias("text")).join(some, key)
    once = common.stored(once.select(*key, "text", "copies"), "copied-once")
    texts = rows.join(some, key, "left_anti").select(*key, "text", F.lit(1).cast("long").alias("copies")).union(once)
    anchors = common.stored(texts.select(*key, "text").mapInArrow(_anchors(least, gram), "ta bigint, tb bigint, at bigint, anchor bigint"), "anchors")
    again = common.stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated-anchors")
    wanted = anchors.join(_sized(again), "anchor")
    lists = common.stored(wanted.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "anchor"))).alias("pieces")), "pieces-by-text")
    cut = texts.join(lists.hint("merge"), key).select(*key, "copies", "text", F.inline("pieces"))
    base, windows = F.shiftright("at", 16).alias("base"), F.col("at").bitwiseAND(255) + least
    cut = cut.select(*key, "copies", base, F.shiftright("at", 8).bitwiseAND(255).alias("place"), "anchor", F.substring("text", (base + 1).cast("int"), windows.cast("int")).alias("s"))
    cut = common.stored(cut.select("*", F.xxhash64("s").alias("sa"), F.xxhash64(F.lit("piece"), "s").alias("sb")), "pieces")
    kinds = cut.groupBy("anchor", "sa", "sb").agg(F.first(F.octet_length("s")).alias("bytes")).groupBy("anchor").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    kinds = common.stored(kinds, "pieces-by-anchor")
    size = kinds.agg(F.sum("bytes")).first()[0] or 0
    crowded = common.stored(kinds.where(F.col("n") > pieces).select("anchor"), "crowded-anchors")
    strings = cut.groupBy("sa", "sb").agg(F.first("anchor").alias("anchor"), F.first("place").alias("place"), F.first("s").alias("s"), F.sum("copies").alias("copies"))
    none = crowded.isEmpty()
    few = strings if none else strings.join(crowded, "anchor", "left_anti")
    few = few.select("anchor", "sa", "sb", "place", "s", "copies").repartition(max(1, ceil(size / TASK_BYTES)), "anchor").sortWithinPartitions("anchor", "sa", "sb")
    found = few.mapInArrow(_compared(least, collection_bytes), f"sa bigint, sb bigint, ranges {RANGES}")
    found = common.stored(found if none else found.union(_by_hash(strings.join(crowded, "anchor"), least)), "repeated-windows")
    hits = cut.select(*key, "base", "sa", "sb").join(found.hint("merge"), ["sa", "sb"]).select(*key, "base", F.inline("ranges"))
    hits = hits.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((F.col("base") + F.col("first")).alias("first"), "n"))).alias("windows"))
    hits = common.stored(hits.join(some, key, "left_anti"), "windows-by-text")
    left = rows.select(*key, "text").join(hits.hint("merge"), key).mapInArrow(_settled(least), f"ta bigint, tb bigint, spans {RANGES}, kept_sha256 string")
    gone = F.array(F.struct(F.lit(0).cast("long").alias("first"), "n_bytes").cast("struct<first:bigint,n:bigint>"))
    left = left.union(copied.select(*key, gone.alias("spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256")))
    left = common.stored(left, "texts-left")
    return facts.join(left, key, "left").select("id", "n_bytes", F.coalesce("spans", F.array().cast(RANGES)).alias("spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def _by_hash(strings: DataFrame, least: int) -> DataFrame:
    """The same for pieces of crowded anchors: windows by 128 bits of hash, counted before they are shuffled."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("s") - least)).alias("i")
    window = F.substring(F.col("s"), F.col("i") + 1, F.lit(least))
    windows = strings.select("sa", "sb", "s", "copies", at).select("sa", "sb", "i", "copies", F.xxhash64(window).alias("wa"), F.xxhash64(F.lit("window"), window).alias("wb"))
    many = common.stored(windows.groupBy("wa", "wb").agg(F.sum("copies").alias("n")).where("n > 1").select("wa", "wb"), "crowded-windows")
    one = F.struct(F.col("i").cast("long").alias("first"), F.lit(1).cast("long").alias("n"))
    return windows.join(many, ["wa", "wb"]).groupBy("sa", "sb").agg(F.sort_array(F.collect_list(one)).alias("ranges"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: bytes of every document, before and after, and the digest of what is kept."""
    found = repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
