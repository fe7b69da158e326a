"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a word of the perfect binary
Golay code (23, 12, 7). A word's *indices* are the codewords to which it and its one-bit neighbours decode: one or six.
Two fingerprints at three or fewer differing bits have, by pigeonhole, two segments with at most one error each. For
that pair of segments, let x emit (an index of its first segment, the own index of its second) and (the own index of
its first, an index of its second): then x and y share a key. So every pair within the radius meets in some bucket;
each bucket verifies the real distance and returns links that span its groups, never all pairs.

A bucket beyond ``bucket_limit`` members is dealt out by its third segment, which holds three errors at most: one of its
four parts is free of them. What is dense even then is not compared pair by pair. Its members go to an exact way whose
work is linear in their number. For a radius of r each emits all points within b = ceil(r / 2) bits of it: two members
within r share a point within a = floor(r / 2) bits of one and b of the other, and all that share a point are within r of
any member within a bits of it, so one link to the smallest such member keeps every connection.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 3
RADIUS = 3
BUCKET_LIMIT = 4096
#: (lowest bit, bits) of each segment, and the pairs of segments that make keys.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 without words.

    ``bytes.lower`` and ``bytes.split`` touch just A-Z and the six ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n).astype(">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [text_fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, fp bigint")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each of the 4,096 messages, and the message part of the error that each of 2,048 syndromes stands for."""

    def rest(word: int) -> int:
        for shift in range(22, 10, -1):
            if word >> shift & 1:
                word ^= GENERATOR << (shift - 11)
        return word

    parity = np.array([rest(m << 11) for m in range(4096)], np.uint32)
    error = np.zeros(2048, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            error[parity[word >> 11] ^ (word & 2047)] = word >> 11
    return parity, error


def segment_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """Codeword index of each segment word, then those of its ``bits`` one-bit neighbours: one column each."""
    parity, error = golay()
    message = words >> np.uint32(11)
    syndrome = parity[message] ^ (words & np.uint32(2047))
    flips = np.array([0, *(1 << b for b in range(bits))], np.uint32)
    moved = parity[flips >> np.uint32(11)] ^ (flips & np.uint32(2047))
    return (message[:, None] ^ (flips >> np.uint32(11))[None, :]) ^ error[syndrome[:, None] ^ moved[None, :]]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fp``, key) for all keys of all fingerprints, without repeats."""
    fp = fp.astype(np.uint64)
    own, distinct = [], []
    for low, bits in SEGMENTS:
        index = segment_indices(((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32), bits).astype(np.int64)
        own.append(index[:, 0])
        index = np.sort(index, axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        distinct.append((index, first))
    rows, keys = [], []
    for p, (a, b) in enumerate(PAIRS):
        (ia, fa), (ib, fb) = distinct[a], distinct[b]
        r, c = np.nonzero(fa)
        rows.append(r)
        keys.append((p << 24) | (ia[r, c] << 12) | own[b][r])
        r, c = np.nonzero(fb & (ib != own[b][:, None]))  # with both own indices the key is there already
        rows.append(r)
        keys.append((p << 24) | (own[a][r] << 12) | ib[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 4096):
            part = fp[i : i + 4096]
            rows, keys = bucket_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


def spanning_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``radius`` bits among one bucket's members, one less than members at most."""
    left, links = fp, []
    while len(left) > 1:
        root, left = left[0], left[1:]
        wave = [root]
        while wave and len(left):
            near = np.bitwise_count(left ^ wave.pop()) <= radius
            if near.any():
                wave += list(left[near])
                links += [(int(root), int(x)) for x in left[near]]
                left = left[~near]
    return links


def verified_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of sorted ``key``; small buckets are compared by shifts of the whole array."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat(sizes, sizes) <= 16
    a, b = [], []
    for s in range(1, int(sizes[sizes <= 16].max(initial=1))):
        hit = (key[s:] == key[:-s]) & small[s:] & (np.bitwise_count(fp[s:] ^ fp[:-s]) <= radius)
        a.append(fp[:-s][hit])
        b.append(fp[s:][hit])
    for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        links = spanning_links(fp[start : start + size], radius)
        a.append(np.array([x for x, _ in links], np.uint64))
        b.append(np.array([y for _, y in links], np.uint64))
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _verify(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            a, b = verified_links(k, f, radius)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).astype(np.uint64) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy(zero_copy_only=False)]
            fp = np.r_[fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if len(key):
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
                yield out(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield out(key, fp)

    return run


def _sub_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four keys in place of each: the key, and one part of the segment that it leaves out."""
    left_out = np.array([SEGMENTS[3 - a - b] for a, b in PAIRS], np.uint64)
    for batch in batches:
        key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        low, bits = left_out[key >> 24].T
        parts = [(bits * np.uint64(i)) // np.uint64(4) for i in range(5)]
        value = [(fp.view(np.uint64) >> (low + start)) & ((np.uint64(1) << (end - start)) - np.uint64(1)) for start, end in zip(parts, parts[1:], strict=False)]
        sub = np.concatenate([(key << 8) | (i << 6) | v.astype(np.int64) for i, v in enumerate(value)])
        yield pa.RecordBatch.from_arrays([pa.array(sub), pa.array(np.tile(fp, 4))], ["key", "fp"])


def _points(flips: list[int], near: int):
    flips = np.array(flips, np.uint64)
    close = np.arange(len(flips)) < near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 32):
                part = fp[i : i + 32]
                point = (part[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(point.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(np.tile(close, len(part)))], ["point", "fp", "close"])

    return run


def dense_links(members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links that keep all connections within ``radius`` bits among ``members(fp)``, through shared points instead of pairs.

    Fingerprints are distinct, so no more than 2,081 share a point, and a window over them stays small."""
    if radius == 0:
        return members.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    rings = [[0], [1 << i for i in range(64)], [1 << i | 1 << j for i, j in combinations(range(64), 2)]]
    near, far = radius // 2, radius - radius // 2
    points = members.mapInArrow(_points([x for ring in rings[: far + 1] for x in ring], sum(map(len, rings[: near + 1]))), "point bigint, fp bigint, close boolean")
    centre = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("point"))
    return points.select(centre.alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()


def _crowded(keys: DataFrame, bucket_limit: int) -> DataFrame:
    return common.stored(keys.groupBy("key").count().where(F.col("count") > bucket_limit).select("key"), "dense-keys")


def fingerprint_links(distinct_fp: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within ``radius`` (3 at most) bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the keys guarantee three differing bits at most")
    verified = lambda keys: keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(radius), "a bigint, b bigint")
    keys = distinct_fp.select("fp").mapInArrow(_emit_keys, "key bigint, fp bigint")
    dense = _crowded(keys, bucket_limit)
    if dense.isEmpty():
        return verified(keys).distinct()
    links = verified(keys.join(dense, "key", "left_anti"))
    keys = common.stored(keys.join(dense, "key", "left_semi").mapInArrow(_sub_keys, "key bigint, fp bigint"), "sub-keys")
    dense = _crowded(keys, bucket_limit)
    links = links.union(verified(keys.join(dense, "key", "left_anti")))
    return links.union(dense_links(keys.join(dense, "key", "left_semi").select("fp").distinct(), radius)).distinct()


def labels(marked: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(fp, node, component) of the distinct fingerprints of ``marked(id, fp)``: node is the smallest fingerprint that is
    reachable, component the smallest id that has one of those."""
    prints = common.stored(marked.groupBy("fp").agg(F.min("id").alias("smallest")), "distinct-fingerprints")
    groups = common.components(fingerprint_links(prints, radius, bucket_limit)).select(F.col("node").alias("fp"), F.col("component").alias("node"))
    linked = common.stored(prints.join(groups, "fp"), "linked-fingerprints")
    least = common.stored(linked.groupBy("node").agg(F.min("smallest").alias("component")), "least-ids")
    moved = linked.join(least, "node").select("fp", "node", "component")
    found = prints.join(moved, "fp", "left").select("fp", F.coalesce("node", "fp").alias("node"), F.when(F.col("node").isNull(), F.col("smallest")).otherwise(F.col("component")).alias("component"))
    # stored, so that both sides of the next join are plain shuffles and the partition of a much-copied text can be split
    return common.stored(found, "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(id, fp, component) of every row: component is the smallest id reachable over links of ``radius`` differing bits.

    Rows without words have the fingerprint zero and link like any other. Exact copies and other equal fingerprints
    meet in one aggregate before any bucket is made, so a group of copies costs one fingerprint. Repeated rows are
    returned as often as they came. A null id is never the smallest; a group of null ids only has a null component.
    An empty table gives an empty result; further columns are ignored."""
    marked = common.stored(fingerprints(docs, id_col, text_col), "fingerprints")
    return marked.join(labels(marked, radius, bucket_limit).select("fp", "component"), "fp").select("id", "fp", "component")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of the smallest id, null being the largest of all.

    Rows that share an id belong each to the group of its own text; of several rows of a group's smallest id one is left,
    and of equal rows one is. Null and empty texts are one group. An empty table gives an empty result."""
    key = common.row_key(*(docs[c] for c in docs.columns))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*key).alias("key"))
    marked = common.stored(fingerprints(rows.select(F.struct("id", "key").alias("id"), "text"), "id", "text").select("id.id", "id.key", "fp"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key")))["key"]
    kept = marked.join(labels(marked, radius, bucket_limit).select("fp", "node"), "fp").groupBy("node").agg(first.alias("key")).select("key.row_a", "key.row_b")
    # equal rows meet in an aggregate, which leaves one of each task's before the shuffle
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *key).groupBy("row_a", "row_b").agg(F.first("row").alias("row"))
    return whole.join(kept, ["row_a", "row_b"], "left_semi").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprints and near-duplicate components of all documents."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
