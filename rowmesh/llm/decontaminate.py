"""Benchmark decontamination with SimHash over item-sized windows.

Every text is read in windows of as many words as a benchmark item has. A window's SimHash over its five-word shingles
is looked up among the items of its size by multi-index blocks: 64 bits make eight blocks of eight, and fingerprints
within ``radius`` bits agree in some block up to radius / 8 bits. Each block has the items in the order of its value, so
the values near the window's are ranges of that order, and no item within the radius is missed. Candidates within the
radius are verified by their exact weighted-shingle similarity: shared over united shingles, weighted by how often each
occurs.

Windows that cannot reach the similarity are left out first, without loss. A window and an item of n shingles each that
are similar by s share 2 n s / (1 + s) shingles, so a window in which fewer stand in any item needs no fingerprint. An
item of n shingles shares at least s n of them with whatever is similar, so one of its n - s n + 1 rarest at least: items
none of whose rarest stand in a stretch are no candidates there. A text shorter than an item is one window as a whole,
held by the bounds for unequal sizes and the exact check alone.

Items are dealt with in blocks of bounded size, each broadcast; a larger benchmark takes more passes. What a worker
holds grows with the words of a block and not with the square of anything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SIMILARITY = 0.8
#: Similar windows differ in 10 of 64 bits on average (standard deviation 3), so 24 leaves none out in practice.
RADIUS = 24
#: A block of items has at most so many words in all.
BLOCK_WORDS = 2_000_000
#: Windows fingerprinted at once, and pairs of window and item compared at once.
CHUNK = 20_000
PAIRS = 500_000
CACHE = 500_000

EDGES = re.compile(r"^\W+|\W+$")


def words_of(text: str | None) -> list[str]:
    """Lower-cased, blank-separated words without marks at their edges."""
    return [w for w in (EDGES.sub("", x) for x in (text or "").lower().split()) if w]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on unsigned 64-bit integers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word numbers."""
    n = len(ids) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = mixed(out ^ ids[j : j + n].astype(np.uint64))
    return out


def simhashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each window of ``n`` shingles; a shingle that occurs twice counts twice."""
    low, high = int(starts[0]), int(starts[-1]) + n
    bits = np.unpackbits(hashes[low:high].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((high - low + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[starts - low + n] - sums[starts - low]
    return np.packbits(2 * ones > n, axis=1).view(">u8").ravel().astype(np.uint64)


def word_number(word: str) -> int:
    """A number above zero of the word alone, so that fingerprints do not depend on the order of the items."""
    return (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1) or 1


class Group:
    """The items of one size."""

    def __init__(self, size: int, k: int, items: list[tuple[int, np.ndarray]], counts: dict[int, int], similarity: float, radius: int):
        self.size, self.k, self.n = size, k, size - k + 1
        self.keys = [key for key, _ in items]
        self.bags = [Counter(h.tolist()) for _, h in items]
        self.prints = np.concatenate([simhashes(h, np.array([0]), len(h)) for _, h in items])
        # rarest shingles: sorted, with the items that each is of
        rare = self.n - ceil(similarity * self.n - 1e-9) + 1
        pairs = [(x, i) for i, bag in enumerate(self.bags) for x in set(sorted(bag.elements(), key=lambda x: (counts[x], x))[:rare])]
        pairs.sort()
        shingle, self.rare_items = np.array([x for x, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)
        self.rare, first = np.unique(shingle, return_index=True)
        self.rare_starts = np.r_[first, len(shingle)]
        # blocks: the items in the order of each block's value, and where each value begins
        self.values = self.prints.astype(">u8").view(np.uint8).reshape(-1, 8)
        self.order = np.argsort(self.values, axis=0, kind="stable").astype(np.int32)
        self.starts = np.stack([np.searchsorted(np.sort(self.values[:, b]), np.arange(257)) for b in range(8)])
        self.radius, self.most = radius, radius // 8
        self.masks = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= self.most).astype(np.uint8)

    def with_rare(self, hashes: np.ndarray) -> np.ndarray:
        """Which items have one of their rarest shingles among ``hashes``."""
        at = np.minimum(np.searchsorted(self.rare, hashes), len(self.rare) - 1)
        at = np.unique(at[self.rare[at] == hashes])
        found = np.zeros(len(self.keys), bool)
        found[self.rare_items[spread(self.rare_starts[at], self.rare_starts[at + 1])[1]]] = True
        return found

    def near(self, prints: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, item, differing bits) of all fingerprints within the radius of ``prints`` among the ``wanted`` items."""
        values = prints.astype(">u8").view(np.uint8).reshape(-1, 8)
        step = max(1, PAIRS // len(self.keys))
        for low in range(0, len(prints), step):
            for b in range(8):
                value = (values[low : low + step, b, None] ^ self.masks[None, :]).ravel().astype(np.int64)
                row, place = spread(self.starts[b][value], self.starts[b][value + 1])
                w, i = low + row // len(self.masks), self.order[place, b]
                w, i = w[wanted[i]], i[wanted[i]]
                apart = np.bitwise_count(values[w] ^ self.values[i])
                first = (apart[:, :b] > self.most).all(axis=1)  # an earlier block has given the pair already
                total = apart.sum(axis=1)
                hit = first & (total <= self.radius)
                yield w[hit], i[hit], total[hit]


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the number of its range and the place, for each place in any of them."""
    sizes = ends - starts
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Items:
    """A block of benchmark items, laid out for look-up."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity = similarity
        self.vocabulary: dict[str, int] = {}
        by_size: dict[int, list] = {}
        for key, text in items:
            words = words_of(text)
            if words:
                ids = np.array([self.vocabulary.setdefault(w, word_number(w)) for w in words], np.int64)
                by_size.setdefault(len(ids), []).append((key, shingles(ids, min(shingle, len(ids)))))
        counts: dict[int, Counter] = {}  # items that a shingle is in, by its length
        for size, group in by_size.items():
            counts.setdefault(min(shingle, size), Counter()).update(x for _, h in group for x in set(h.tolist()))
        self.groups = [Group(size, min(shingle, size), group, counts[min(shingle, size)], similarity, radius) for size, group in sorted(by_size.items())]
        self.known = {k: np.array(sorted(c), np.uint64) for k, c in counts.items()}

    def shared(self, m: int, n: int) -> int:
        """Shingles that a window of ``m`` and an item of ``n`` share at least if they are similar."""
        return ceil((m + n) * self.similarity / (1 + self.similarity) - 1e-9)

    def find(self, ids: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, differing bits): the best window of each item in a text of word numbers,
        and the first of several."""
        best: dict[int, tuple] = {}
        hashes, inside = {}, {}
        for k, known in self.known.items():
            if len(ids) >= k:
                # a shingle with a word that no item has is in none; few are left to hash
                unknown = np.r_[0, np.cumsum(ids == 0)]
                whole = np.flatnonzero(unknown[k:] == unknown[:-k])
                hit = np.zeros(len(ids) - k + 1, bool)
                if len(whole):
                    h = np.zeros(len(whole), np.uint64)
                    for j in range(k):
                        h = mixed(h ^ ids[whole + j].astype(np.uint64))
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit[whole] = known[at] == h
                if hit.any():
                    hashes[k], inside[k] = None, np.r_[0, np.cumsum(hit)]

        def verify(group: Group, i: int, start: int, m: int, apart: int) -> None:
            both = sum((Counter(hashes[group.k][start : start + m].tolist()) & group.bags[i]).values())
            key, similar = group.keys[i], both / (m + group.n - both)
            if similar >= self.similarity and (key not in best or (-similar, start) < (-best[key][3], best[key][1])):
                best[key] = (key, start, min(group.size, len(ids)), similar, apart)

        for group in self.groups:
            n, k = group.n, group.k
            if k not in inside:
                continue
            if len(ids) < group.size:  # the whole text is the one window
                m = len(ids) - k + 1
                if inside[k][-1] < self.shared(m, n):
                    continue
                if hashes[k] is None:
                    hashes[k] = shingles(ids, k)
                print_ = simhashes(hashes[k], np.array([0]), m)[0]
                for i in np.flatnonzero(group.with_rare(hashes[k])).tolist():
                    verify(group, i, 0, m, int(np.bitwise_count(print_ ^ group.prints[i])))
                continue
            held = inside[k][n:] - inside[k][:-n]
            starts = np.flatnonzero(held >= self.shared(n, n))
            if not len(starts):
                continue
            if hashes[k] is None:
                hashes[k] = shingles(ids, k)
            cuts = np.flatnonzero((np.diff(starts) > n) | (np.arange(1, len(starts)) % CHUNK == 0)) + 1
            for run in np.split(starts, cuts):
                wanted = group.with_rare(hashes[k][run[0] : run[-1] + n])
                if wanted.any():
                    for w, i, apart in group.near(simhashes(hashes[k], run, n), wanted):
                        for pair in zip(i.tolist(), run[w].tolist(), apart.tolist(), strict=True):
                            verify(group, pair[0], pair[1], n, pair[2])
        return sorted(best.values(), key=lambda x: x[0])


class Numbers(dict):
    """Number of each blank-separated, lower-cased token: of the word in it, 0 for an unknown word, -1 for no word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        bare = EDGES.sub("", token)
        got = self[token] = self.vocabulary.get(bare, 0) if bare else -1
        return got


def numbered(text: str | None, numbers: Numbers) -> np.ndarray:
    tokens = (text or "").lower().split()
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    return ids[ids >= 0]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """The items in blocks that each fit the bound; more items make more blocks. Null ids and texts without words are left out."""
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("trim(text) <> ''").distinct()
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, ceil(words / block_words))
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i) if blocks > 1 else rows
        yield [(r.id, r.text) for r in part.toLocalIterator()]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item_id, first_word, words, similarity, bits): the best window of every item in every row that has one.

    Positions count words that hold more than marks. Null and empty texts and items match nothing. Rows that repeat an id
    are searched each by its own text; equal items are found each under its id. Of windows that tie, the first counts.
    Without items the result is empty."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    item_kind = benchmark.select(item_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, first_word bigint, words bigint, similarity double, bits int"
    rows, out = docs.select(F.col(id_col).alias("id"), text_col), []
    for block in item_blocks(benchmark, item_col, item_text, block_words):
        out.append(rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(Items(block, similarity=similarity, radius=radius))), schema))
    return reduce(DataFrame.union, out)


def _search(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        numbers = Numbers(items.vocabulary)
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(1)):
                hits = items.find(numbered(text.as_py(), numbers))
                at += [i] * len(hits)
                found += hits
            columns = list(zip(*found, strict=True)) or [()] * 5
            names = ["id", "item_id", "first_word", "words", "similarity", "bits"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True))], names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, in one narrow pass for each block of items."""
    place = docs.columns.index(text_col)

    def without(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shipped.value
            numbers = Numbers(items.vocabulary)
            for b in batches:
                yield b.filter(pa.array([not items.find(numbered(t.as_py(), numbers)) for t in b.column(place)], pa.bool_()))

        return run

    for block in item_blocks(benchmark, item_col, item_text):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(Items(block))), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the benchmark items in every document."""
    found = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
