"""Fingerprints of matrices: sums of hashes of their elements, whatever their order and partitions.

As the sum is a homomorphism, the fingerprint of a union of disjoint entries is the sum of theirs, and writing an element
takes its old hash away and adds the new one. Zeros count nothing, so absence and explicit zeros are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Kind

SEEDS = (0x5EED, 0xF1A6)
#: Hashes are summed in pieces of so many bits, which stay within 64 bits for 2^47 entries.
PIECE = 16
MODULUS = 1 << 128


@dataclass(frozen=True)
class Fingerprint:
    """``value`` modulo 2^128, and the numbers of elements other than zero and of NaN among them."""

    value: int
    elements: int
    nans: int

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint((self.value + other.value) % MODULUS, self.elements + other.elements, self.nans + other.nans)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint((self.value - other.value) % MODULUS, self.elements - other.elements, self.nans - other.nans)


def family(kind: Kind) -> str:
    """Kinds of one family have the same hashes for equal values."""
    return kind.name if kind.name in ("double", "complex") else "integer"


def _hashed(kind: Kind) -> list[Column]:
    """The columns that stand for a value; -0.0 is 0.0."""
    plain = lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)
    if kind.name == "complex":
        return [plain(F.col("val.re")), plain(F.col("val.im"))]
    return [plain(F.col("val"))] if kind.name == "double" else [F.col("val").cast("long")]


def of(entries: DataFrame, kind: Kind) -> Fingerprint:
    """The fingerprint of ``entries(row, col, val)`` with unique cells, by one aggregate with partial sums and no shuffle of
    entries."""
    hashes = [F.xxhash64(F.lit(seed), F.col("row").cast("long"), F.col("col").cast("long"), *_hashed(kind)) for seed in SEEDS]
    piece = lambda h, i: F.shiftrightunsigned(h, PIECE * i).bitwiseAND(F.lit((1 << PIECE) - 1).cast("long"))
    sums = [F.sum(piece(F.col(f"h{n}"), i)).alias(f"h{n}_{i}") for n in range(2) for i in range(64 // PIECE)]
    hashed = entries.where(~kind.is_zero(F.col("val"))).select(*(h.alias(f"h{n}") for n, h in enumerate(hashes)), kind.is_nan(F.col("val")).alias("nan"))
    got = hashed.agg(*sums, F.count("*").alias("n"), F.count_if("nan").alias("nans")).first()
    value = sum((got[f"h{n}_{i}"] or 0) << (64 * n + PIECE * i) for n in range(2) for i in range(64 // PIECE))
    return Fingerprint(value % MODULUS, got["n"], got["nans"])
