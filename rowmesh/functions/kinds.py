"""Element kinds: what a matrix holds, and its arithmetic as column expressions.

A sum runs over *work* values, wide enough for the products of the kind; ``settle`` brings a sum back to the stored type.
Plain 64-bit integers raise on overflow. The wrapping kinds are rings modulo 2^8 and 2^64, so they may sum first and
wrap at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TWO_64 = "cast(18446744073709551616 as decimal(20,0))"
_TWO_63 = "cast(9223372036854775808 as decimal(20,0))"


@dataclass(frozen=True)
class Kind:
    name: str
    type: str

    def lit(self, value) -> Column:
        if self.name == "complex":
            value = complex(value)
            return F.struct(F.lit(value.real).alias("re"), F.lit(value.imag).alias("im"))
        return F.lit(value).cast(self.type)

    def is_zero(self, c: Column) -> Column:
        return (c["re"] == 0) & (c["im"] == 0) if self.name == "complex" else c == self.lit(0)

    def is_nan(self, c: Column) -> Column:
        if self.name == "complex":
            return F.isnan(c["re"]) | F.isnan(c["im"])
        return F.isnan(c) if self.name == "double" else F.lit(False)

    def work(self, c: Column) -> Column:
        return c.cast({"wrap8": "bigint", "wrap64": "decimal(19,0)"}[self.name]) if self.name in ("wrap8", "wrap64") else c

    def product(self, a: Column, b: Column) -> Column:
        """Product of two stored values, as a work value."""
        if self.name == "complex":
            return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))
        if self.name == "wrap64":  # one product fits 38 digits, sums of them may not
            return F.pmod(self.work(a) * self.work(b), F.expr(_TWO_64)).cast("decimal(20,0)")
        return self.work(a) * self.work(b)

    def total(self, c: Column) -> Column:
        """Sum of work values over a group."""
        return F.struct(F.sum(c["re"]).alias("re"), F.sum(c["im"]).alias("im")) if self.name == "complex" else F.sum(c)

    def plus(self, a: Column, b: Column) -> Column:
        return F.struct((a["re"] + b["re"]).alias("re"), (a["im"] + b["im"]).alias("im")) if self.name == "complex" else a + b

    def minus(self, a: Column, b: Column) -> Column:
        return F.struct((a["re"] - b["re"]).alias("re"), (a["im"] - b["im"]).alias("im")) if self.name == "complex" else a - b

    def settle(self, c: Column) -> Column:
        if self.name == "wrap8":
            return (F.pmod(c + 128, F.lit(256)) - 128).cast("tinyint")
        if self.name == "wrap64":
            return (F.pmod(c.cast("decimal(38,0)") + F.expr(_TWO_63), F.expr(_TWO_64)) - F.expr(_TWO_63)).cast("bigint")
        return c

    def magnitude(self, c: Column) -> Column:
        return F.hypot(c["re"], c["im"]) if self.name == "complex" else F.abs(self.work(c))


WRAP8 = Kind("wrap8", "tinyint")
INT64 = Kind("int64", "bigint")
WRAP64 = Kind("wrap64", "bigint")
DOUBLE = Kind("double", "double")
COMPLEX = Kind("complex", "struct<re:double,im:double>")
KINDS = {k.name: k for k in (WRAP8, INT64, WRAP64, DOUBLE, COMPLEX)}


def entry_schema(kind: Kind) -> T.StructType:
    value = T._parse_datatype_string(kind.type)
    return T.StructType([T.StructField("row", T.LongType(), False), T.StructField("col", T.LongType(), False), T.StructField("val", value, False)])
