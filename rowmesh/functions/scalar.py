"""The scalar surface of floating-point numbers, with IEEE results where Spark's own functions raise, give null or differ.

Null in, null out. ``maximum`` and ``minimum`` ignore NaN, logarithms give NaN or minus infinity outside their domain,
division by zero gives an infinity or NaN, ``signum`` of a zero is one with its sign.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN, INF = float("nan"), float("inf")
#: From here on every double is a whole number.
WHOLE = float(1 << 53)


def _x(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("double")


def constant(name: str) -> Column:
    """nan, infinity, neg_infinity, neg_zero, zero, one, min_value, min_positive_value, max_value, epsilon."""
    return F.lit(
        {"nan": NAN, "infinity": INF, "neg_infinity": -INF, "neg_zero": -0.0, "zero": 0.0, "one": 1.0, "min_value": -np.finfo(float).max, "min_positive_value": np.finfo(float).tiny, "max_value": np.finfo(float).max, "epsilon": np.finfo(float).eps}[name].__float__()
    )


def is_sign_negative(c) -> Column:
    x = _x(c)
    return F.when(x == 0, x.cast("string").startswith("-")).otherwise((x < 0) & ~F.isnan(x))


def is_sign_positive(c) -> Column:
    return ~is_sign_negative(c)


def divide(a, b) -> Column:
    x, y = _x(a), _x(b)
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when(is_sign_negative(x) == is_sign_negative(y), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def remainder(a, b) -> Column:
    """Sign of the dividend; NaN by zero."""
    x, y = _x(a), _x(b)
    return F.when(y == 0, F.lit(NAN) + x * 0).otherwise(F.try_mod(x, y))


def recip(c) -> Column:
    return divide(F.lit(1.0), c)


def is_zero(c) -> Column:
    return _x(c) == 0


def is_nan(c) -> Column:
    return F.isnan(_x(c)) & _x(c).isNotNull()


def is_infinite(c) -> Column:
    return F.abs(_x(c)) == INF


def is_finite(c) -> Column:
    return ~is_infinite(c) & ~F.isnan(_x(c))


def is_normal(c) -> Column:
    return is_finite(c) & (F.abs(_x(c)) >= float(np.finfo(float).tiny))


def classify(c) -> Column:
    return F.when(F.isnan(_x(c)), "nan").when(is_infinite(c), "infinite").when(is_zero(c), "zero").when(is_normal(c), "normal").otherwise(F.when(_x(c).isNotNull(), "subnormal"))


def floor(c) -> Column:
    x = _x(c)
    return F.when((F.abs(x) >= WHOLE) | F.isnan(x) | (x == 0), x).otherwise(F.floor(x).cast("double"))


def ceil(c) -> Column:
    x = _x(c)
    return F.when((F.abs(x) >= WHOLE) | F.isnan(x) | (x == 0), x).otherwise(F.ceil(x).cast("double"))


def rounded(c) -> Column:
    """Half away from zero."""
    x = _x(c)
    whole = trunc(x)
    return F.when(F.abs(x - whole) >= 0.5, whole + F.signum(x)).otherwise(whole)


def trunc(c) -> Column:
    x = _x(c)
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def fract(c) -> Column:
    return _x(c) - trunc(c)


def absolute(c) -> Column:
    return F.abs(_x(c))


def signum(c) -> Column:
    x = _x(c)
    return F.when(F.isnan(x), x).when(is_sign_negative(x), F.lit(-1.0)).otherwise(F.when(x.isNotNull(), F.lit(1.0)))


def negate(c) -> Column:
    return -_x(c)


def mul_add(x, a, b) -> Column:
    """x * a + b, rounded twice."""
    return _x(x) * _x(a) + _x(b)


def power(c, n) -> Column:
    return F.pow(_x(c), _x(n))


def sqrt(c) -> Column:
    return F.sqrt(_x(c))


def cbrt(c) -> Column:
    return F.cbrt(_x(c))


def hypot(a, b) -> Column:
    return F.hypot(_x(a), _x(b))


def exp(c) -> Column:
    return F.exp(_x(c))


def exp2(c) -> Column:
    return F.pow(F.lit(2.0), _x(c))


def exp_m1(c) -> Column:
    return F.expm1(_x(c))


def _log(f, c, edge: float = 0.0) -> Column:
    x = _x(c)
    return F.when(F.isnan(x), x).when(x < edge, F.lit(NAN)).when(x == edge, F.lit(-INF)).otherwise(f(x))


def ln(c) -> Column:
    return _log(F.log, c)


def log2(c) -> Column:
    return _log(F.log2, c)


def log10(c) -> Column:
    return _log(F.log10, c)


def ln_1p(c) -> Column:
    return _log(F.log1p, c, -1.0)


def log(c, base) -> Column:
    return divide(ln(c), ln(base))


def maximum(a, b) -> Column:
    x, y = _x(a), _x(b)
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.when(x >= y, x).when(y > x, y))


def minimum(a, b) -> Column:
    x, y = _x(a), _x(b)
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.when(x <= y, x).when(y < x, y))


def abs_sub(a, b) -> Column:
    return F.when(_x(a) <= _x(b), F.lit(0.0)).otherwise(_x(a) - _x(b))


def compare(a, b) -> Column:
    """-1, 0 or 1; null if either is NaN."""
    x, y = _x(a), _x(b)
    return F.when(F.isnan(x) | F.isnan(y), None).when(x < y, -1).when(x == y, 0).when(x > y, 1)


def to_i64(c) -> Column:
    """Towards zero; null for NaN and outside 64 bits."""
    x = _x(c)
    return F.when(~F.isnan(x) & (x >= -(2.0**63)) & (x < 2.0**63), x.try_cast("bigint"))


def to_u64(c) -> Column:
    x = _x(c)
    return F.when(~F.isnan(x) & (x > -1) & (x < 2.0**64), trunc(x).try_cast("decimal(20,0)"))


def from_text(c, radix: int = 10) -> Column:
    """Only radix 10; null for what is no number."""
    if radix != 10:
        raise ValueError("only radix 10")
    return (c if isinstance(c, Column) else F.col(c)).try_cast("double")


sin = lambda c: F.sin(_x(c))
cos = lambda c: F.cos(_x(c))
tan = lambda c: F.tan(_x(c))
asin = lambda c: F.asin(_x(c))
acos = lambda c: F.acos(_x(c))
atan = lambda c: F.atan(_x(c))
sinh = lambda c: F.sinh(_x(c))
cosh = lambda c: F.cosh(_x(c))
tanh = lambda c: F.tanh(_x(c))
asinh = lambda c: F.asinh(_x(c))
acosh = lambda c: F.acosh(_x(c))
atanh = lambda c: F.when(F.abs(_x(c)) == 1, _x(c) * INF).otherwise(F.atanh(_x(c)))


def atan2(y, x) -> Column:
    """Of a negative zero over a negative x -pi, where Spark's own gives pi, and over a zero by the signs of both."""
    up, over = _x(y), _x(x)
    half = F.when(is_sign_negative(over), F.lit(math.pi)).otherwise(F.lit(0.0))
    return F.when((up == 0) & ((over == 0) | (over < 0)), F.when(is_sign_negative(up), -half).otherwise(half)).otherwise(F.atan2(up, over))


def sin_cos(c) -> Column:
    return F.struct(sin(c).alias("sin"), cos(c).alias("cos"))


def _shown(x: float | None) -> str | None:
    if x is None or pd.isna(x):
        return None if x is None else "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    text = repr(float(x))
    sign, text = ("-", text[1:]) if text[0] == "-" else ("", text)
    head, _, tail = text.partition("e")
    whole, _, part = head.partition(".")
    digits = (whole + part).lstrip("0")
    exponent = int(tail or 0) + len(whole) - 1 if whole.strip("0") else int(tail or 0) - (len(part) - len(part.lstrip("0"))) - 1
    digits = digits.rstrip("0")
    if not digits:
        return f"{sign}0e0"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{exponent}"


@F.pandas_udf(T.StringType())
def _scientific(s: pd.Series) -> pd.Series:
    return s.map(_shown)


def scientific(c) -> Column:
    """Shortest digits that read back as the same number, as in 1.2345678e4; Arrow batches, as no built-in has them."""
    return F.when(_x(c).isNotNull(), _scientific(_x(c)))


_DECODED = T.StructType([T.StructField("mantissa", T.DecimalType(20, 0)), T.StructField("exponent", T.IntegerType()), T.StructField("sign", T.IntegerType())])


@F.pandas_udf(_DECODED)
def _decoded(s: pd.Series) -> pd.DataFrame:
    from decimal import Decimal

    bits = s.to_numpy(np.float64).view(np.uint64)
    exponent = ((bits >> np.uint64(52)) & np.uint64(0x7FF)).astype(np.int64)
    part = bits & np.uint64((1 << 52) - 1)
    mantissa = np.where(exponent == 0, part << np.uint64(1), part | np.uint64(1 << 52))
    sign = np.where(bits >> np.uint64(63) == 0, 1, -1)
    return pd.DataFrame({"mantissa": [Decimal(int(m)) for m in mantissa], "exponent": (exponent - 1075).astype(np.int32), "sign": sign.astype(np.int32)})


def integer_decode(c) -> Column:
    """(mantissa, exponent, sign) with x = sign * mantissa * 2^exponent."""
    return F.when(_x(c).isNotNull(), _decoded(_x(c)))
