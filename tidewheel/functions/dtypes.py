"""The element types: 14 primitives, how Spark stores them, and arithmetic that keeps the type.

Spark has no unsigned or 128-bit types: u8, u16 and u32 are stored in the next wider type and
u64, i128 and u128 as decimals, always checked against their range. 128-bit values beyond 38
decimal digits are refused, not rounded. isize and usize are 8 bytes wide on every platform.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.errors import OVERFLOW_TEXT

DECIMAL_MOST = 10**38 - 1


@dataclass(frozen=True)
class DType:
    name: str
    width: int
    spark: T.DataType
    low: int | None = None
    high: int | None = None

    @property
    def is_float(self) -> bool:
        return self.low is None

    @property
    def numpy(self) -> np.dtype:
        """Little-endian layout in files; 128-bit integers are pairs of words."""
        if self.width == 16:
            return np.dtype([("lo", "<u8"), ("hi", "<i8" if self.name == "i128" else "<u8")])
        return np.dtype(f"<{'f' if self.is_float else 'i' if self.low < 0 else 'u'}{self.width}")

    @property
    def wide(self) -> T.DataType:
        """A type in which a sum or difference of two elements is exact (floats: the type itself)."""
        if self.is_float:
            return self.spark
        return T.LongType() if self.width <= 4 else T.DecimalType(38, 0)


def _integer(name: str, bits: int, spark: T.DataType, signed: bool) -> DType:
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return DType(name, bits // 8, spark, low, high)


I8, I16, I32, I64 = (_integer(f"i{8 * w}", 8 * w, t, True) for w, t in ((1, T.ByteType()), (2, T.ShortType()), (4, T.IntegerType()), (8, T.LongType())))
ISIZE = _integer("isize", 64, T.LongType(), True)
U8, U16, U32 = (_integer(f"u{8 * w}", 8 * w, t, False) for w, t in ((1, T.ShortType()), (2, T.IntegerType()), (4, T.LongType())))
U64, USIZE = (_integer(n, 64, T.DecimalType(20, 0), False) for n in ("u64", "usize"))
I128, U128 = _integer("i128", 128, T.DecimalType(38, 0), True), _integer("u128", 128, T.DecimalType(38, 0), False)
F32, F64 = DType("f32", 4, T.FloatType()), DType("f64", 8, T.DoubleType())
DTYPES = {d.name: d for d in (I8, I16, I32, I64, I128, ISIZE, U8, U16, U32, U64, U128, USIZE, F32, F64)}


def dtype(name: str | DType) -> DType:
    return name if isinstance(name, DType) else DTYPES[name]


def of_spark(kind: T.DataType) -> DType:
    """The element type of a Spark column that names none."""
    for d in (I8, I16, I32, I64, F32, F64):
        if d.spark == kind:
            return d
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return I128
    raise TypeError(f"no element type for {kind.simpleString()}")


def of_numpy(kind: np.dtype) -> DType:
    name = {"i": "i", "u": "u", "f": "f"}[kind.kind] + str(8 * kind.itemsize)
    return DTYPES[name]


def checked(value: Column, to: DType) -> Column:
    """value as an element of type ``to``; an integer out of range raises when it is read."""
    if to.is_float:
        return value.cast(to.spark)
    if to.width <= 4 or to in (I64, ISIZE):  # stored in a machine integer, whose cast finds what is too large, whatever the session's ANSI mode
        kept = value.try_cast(to.spark)
        wrong = kept.isNull() & value.isNotNull()
        if to.low == 0:
            wrong = wrong | (kept < to.low) | (kept > to.high)
        return F.when(wrong, _raised(to)).otherwise(kept)
    exact = value.cast(T.DecimalType(38, 0))
    low, high = max(to.low, -DECIMAL_MOST), min(to.high, DECIMAL_MOST)
    inside = exact.between(F.lit(str(low)).cast(T.DecimalType(38, 0)), F.lit(str(high)).cast(T.DecimalType(38, 0)))
    return F.when(inside | value.isNull(), value).otherwise(_raised(to).cast(T.DecimalType(38, 0))).cast(to.spark)


def _raised(to: DType) -> Column:
    return F.raise_error(F.lit(f"{OVERFLOW_TEXT} {to.name}")).cast(to.spark)


def wrapped(value: Column, to: DType) -> Column:
    """An exact integer modulo 2 ** bits, as the machine would keep it."""
    span = F.lit(str(1 << 8 * to.width)).cast(T.DecimalType(38, 0))
    low = F.lit(str(to.low)).cast(T.DecimalType(38, 0))
    return (F.pmod(value.cast(T.DecimalType(38, 0)) - low, span) + low).cast(to.spark)


def _product(a: Column, b: Column, kind: DType, wrap: bool) -> Column:
    """a * b of u64 by 32-bit halves, as the whole product has too many digits."""
    big, half = T.DecimalType(38, 0), F.lit(str(1 << 32)).cast(T.DecimalType(38, 0))
    a, b = a.cast(big), b.cast(big)
    a1, b1 = (F.floor(x / half).cast(big) for x in (a, b))
    a0, b0 = (a - a1 * half).cast(big), (b - b1 * half).cast(big)
    cross = (a1 * b0).cast(big) + (a0 * b1).cast(big)
    low = (a0 * b0).cast(big)
    if wrap:
        return wrapped((F.pmod(cross, half).cast(big) * half).cast(big) + low, kind)
    fits = ((a1 * b1).cast(big) == 0) & (cross.cast(big) < half)
    exact = (cross.cast(big) * half).cast(big) + low
    return F.when(fits, checked(exact, kind)).otherwise(_raised(kind))


def add(a: Column, b: Column, kind: DType, wrap: bool = False) -> Column:
    return _arithmetic(a, b, kind, lambda x, y: x + y, F.try_add, wrap)


def sub(a: Column, b: Column, kind: DType, wrap: bool = False) -> Column:
    return _arithmetic(a, b, kind, lambda x, y: x - y, F.try_subtract, wrap)


def mul(a: Column, b: Column, kind: DType, wrap: bool = False) -> Column:
    if kind in (U64, USIZE):
        return _product(a, b, kind, wrap)
    return _arithmetic(a, b, kind, lambda x, y: x * y, F.try_multiply, wrap)


def _arithmetic(a: Column, b: Column, kind: DType, f, tried, wrap: bool) -> Column:
    if kind.is_float:
        return f(a.cast(kind.spark), b.cast(kind.spark)).cast(kind.spark)
    if kind in (I32, I64, ISIZE) and not wrap:  # null where it overflows, in any ANSI mode
        a, b = a.cast(kind.spark), b.cast(kind.spark)
        exact = tried(a, b)
        return F.when(exact.isNull() & a.isNotNull() & b.isNotNull(), _raised(kind)).otherwise(exact)
    exact = f(a.cast(kind.wide), b.cast(kind.wide))
    return wrapped(exact, kind) if wrap else checked(exact, kind)


def saturating_cast(value: Column, to: str | DType) -> Column:
    """A float as an integer: cut towards zero, the nearest bound if out of range, NaN as 0."""
    to = dtype(to)
    if to.is_float:
        return value.cast(to.spark)
    x = value.cast("double")
    low, high = (F.lit(str(max(-DECIMAL_MOST, min(DECIMAL_MOST, b)))).cast(T.DecimalType(38, 0)) for b in (to.low, to.high))
    inside = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    return F.when(F.isnan(x), F.lit(0).cast(to.spark)).when(x <= float(to.low), low.cast(to.spark)).when(x >= float(to.high), high.cast(to.spark)).otherwise(inside.cast(to.spark))


def ieee_div(a: Column, b: Column) -> Column:
    """Division of doubles as the machine does it: x/0 is an infinity of x's sign (or its opposite for -0.0), 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    negative_zero = F.expr("cast('-Infinity' as double)")
    sign = F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0)
    infinite = F.when(a * sign > 0, F.lit(float("inf"))).otherwise(negative_zero)
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(infinite)).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def half_away(value: Column) -> Column:
    """Rounds half away from zero, as a double."""
    return F.round(value)
