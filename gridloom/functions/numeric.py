"""Rounding and saturation of doubles to the seven scalar depths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U8, I8, U16, I16, I32, F32, F64 = range(7)
#: Least and greatest value of each integer depth.
RANGE = {U8: (0, 255), I8: (-128, 127), U16: (0, 65535), I16: (-32768, 32767), I32: (-(2**31), 2**31 - 1)}
#: Spark type in which a depth is stored outside of the double-valued arrays.
STORAGE = {U8: "smallint", I8: "tinyint", U16: "int", I16: "smallint", I32: "int", F32: "float", F64: "double"}

_LOW, _HIGH = float(-(2**31)), float(2**31)


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def _narrow(v: Column, depth: int) -> Column:
    return v.cast("float").cast("double") if depth == F32 else v


def _clamp(v: Column, depth: int) -> Column:
    low, high = RANGE[depth]
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)) + F.lit(0.0)


def saturate(v: Column, depth: int, rule: str = "generic") -> Column:
    """v as a value of the depth, still a double.

    Rules differ in what leaves the range: 'generic' takes non-finite values and those of 2**31 or more in size as the
    least 32-bit integer before clamping; 'numeric' takes NaN as 0 and clamps the rest; 'wrap' reduces modulo 2**32;
    'sentinel' takes all that exceeds 32 bits as the least 32-bit integer. Ties go to the even neighbour; 'away' rounds
    ties away from zero. Float depths are only narrowed.
    """
    if depth in (F32, F64):
        return _narrow(v, depth)
    if rule == "generic":
        return _clamp(F.when(_finite(v) & (F.abs(v) < _HIGH), F.rint(v)).otherwise(F.lit(_LOW)), depth)
    if rule == "wrap" and depth == I32:
        whole = F.rint(v)
        wrapped = whole - F.floor((whole + _HIGH) / (2 * _HIGH)) * (2 * _HIGH)
        return F.when(_finite(v), wrapped).otherwise(F.lit(_LOW))
    if rule == "sentinel" and depth == I32:
        whole = F.rint(v)
        return F.when(_finite(v) & (whole >= _LOW) & (whole < _HIGH - 1), whole).otherwise(F.lit(_LOW))
    rounded = F.signum(v) * F.floor(F.abs(v) + 0.5) if rule == "away" else F.rint(v)
    return F.when(F.isnan(v), F.lit(0.0)).otherwise(_clamp(rounded, depth))


def safe_divide(a: Column, b: Column) -> Column:
    """IEEE division: no error by zero."""
    over = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, over).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def safe_log(v: Column) -> Column:
    """IEEE logarithm: -inf of 0, NaN of negative numbers."""
    return F.when(v > 0, F.log(v)).when(v == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
