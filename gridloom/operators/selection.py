"""Predicates, thresholds and look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import planes as P
from gridloom.operators.common import COLS, D, ROWS, changed, mapped, paired, zipped

EQ, GT, GE, LT, LE, NE = range(6)
BINARY, BINARY_INV, TRUNC, TOZERO, TOZERO_INV, OTSU, TRIANGLE, DRYRUN = 0, 1, 2, 3, 4, 8, 16, 128


def _compared(a: Column, b: Column, op: int) -> Column:
    nan = F.isnan(a) | F.isnan(b)
    return {EQ: (a == b) & ~nan, GT: (a > b) & ~nan, GE: (a >= b) & ~nan, LT: (a < b) & ~nan, LE: (a <= b) & ~nan, NE: (a != b) | nan}[op]


def compare(a: DataFrame, b: DataFrame, op: int) -> DataFrame:
    """255 where a OP b holds, else 0; NaN is unequal to all."""
    return zipped(a, b, lambda x, y: F.when(_compared(x, y, op), F.lit(255.0)).otherwise(F.lit(0.0)))


def in_range(planes: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """One mask plane per image: 255 where every channel lies between its bounds, both included."""
    three = paired(planes, low, high)
    inside = F.transform(F.arrays_zip("data", "data2", "data3"), lambda t: F.when((t["data"] >= t["data2"]) & (t["data"] <= t["data3"]) & ~F.isnan(t["data"]), 1).otherwise(0))
    listed = three.select("img", "rows", "cols", inside.alias("_in")).groupBy("img").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.collect_list("_in").alias("_all"))
    every = P.let(F.col("_all"), lambda a: F.transform(F.sequence(F.lit(0), ROWS() * COLS() - 1), lambda i: F.when(F.forall(a, lambda p: F.get(p, i) == 1), F.lit(255.0)).otherwise(F.lit(0.0))))
    return listed.select("img", F.lit(0).alias("c"), "rows", "cols", every.alias("data"))


def thresholded(v: Column, level: Column, maximum: float, kind: int) -> Column:
    above, top = v > level, F.lit(float(maximum))
    return {BINARY: F.when(above, top).otherwise(F.lit(0.0)), BINARY_INV: F.when(above, F.lit(0.0)).otherwise(top), TRUNC: F.when(above, level).otherwise(v), TOZERO: F.when(above, v).otherwise(F.lit(0.0)), TOZERO_INV: F.when(above, F.lit(0.0)).otherwise(v)}[kind]


def threshold(planes: DataFrame, level: float, maximum: float, kind: int, depth: int = N.U8) -> DataFrame:
    """Strictly above the level or not. Integer depths round the level down and the maximum half-even.

    With OTSU the level is found for each plane of 8-bit values, and the given one is not used.
    """
    base = kind & 7
    if depth in (N.I8, N.I32) or (kind & OTSU and kind & TRIANGLE) or base > TOZERO_INV:
        raise ValueError("unsupported threshold")
    if kind & TRIANGLE:
        from gridloom.operators.kernels import triangle_threshold

        return triangle_threshold(planes, maximum, base)
    if kind & OTSU:
        from gridloom.operators.kernels import otsu_threshold

        return otsu_threshold(planes, maximum, base)
    if depth in N.RANGE:
        import math

        level, maximum = float(math.floor(level)) if math.isfinite(level) else level, float(round(maximum))
        maximum = min(max(maximum, N.RANGE[depth][0]), N.RANGE[depth][1])
    return mapped(planes, lambda v: thresholded(v, F.lit(float(level)), maximum, base))


def adaptive_threshold(planes: DataFrame, maximum: float, gaussian: bool, inverse: bool, block: int, delta: float) -> DataFrame:
    """Each 8-bit value against the mean of its block, repeated at the border, less delta; the mean is not rounded."""
    from gridloom.operators.neighbourhood import gaussian_kernel

    if block % 2 == 0 or block < 3:
        raise ValueError("the block size is odd and over 1")
    line = gaussian_kernel(block, 0.3 * ((block - 1) / 2 - 1) + 0.8) if gaussian else [1 / block] * block
    r = block // 2
    mean = P.taps(D(), ROWS(), COLS(), [(i - r, j - r, a * b) for i, a in enumerate(line) for j, b in enumerate(line)], P.REPLICATE)
    top = float(max(0, min(255, round(maximum))))
    hit, miss = (F.lit(0.0), F.lit(top)) if inverse else (F.lit(top), F.lit(0.0))
    return changed(planes.withColumn("_m", mean), F.zip_with(D(), "_m", lambda v, m: F.when(v > m - delta, hit).otherwise(miss)))


def lut(planes: DataFrame, table: Sequence[float], signed: bool = False) -> DataFrame:
    """Values replaced by entries of a table of 256; signed 8-bit values are read by their byte."""
    if len(table) != 256:
        raise ValueError("a look-up table has 256 entries")
    entries = F.array(*[F.lit(float(x)) for x in table])
    index = (lambda v: F.pmod(v.cast("int"), F.lit(256))) if signed else (lambda v: v.cast("int"))
    return changed(planes.withColumn("_t", entries), F.transform(D(), lambda v: F.get(F.col("_t"), index(v))))


def count_non_zero(planes: DataFrame) -> DataFrame:
    """(img, c, n): NaN counts, zeros of either sign do not."""
    return planes.select("img", "c", F.size(F.filter(D(), lambda v: v != 0)).cast("long").alias("n"))
