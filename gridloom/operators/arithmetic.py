"""Element-wise arithmetic and mathematics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import planes as P
from gridloom.operators.common import D, changed, mapped, masked, paired, zipped


def add(a: DataFrame, b: DataFrame, depth: int = N.U8, mask: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    return zipped(a, b, lambda x, y: N.saturate(x + y, depth, "wrap" if depth == N.I32 else "generic"), mask, previous)


def subtract(a: DataFrame, b: DataFrame, depth: int = N.U8, mask: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    return zipped(a, b, lambda x, y: N.saturate(x - y, depth, "wrap" if depth == N.I32 else "generic"), mask, previous)


def absdiff(a: DataFrame, b: DataFrame, depth: int = N.U8) -> DataFrame:
    """32-bit differences wrap, and so does the absolute value of the least integer."""
    if depth == N.I32:
        return zipped(a, b, lambda x, y: N.saturate(F.abs(N.saturate(x - y, depth, "wrap")), depth, "wrap"))
    return zipped(a, b, lambda x, y: N.saturate(F.abs(x - y), depth))


def minimum(a: DataFrame, b: DataFrame) -> DataFrame:
    """The smaller value; a NaN gives way to the other operand."""
    return zipped(a, b, lambda x, y: F.least(F.nanvl(x, y), F.nanvl(y, x)))


def maximum(a: DataFrame, b: DataFrame) -> DataFrame:
    return zipped(a, b, lambda x, y: F.greatest(F.nanvl(x, y), F.nanvl(y, x)))


def _bits(name: str):
    """Bits of whole numbers; on float depths the operators work on the bytes, in Python."""

    def value(x: Column, y: Column) -> Column:
        a, b = x.cast("long"), y.cast("long")
        return {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b)}[name].cast("double")

    return value


def _bitwise(name: str, a: DataFrame, b: DataFrame, depth: int, mask, previous) -> DataFrame:
    if depth in N.RANGE:
        return zipped(a, b, _bits(name), mask, previous)
    return masked(_float_bits(paired(a, b), name, depth), mask, previous)


def _float_bits(planes: DataFrame, name: str, depth: int) -> DataFrame:
    kind, raw = (np.float32, np.uint32) if depth == N.F32 else (np.float64, np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                p, q = np.array(x, kind).view(raw), np.array(y if y is not None else x, kind).view(raw)
                out.append({"and": p & q, "or": p | q, "xor": p ^ q, "not": ~p}[name].view(kind).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.list_(pa.float64()))], ["img", "c", "rows", "cols", "data", "out"])

    return planes.select("img", "c", "rows", "cols", "data", "data2").mapInArrow(scan, "img long, c int, rows int, cols int, data array<double>, out array<double>")


def bitwise_and(a, b, depth: int = N.U8, mask=None, previous=None) -> DataFrame:
    return _bitwise("and", a, b, depth, mask, previous)


def bitwise_or(a, b, depth: int = N.U8, mask=None, previous=None) -> DataFrame:
    return _bitwise("or", a, b, depth, mask, previous)


def bitwise_xor(a, b, depth: int = N.U8, mask=None, previous=None) -> DataFrame:
    return _bitwise("xor", a, b, depth, mask, previous)


def bitwise_not(a: DataFrame, depth: int = N.U8, mask: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    if depth in N.RANGE:
        low, high = N.RANGE[depth]
        return mapped(a, lambda v: F.lit(float(low + high)) - v, mask, previous)
    return masked(_float_bits(a.withColumn("data2", F.lit(None).cast("array<double>")), "not", depth), mask, previous)


def multiply(a: DataFrame, b: DataFrame, scale: float = 1.0, depth: int = N.U8) -> DataFrame:
    return zipped(a, b, lambda x, y: N.saturate(x * y * scale, depth, "wrap" if depth == N.I32 else "numeric"))


def divide(a: DataFrame, b: DataFrame, scale: float = 1.0, depth: int = N.U8) -> DataFrame:
    """Whole numbers divided by 0 give 0; floats follow IEEE."""
    if depth in N.RANGE:
        rule = "sentinel" if depth == N.I32 else "numeric"
        return zipped(a, b, lambda x, y: F.when(y == 0, F.lit(0.0)).otherwise(N.saturate(N.safe_divide(x * scale, y), depth, rule)))
    return zipped(a, b, lambda x, y: N.saturate(N.safe_divide(x * scale, y), depth))


def add_weighted(a: DataFrame, alpha: float, b: DataFrame, beta: float, gamma: float, depth: int = N.U8) -> DataFrame:
    return zipped(a, b, lambda x, y: N.saturate(x * alpha + y * beta + gamma, depth, "sentinel" if depth == N.I32 else "numeric"))


def convert_scale_abs(a: DataFrame, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    return mapped(a, lambda v: N.saturate(F.abs(v * alpha + beta), N.U8, "numeric"))


def blend_linear(a: DataFrame, b: DataFrame, wa: DataFrame, wb: DataFrame, depth: int = N.U8) -> DataFrame:
    """a * wa + b * wb, place by place; the weights are not normalised."""
    four = paired(a, b, wa, wb)
    return changed(four, F.transform(F.arrays_zip("data", "data2", "data3", "data4"), lambda t: N.saturate(t["data"] * t["data3"] + t["data2"] * t["data4"], depth)))


def exp(a: DataFrame, depth: int = N.F64) -> DataFrame:
    return mapped(a, lambda v: N.saturate(F.exp(v), depth))


def log(a: DataFrame, depth: int = N.F64) -> DataFrame:
    return mapped(a, lambda v: N.saturate(N.safe_log(v), depth))


def sqrt(a: DataFrame, depth: int = N.F64) -> DataFrame:
    if depth not in (N.F32, N.F64):
        raise ValueError("square roots are of float depths")
    return mapped(a, lambda v: N.saturate(F.sqrt(v), depth))


def power(a: DataFrame, exponent: float, depth: int = N.F64) -> DataFrame:
    """Whole numbers need a whole exponent; of floats, negative ones to a broken exponent are NaN."""
    whole = math.isfinite(exponent) and exponent == int(exponent)
    if depth in N.RANGE:
        if not whole:
            raise ValueError("integer depths need a whole exponent")
        return mapped(a, lambda v: N.saturate(F.pow(v, F.lit(float(exponent))), depth, "wrap" if depth == N.I32 and exponent >= 0 else "numeric"))
    if exponent == 0:
        return mapped(a, lambda v: F.lit(1.0))
    if abs(exponent) == 0.5:
        return mapped(a, lambda v: N.saturate(F.sqrt(v) if exponent > 0 else N.safe_divide(F.lit(1.0), F.sqrt(v)), depth))
    if whole:
        return mapped(a, lambda v: N.saturate(F.pow(v, F.lit(float(exponent))), depth))
    return mapped(a, lambda v: N.saturate(F.exp(N.safe_log(v) * exponent), depth))


def magnitude(x: DataFrame, y: DataFrame, depth: int = N.F64) -> DataFrame:
    return zipped(x, y, lambda a, b: N.saturate(F.sqrt(a * a + b * b), depth))


def angle(x: DataFrame, y: DataFrame, degrees: bool = False) -> DataFrame:
    """The direction of (x, y) in a full turn from 0."""

    def value(a: Column, b: Column) -> Column:
        t = F.atan2(b, a)
        t = F.when(t < 0, t + 2 * math.pi).otherwise(t)
        return F.degrees(t) if degrees else t

    return zipped(x, y, value)


def cart_to_polar(x: DataFrame, y: DataFrame, degrees: bool = False) -> tuple[DataFrame, DataFrame]:
    return magnitude(x, y), angle(x, y, degrees)


def polar_to_cart(size: DataFrame, direction: DataFrame, degrees: bool = False) -> tuple[DataFrame, DataFrame]:
    turn = (lambda t: F.radians(t)) if degrees else (lambda t: t)
    return zipped(size, direction, lambda m, t: m * F.cos(turn(t))), zipped(size, direction, lambda m, t: m * F.sin(turn(t)))


def transform(planes: DataFrame, rows: Sequence[Sequence[float]], depth: int = N.F64) -> DataFrame:
    """Every pixel's channels times a matrix of n or n + 1 columns (the last a constant), one output channel per row."""
    pixels = planes.groupBy("img").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.transform(F.array_sort(F.collect_list(F.struct("c", "data"))), lambda p: p["data"]).alias("_p"))
    n = len(rows[0])
    outs = []
    for k, row in enumerate(rows):
        outs.append(F.struct(F.lit(k).alias("c"), P.let(F.col("_p"), _mixing(row, n, depth)).alias("data")))
    return pixels.select("img", F.explode(F.array(*outs)).alias("_o"), "rows", "cols").select("img", "_o.c", "rows", "cols", "_o.data")


def _mixing(row: Sequence[float], n: int, depth: int):
    """One output channel from the array of a pixel's input channels."""

    def channel(p: Column) -> Column:
        def value(i: Column) -> Column:
            sum_ = F.lit(0.0)
            for j, w in enumerate(row):
                own = F.get(F.get(p, F.lit(j)), i)
                sum_ = sum_ + (F.when(F.size(p) > j, own).otherwise(F.lit(1.0)) if j == n - 1 else own) * float(w)
            return N.saturate(sum_, depth, "numeric")

        return F.transform(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1), value)

    return channel


def perspective_transform(points: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Points (set_id, pos, x, y) through a 3 x 3 matrix; where the divisor is as good as 0, or NaN, the point is (0, 0)."""
    m = [[float(v) for v in r] for r in matrix]
    dot = lambda r: F.col("x") * r[0] + F.col("y") * r[1] + r[2]
    w = dot(m[2])
    flat = (F.abs(w) <= 1.1920929e-07) | F.isnan(w)
    safe = F.when(flat, F.lit(1.0)).otherwise(w)
    return points.select("set_id", "pos", *[F.when(flat, F.lit(0.0)).otherwise(dot(m[k]) / safe).alias(n) for k, n in enumerate("xy")])


def div_spectrums(a_re: DataFrame, a_im: DataFrame, b_re: DataFrame, b_im: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complex quotients, as real and imaginary planes; a divisor of 0 counts as the smallest normal number."""
    four = paired(a_re, a_im, b_re, b_im)
    z = F.arrays_zip("data", "data2", "data3", "data4")
    n = lambda t: F.greatest(t["data3"] * t["data3"] + t["data4"] * t["data4"], F.lit(2.2250738585072014e-308))
    re = F.transform(z, lambda t: (t["data"] * t["data3"] + t["data2"] * t["data4"]) / n(t))
    im = F.transform(z, lambda t: (t["data2"] * t["data3"] - t["data"] * t["data4"]) / n(t))
    return changed(four, re), changed(four, im)


def to_gray(planes: DataFrame, blue: int = 0, depth: int = N.U8) -> DataFrame:
    """Luma of the channels; blue tells whether blue comes first (0) or last (2)."""
    # fixed values: fixed-point luma weights of blue, green and red for 8 and 16 bits, and the float ones
    weights, shift = {N.U8: ((1868, 9617, 4899), 14), N.U16: ((3735, 19235, 9798), 15)}.get(depth, ((0.114, 0.587, 0.299), 0))
    w = weights if blue == 0 else weights[::-1]
    part = planes.where("c < 3").withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col("c") + 1))
    listed = part.groupBy("img").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.transform(F.array_sort(F.collect_list(F.struct("c", "_w", "data"))), lambda p: F.transform(p["data"], lambda v: v * p["_w"])).alias("_p"))
    summed = P.let(F.col("_p"), lambda p: F.transform(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1), lambda i: F.get(F.get(p, F.lit(0)), i) + F.get(F.get(p, F.lit(1)), i) + F.get(F.get(p, F.lit(2)), i)))
    data = F.transform(summed, lambda v: F.floor((v + 2.0 ** (shift - 1)) / 2.0**shift).cast("double")) if shift else summed
    return listed.select("img", F.lit(0).alias("c"), "rows", "cols", data.alias("data"))


def reorder_channels(planes: DataFrame, order: Sequence[int], alpha: float | None = None) -> DataFrame:
    """Channel k of the result is channel order[k]; with alpha, one more channel of that value."""
    where = F.create_map(*[F.lit(x) for k, c in enumerate(order) for x in (c, k)])
    out = planes.where(F.col("c").isin(list(order))).withColumn("c", F.element_at(where, F.col("c")))
    if alpha is None:
        return out
    full = planes.where("c = 0").select("img", F.lit(len(order)).alias("c"), "rows", "cols", F.transform(D(), lambda _: F.lit(float(alpha))).alias("data"))
    return out.unionByName(full)


def gray_to_color(planes: DataFrame, channels: int = 3, alpha: float = 255.0) -> DataFrame:
    copies = planes.drop("c").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    return copies.select("img", "c", "rows", "cols", F.when(F.col("c") == 3, F.transform(D(), lambda _: F.lit(float(alpha)))).otherwise(D()).alias("data"))


#: Integer rows and shifts of the 8-bit colour transforms, for blue, green, red.
_XYZ, _XYZ_SHIFT = ((739, 1465, 1689), (296, 2929, 871), (3892, 488, 79)), 12
_LUMA, _CHROMA_SHIFT = (1868, 9617, 4899), 14
_CHROMA = {"ycrcb": (("r", 11682), ("b", 9241)), "yuv": (("b", 8061), ("r", 14369))}


def _pixel(planes: DataFrame, outs: Sequence, blue: int) -> DataFrame:
    """Planes 0 .. n-1 whose values are outs[k](b, g, r) of each pixel; planes beyond the third are left out."""
    rows = planes.where("c < 3").groupBy("img").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.transform(F.array_sort(F.collect_list(F.struct("c", "data"))), lambda p: p["data"]).alias("_p"))

    def channel(value):
        mixed = lambda p: F.transform(F.arrays_zip(F.get(p, F.lit(blue)).alias("b"), F.get(p, F.lit(1)).alias("g"), F.get(p, F.lit(2 - blue)).alias("r")), lambda t: value(t["b"], t["g"], t["r"]))
        return P.let(F.col("_p"), mixed)

    made = F.array(*[F.struct(F.lit(k).alias("c"), channel(v).alias("data")) for k, v in enumerate(outs)])
    return rows.select("img", "rows", "cols", F.explode(made).alias("_o")).select("img", "_o.c", "rows", "cols", "_o.data")


def _shifted(v: Column, shift: int) -> Column:
    return F.floor((v + 2.0 ** (shift - 1)) / 2.0**shift)


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v.cast("double")))


def to_xyz(planes: DataFrame, blue: int = 0) -> DataFrame:
    """8-bit channels to X, Y and Z; blue tells the place of blue (0 or 2)."""

    def row(w):
        return lambda b, g, r: _byte(_shifted(b * float(w[0]) + g * float(w[1]) + r * float(w[2]), _XYZ_SHIFT))

    return _pixel(planes, [row(w) for w in _XYZ], blue)


def to_luma_chroma(planes: DataFrame, kind: str = "ycrcb", blue: int = 0) -> DataFrame:
    """8-bit channels to luma and two differences from it around 128: 'ycrcb' or 'yuv'."""
    luma = lambda b, g, r: _shifted(b * float(_LUMA[0]) + g * float(_LUMA[1]) + r * float(_LUMA[2]), 14)

    def difference(which: str, weight: int):
        return lambda b, g, r: _byte(_shifted((b if which == "b" else r) * float(weight) - luma(b, g, r) * float(weight) + 128.0 * 2**_CHROMA_SHIFT, _CHROMA_SHIFT))

    return _pixel(planes, [lambda b, g, r: _byte(luma(b, g, r)), *[difference(*x) for x in _CHROMA[kind]]], blue)
