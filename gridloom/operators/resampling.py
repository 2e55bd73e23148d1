"""Resampling and geometric maps: every output value is gathered from its plane's own row."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import planes as P
from gridloom.operators.common import COLS, D, ROWS, changed, paired

NEAREST, LINEAR, CUBIC, AREA, LANCZOS4 = range(5)


def bilinear(d: Column, sy: Column, sx: Column, border: int = P.CONSTANT, outside: float = 0.0) -> Column:
    """The value at a place between pixels; the place is computed once, however often it is used."""
    return P.let(F.struct(sy.cast("double").alias("y"), sx.cast("double").alias("x")), lambda s: _mixed(d, s["y"], s["x"], border, outside))


def _mixed(d: Column, sy: Column, sx: Column, border: int, outside: float) -> Column:
    y0, x0 = F.floor(sy).cast("int"), F.floor(sx).cast("int")
    fy, fx = sy - y0, sx - x0
    v = lambda a, b: F.coalesce(P.at(d, COLS(), P.border_index(a, ROWS(), border), P.border_index(b, COLS(), border)), F.lit(float(outside)))
    return v(y0, x0) * (1 - fy) * (1 - fx) + v(y0, x0 + 1) * (1 - fy) * fx + v(y0 + 1, x0) * fy * (1 - fx) + v(y0 + 1, x0 + 1) * fy * fx


def _cubic(t: float) -> float:
    a, t = -0.75, abs(t)
    return (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0


def _lanczos(t: float) -> float:
    return 1.0 if t == 0 else 4 * math.sin(math.pi * t) * math.sin(math.pi * t / 4) / (math.pi * t) ** 2 if abs(t) < 4 else 0.0


def axis_taps(source: int, target: int, mode: int) -> list[list[tuple[int, float]]]:
    """For each target place the source places and weights along one axis."""
    scale, out = source / target, []
    for k in range(target):
        if mode == NEAREST:
            out.append([(min(source - 1, math.floor(k * scale)), 1.0)])
        elif mode == AREA and scale >= 1:
            a, z = k * scale, min((k + 1) * scale, source)
            out.append([(i, (min(i + 1, z) - max(i, a)) / (z - a)) for i in range(math.floor(a), math.ceil(z - 1e-9)) if min(i + 1, z) > max(i, a)])
        else:
            at = (k + 0.5) * scale - 0.5
            base = math.floor(at)
            reach, weight = {LINEAR: (1, lambda t: max(0.0, 1 - abs(t))), AREA: (1, lambda t: max(0.0, 1 - abs(t))), CUBIC: (2, _cubic), LANCZOS4: (4, _lanczos)}[mode]
            taps = [(i, weight(at - i)) for i in range(base - reach + 1, base + reach + 1)]
            whole = sum(w for _, w in taps) if mode == LANCZOS4 else 1.0
            merged: dict[int, float] = {}
            for i, w in taps:
                i = min(max(i, 0), source - 1)
                merged[i] = merged.get(i, 0.0) + w / whole
            out.append([(i, w) for i, w in sorted(merged.items()) if w])
    return out


def resize(planes: DataFrame, source: tuple[int, int], target: tuple[int, int], mode: int = LINEAR, depth: int = N.U8) -> DataFrame:
    """Planes of source (rows, cols) at target size. Halving both sides with LINEAR is AREA. Whole depths end with floor(v + 0.5)."""
    if source == target:
        return planes.where((ROWS() == source[0]) & (COLS() == source[1]))
    if mode == LINEAR and source == (2 * target[0], 2 * target[1]):
        mode = AREA
    listed = lambda taps: F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in t]) for t in taps])
    rows = planes.where((ROWS() == source[0]) & (COLS() == source[1])).withColumns({"_ty": listed(axis_taps(source[0], target[0], mode)), "_tx": listed(axis_taps(source[1], target[1], mode))})

    def value(d: Column, y: Column, x: Column) -> Column:
        v = F.aggregate(F.get("_ty", y), F.lit(0.0), lambda s, a: s + a["w"] * F.aggregate(F.get("_tx", x), F.lit(0.0), lambda t, b: t + b["w"] * P.at(d, COLS(), a["i"], b["i"])))
        if depth not in N.RANGE or mode == NEAREST:
            return N.saturate(v, depth)
        low, high = N.RANGE[depth]
        return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.floor(v + 0.5).cast("double")))

    return changed(rows, P.grid_over(D(), target[0], target[1], value), *target)


def remap(planes: DataFrame, map_x: DataFrame, map_y: DataFrame, mode: int = LINEAR, outside: float = 0.0, depth: int = N.U8) -> DataFrame:
    """Values from the places that map planes (one per image) give; `outside` where these leave the image."""
    maps = map_x.select("img", F.col("rows").alias("_r"), F.col("cols").alias("_k"), F.col("data").alias("_x")).join(map_y.select("img", F.col("data").alias("_y")), "img")
    rows = planes.join(maps, "img")

    def value(d: Column, y: Column, x: Column) -> Column:
        i = y * F.col("_k") + x
        sx, sy = F.get("_x", i), F.get("_y", i)
        if mode == NEAREST:
            away = lambda v: (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("int")
            return F.coalesce(P.at(d, COLS(), P.border_index(away(sy), ROWS(), P.CONSTANT), P.border_index(away(sx), COLS(), P.CONSTANT)), F.lit(float(outside)))
        return N.saturate(bilinear(d, sy, sx, P.CONSTANT, outside), depth)

    return changed(rows, P.grid_over(D(), F.col("_r"), F.col("_k"), value), F.col("_r"), F.col("_k"))


def convert_maps(map_x: DataFrame, map_y: DataFrame) -> DataFrame:
    """(img, c, xi, yi, fraction): whole parts and the index of 1/32 fractions; a fraction of 32 carries over."""
    both = paired(map_x, map_y)
    part = lambda v: F.rint(v * 32)
    whole = lambda v: F.floor(part(v) / 32).cast("int")
    left = lambda v: (part(v) - whole(v) * 32).cast("int")
    return both.select("img", "c", "rows", "cols", F.transform(D(), whole).alias("xi"), F.transform("data2", whole).alias("yi"), F.zip_with(D(), "data2", lambda x, y: left(x) + left(y) * 32).alias("fraction"))


def _warped(planes: DataFrame, rows: int, cols: int, source: Callable[[Column, Column], tuple[Column, Column]], mode: int, border: int, outside: float, depth: int) -> DataFrame:
    def value(d: Column, y: Column, x: Column) -> Column:
        sy, sx = source(y, x)
        if mode == NEAREST:
            return F.coalesce(P.at(d, COLS(), P.border_index(F.rint(sy).cast("int"), ROWS(), border), P.border_index(F.rint(sx).cast("int"), COLS(), border)), F.lit(float(outside)))
        return N.saturate(bilinear(d, sy, sx, border, outside), depth)

    return changed(planes, P.grid_over(D(), rows, cols, value), rows, cols)


def _inverse(matrix: np.ndarray) -> list[list[float]]:
    try:
        return np.linalg.inv(matrix).tolist()
    except np.linalg.LinAlgError:
        return np.zeros_like(matrix).tolist()


def warp_affine(planes: DataFrame, matrix: Sequence[Sequence[float]], rows: int, cols: int, mode: int = LINEAR, border: int = P.CONSTANT, outside: float = 0.0, inverse: bool = False, depth: int = N.U8) -> DataFrame:
    """A 2 x 3 matrix maps source (x, y) to target places; with `inverse` it maps target to source."""
    m = np.vstack([np.array(matrix, float), [0, 0, 1]])
    m = m.tolist() if inverse else _inverse(m)
    return _warped(planes, rows, cols, lambda y, x: (x * m[1][0] + y * m[1][1] + m[1][2], x * m[0][0] + y * m[0][1] + m[0][2]), mode, border, outside, depth)


def warp_perspective(planes: DataFrame, matrix: Sequence[Sequence[float]], rows: int, cols: int, mode: int = LINEAR, border: int = P.CONSTANT, outside: float = 0.0, inverse: bool = False, depth: int = N.U8) -> DataFrame:
    """A 3 x 3 matrix, places on a grid of 1/32 pixel; where the divisor is 0 the source place is the origin."""
    a = np.array(matrix, float)
    if not np.isfinite(a).all():
        raise ValueError("the matrix is not finite")
    m = a.tolist() if inverse else _inverse(a)

    def source(y: Column, x: Column) -> tuple[Column, Column]:
        dot = lambda r: x * r[0] + y * r[1] + r[2]
        w = dot(m[2])
        inv = F.when(w == 0, F.lit(0.0)).otherwise(1 / F.when(w == 0, F.lit(1.0)).otherwise(w))
        snap = lambda v: v if mode == NEAREST else F.rint(v * 32) / 32
        return snap(dot(m[1]) * inv), snap(dot(m[0]) * inv)

    return _warped(planes, rows, cols, source, mode, border, outside, depth)


def warp_polar(planes: DataFrame, rows: int, cols: int, center: tuple[float, float], radius: float, logarithmic: bool = False, depth: int = N.U8) -> DataFrame:
    """Rows are angles of a full turn, columns radii up to `radius`."""

    def source(y: Column, x: Column) -> tuple[Column, Column]:
        r = F.exp(x / float(cols)) * (radius / math.e) if logarithmic else x * (radius / cols)
        t = y * (2 * math.pi / rows)
        return r * F.sin(t) + center[1], r * F.cos(t) + center[0]

    return _warped(planes, rows, cols, source, LINEAR, P.CONSTANT, 0.0, depth)


def demosaic(planes: DataFrame, red: tuple[int, int], depth: int = N.U8) -> DataFrame:
    """Three channels (blue, green, red) from a Bayer mosaic whose red sites have the parity red = (y, x); means of the nearest sites, 0 outside."""

    def value(channel: int) -> Callable[[Column, Column, Column], Column]:
        def at(d: Column, y: Column, x: Column) -> Column:
            v = lambda dy, dx: F.coalesce(P.at(d, COLS(), P.border_index(y + dy, ROWS(), P.CONSTANT), P.border_index(x + dx, COLS(), P.CONSTANT)), F.lit(0.0))
            ry, rx = F.pmod(y, F.lit(2)) == red[0], F.pmod(x, F.lit(2)) == red[1]
            cross, corners = (v(-1, 0) + v(1, 0) + v(0, -1) + v(0, 1)) / 4, (v(-1, -1) + v(-1, 1) + v(1, -1) + v(1, 1)) / 4
            across, down = (v(0, -1) + v(0, 1)) / 2, (v(-1, 0) + v(1, 0)) / 2
            if channel == 1:
                return F.when(ry == rx, cross).otherwise(v(0, 0))
            own_y, own_x = (ry, rx) if channel == 2 else (~ry, ~rx)
            return F.when(own_y & own_x, v(0, 0)).when(own_y, across).when(own_x, down).otherwise(corners)

        return lambda d, y, x: N.saturate(at(d, y, x), depth)

    channels = F.array(*[F.struct(F.lit(k).alias("c"), P.grid_over(D(), ROWS(), COLS(), value(k)).alias("data")) for k in range(3)])
    return planes.select("img", "rows", "cols", F.explode(channels).alias("_o")).select("img", "_o.c", "rows", "cols", "_o.data")


def rotation_matrix(center: tuple[float, float], degrees: float, scale: float) -> np.ndarray:
    x, y = (float(np.float32(v)) for v in center)
    a, b = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    return np.array([[a, b, (1 - a) * x - b * y], [-b, a, b * x + (1 - a) * y]])


def affine_from_points(source: Sequence[Sequence[float]], target: Sequence[Sequence[float]]) -> np.ndarray:
    """The 2 x 3 matrix that takes three points to three; zeros for points on a line, NaN for any that is not finite."""
    s, t = np.array(source, float), np.array(target, float)
    if not (np.isfinite(s).all() and np.isfinite(t).all()):
        return np.full((2, 3), np.nan)
    a = np.column_stack([s, np.ones(3)])
    return np.zeros((2, 3)) if abs(np.linalg.det(a)) < 1e-12 else np.linalg.solve(a, t).T


def invert_affine(matrix: Sequence[Sequence[float]]) -> np.ndarray:
    (a, b, c), (d, e, f) = np.array(matrix, float)
    det = a * e - b * d
    inv = 1 / det if det else 0.0
    return np.array([[e * inv, -b * inv, (b * f - e * c) * inv], [-d * inv, a * inv, (d * c - a * f) * inv]])


def nearly_flat(pairs: np.ndarray) -> np.ndarray:
    """For sets (n, 4, (x, y, u, v)) of finite points: whether three source or three target points are on a line, or nearly."""
    turn = np.ones((len(pairs), 2))  # the least triangle of the source and of the target points
    p = _centred(pairs)
    for at in ([1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]):
        a, b = p[:, at[1]] - p[:, at[0]], p[:, at[2]] - p[:, at[0]]
        turn = np.minimum(turn, np.abs(a[:, ::2] * b[:, 1::2] - a[:, 1::2] * b[:, ::2]))
    return turn.min(axis=1) < 1e-6


def _centred(pairs: np.ndarray) -> np.ndarray:
    p = pairs - pairs.mean(axis=1, keepdims=True)
    for k in (0, 2):
        extent = np.abs(p[:, :, k : k + 2]).max(axis=(1, 2), keepdims=True)
        p[:, :, k : k + 2] /= np.where(extent > 0, extent, 1.0)
    return p


def undetermined(pairs: np.ndarray) -> np.ndarray:
    """For sets (n, 4, (x, y, u, v)) of finite points: whether more than one map takes the four points to the four.

    That is, whether their eight equations in nine unknowns have a rank under 8: all source or all target points on a
    line, two equal source points, or three points on a line that go to three on a line. What counts as zero is 1e-12 of
    the points' extent.
    """
    out = np.zeros(len(pairs), bool)
    flat = np.flatnonzero(nearly_flat(pairs))  # without three points on a line the map is the only one
    x, y, u, v = _centred(pairs[flat]).transpose(2, 0, 1)
    one, none = np.ones_like(x), np.zeros_like(x)
    rows = [np.stack([x, y, one, none, none, none, -u * x, -u * y, -u], -1), np.stack([none, none, none, x, y, one, -v * x, -v * y, -v], -1)]
    if len(flat):
        size = np.linalg.svd(np.concatenate(rows, 1), compute_uv=False)
        out[flat] = size[:, -1] <= 1e-12 * size[:, 0]
    return out


def perspective_from_points(source: Sequence[Sequence[float]], target: Sequence[Sequence[float]]) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four; zeros where they don't determine it, NaN where one isn't finite."""
    s, t = np.array(source, float), np.array(target, float)
    if not (np.isfinite(s).all() and np.isfinite(t).all()):
        return np.full((3, 3), np.nan)
    if undetermined(np.concatenate([s, t], axis=1)[None])[0]:
        return np.zeros((3, 3))
    rows = []
    for (x, y), (u, v) in zip(s, t, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    a = np.array(rows)
    if np.linalg.matrix_rank(a[:, :8]) == 8:
        return np.append(np.linalg.solve(a[:, :8], a[:, 8]), 1).reshape(3, 3)
    return np.linalg.svd(np.column_stack([a[:, :8], -a[:, 8]]))[2][-1].reshape(3, 3)
