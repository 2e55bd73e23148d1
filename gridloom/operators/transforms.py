"""Matrices, shapes and maps of rows: each row's own numbers go in as columns, and what is made of them comes out as one.

Nothing here joins or shuffles but `group_rectangles`, whose unit is a set. What Spark's functions can't say (singular
vectors, roots, clipping of polygons) is numpy over Arrow batches of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from gridloom.functions.planes import let
from gridloom.operators import calibration, geometry
from gridloom.operators import resampling as S
from gridloom.operators.consensus import solved
from gridloom.operators.linear import FONT_HEIGHTS

Spot = tuple[Column, Column]
# types as objects: their names could only be read with a session at hand
_NUMBERS = Y.ArrayType(Y.DoubleType())


def _record(*names: str) -> Y.StructType:
    return Y.StructType([Y.StructField(n, Y.DoubleType()) for n in names])


def _at(values: Column, *places: int) -> list[Column]:
    return [F.get(values, F.lit(k)) for k in places or range(9)]


def rotation_matrix(center: Spot, degrees: Column, scale: Column) -> Column:
    """The 2 x 3 matrix, row by row, of a turn and a scale about a centre of single precision."""
    x, y = (v.cast("float").cast("double") for v in center)
    a, b = scale * F.cos(F.radians(degrees)), scale * F.sin(F.radians(degrees))
    return F.array(a, b, (1 - a) * x - b * y, -b, a, b * x + (1 - a) * y)


def affine_from_points(source: Sequence[Spot], target: Sequence[Spot]) -> Column:
    """The 2 x 3 matrix that takes three points to three; zeros for points on a line, NaN where one isn't finite."""
    (x0, y0), (x1, y1), (x2, y2) = source
    x1, y1, x2, y2 = x1 - x0, y1 - y0, x2 - x0, y2 - y0
    det = x1 * y2 - x2 * y1
    size = F.when(F.abs(det) < 1e-12, F.lit(None)).otherwise(det)
    cells = []
    for k in range(2):
        t0, t1, t2 = target[0][k], target[1][k] - target[0][k], target[2][k] - target[0][k]
        a, b = (t1 * y2 - t2 * y1) / size, (x1 * t2 - x2 * t1) / size
        cells += [a, b, t0 - a * x0 - b * y0]
    wild = [F.isnan(v) | (F.abs(v) == float("inf")) for p in (*source, *target) for v in p]
    odd = wild[0]
    for w in wild[1:]:
        odd = odd | w
    flat = F.abs(det) < 1e-12
    return F.when(odd, F.array(*[F.lit(math.nan)] * 6)).when(flat, F.array(*[F.lit(0.0)] * 6)).otherwise(F.array(*cells))


def invert_affine(matrix: Column) -> Column:
    """The inverse of a 2 x 3 matrix; zeros where there is none."""
    a, b, c, d, e, f = _at(matrix, *range(6))
    det = a * e - b * d
    inv = F.when(det == 0, F.lit(0.0)).otherwise(1 / F.when(det == 0, F.lit(1.0)).otherwise(det))
    return F.array(e * inv, -b * inv, (b * f - e * c) * inv, -d * inv, a * inv, (d * c - a * f) * inv)


def _equations(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The systems of eight numbers of the matrices of sets (n, 4, (x, y, u, v)), in the precision of p."""
    x, y, u, v = p.transpose(2, 0, 1)
    one, none = np.ones_like(x), np.zeros_like(x)
    rows = [np.stack([x, y, one, none, none, none, -u * x, -u * y], -1), np.stack([none, none, none, x, y, one, -v * x, -v * y], -1)]
    return np.concatenate(rows, 1), np.concatenate([u, v], 1)


def _refined(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Solutions h of sets p with what two rounds add to them, from residuals in extended precision."""
    left = _equations(p)[0]
    a, b = _equations(p.astype(np.longdouble))
    h = h.astype(np.longdouble)
    for _ in range(2):
        h = h + solved(left, (b - (a * h[:, None]).sum(axis=2))[:, :, None])[:, :, 0]
    return h.astype(float)


@F.pandas_udf(_NUMBERS)
def _perspectives(points: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in points:
        out: list = [None] * len(series)
        known = [k for k, v in enumerate(series) if v is not None]
        if known:
            p = np.stack([np.asarray(series.iloc[k], float) for k in known]).reshape(-1, 4, 4)
            whole = np.isfinite(p).all(axis=(1, 2))
            finite = np.where(whole[:, None, None], p, 0.0)
            # rounding would decide which of many matrices they get
            loose = S.undetermined(finite) & whole
            with np.errstate(all="ignore"):
                a, b = _equations(finite)
                h = solved(a, b[:, :, None])[:, :, 0]
                h[~whole] = np.nan
                flat = np.flatnonzero(S.nearly_flat(finite) & ~loose & np.isfinite(h).all(axis=1))
                h[flat] = _refined(h[flat], p[flat])
            for n, k in enumerate(known):
                if loose[n]:
                    out[k] = [0.0] * 9
                    continue
                # what the elimination can't settle is one matrix at a time
                out[k] = [*h[n].tolist(), 1.0] if np.isfinite(h[n]).all() else S.perspective_from_points(p[n, :, :2], p[n, :, 2:]).ravel().tolist()
        yield pd.Series(out, dtype=object)


def perspective_from_points(source: Sequence[Spot], target: Sequence[Spot]) -> Column:
    """The 3 x 3 matrix that takes four points to four; zeros where they don't determine it, NaN where one isn't finite."""
    made = _perspectives(F.array(*[v.cast("double") for s, t in zip(source, target, strict=True) for v in (*s, *t)]))
    # NaN comes back from Arrow as null
    return F.transform(made, lambda v: F.coalesce(v, F.lit(math.nan)))


def rodrigues(vector: Column) -> Column:
    """The 3 x 3 rotation matrix of a rotation vector."""
    same = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])

    def turn(v: Column) -> Column:
        x, y, z, c, s, d = _at(v, *range(6))
        return F.array(c + d * x * x, d * x * y - s * z, d * x * z + s * y, d * x * y + s * z, c + d * y * y, d * y * z - s * x, d * x * z - s * y, d * y * z + s * x, c + d * z * z)

    def about(v: Column) -> Column:
        *r, theta = _at(v, *range(4))
        return F.when(theta <= 1e-14, same).otherwise(let(F.array(*[x / theta for x in r], F.cos(theta), F.sin(theta), 1 - F.cos(theta)), turn))

    # bound, because the nine cells would take the root, sine and cosine anew
    r = _at(vector, 0, 1, 2)
    return let(F.array(*r, F.sqrt(r[0] * r[0] + r[1] * r[1] + r[2] * r[2])), about)


@F.pandas_udf(_NUMBERS)
def rotation_vector(matrix: pd.Series) -> pd.Series:
    """The rotation vector of the rotation matrix nearest to a 3 x 3 matrix."""
    return pd.Series([None if m is None else calibration.rotation_vector(np.asarray(m, float).reshape(3, 3)).tolist() for m in matrix], dtype=object)


def default_new_camera_matrix(camera: Column, width: Column, height: Column, center: Column | bool) -> Column:
    """The 3 x 3 camera, its principal point moved to the middle of an image of that size where `center` is true."""
    fx, a, cx, b, fy, cy, *last = _at(camera)
    moved = F.lit(center) if isinstance(center, bool) else center
    return F.array(fx, a, F.when(moved, (width - 1) / 2).otherwise(cx), b, fy, F.when(moved, (height - 1) / 2).otherwise(cy), *last)


def undistort_maps(cameras: DataFrame, rows: int, cols: int, fisheye: bool = False) -> DataFrame:
    """(id, y, x, map_x, map_y): where each pixel of an image without distortion lies in each camera's image.

    cameras: (id, fx, fy, cx, cy, d array<double>), d being k1 k2 p1 p2, or the four of a fisheye lens; missing ones are 0.
    """
    k1, k2, p1, p2 = (F.coalesce(v, F.lit(0.0)) for v in _at(F.col("d"), 0, 1, 2, 3))
    at = cameras.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    at = at.withColumns({"y": F.floor(F.col("_n") / cols).cast("int"), "x": F.pmod("_n", F.lit(cols)).cast("int")})
    at = at.withColumns({"_x": (F.col("x") - F.col("cx")) / F.col("fx"), "_y": (F.col("y") - F.col("cy")) / F.col("fy")})
    x, y = F.col("_x"), F.col("_y")
    r2 = x * x + y * y
    if fisheye:
        r = F.sqrt(r2)
        t = F.atan(r)
        t2 = t * t
        bent = t * (1 + k1 * t2 + k2 * t2 * t2 + p1 * t2 * t2 * t2 + p2 * t2 * t2 * t2 * t2)
        s = F.when(r == 0, F.lit(1.0)).otherwise(bent / F.when(r == 0, F.lit(1.0)).otherwise(r))
        u, v = x * s, y * s
    else:
        s = 1 + k1 * r2 + k2 * r2 * r2
        u, v = x * s + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * s + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return at.select("id", "y", "x", (u * F.col("fx") + F.col("cx")).alias("map_x"), (v * F.col("fy") + F.col("cy")).alias("map_y"))


def hanning_window(rows: Column, cols: Column) -> Column:
    """The window of that size, row by row; null for sides under 2."""
    side = lambda k, n: 0.5 * (1 - F.cos(k * (2 * math.pi) / (n - 1)))
    cells = F.transform(F.sequence(F.lit(0), (rows * cols).cast("int") - 1), lambda i: F.sqrt(side(F.floor(i / cols), rows) * side(F.pmod(i, cols), cols)))
    return F.when((rows >= 2) & (cols >= 2), cells)


def font_scale(face: Column, pixels: Column, thickness: Column) -> Column:
    """The scale at which a face, upright or slanted (+ 16), has that height; null for other faces."""
    upright = face.bitwiseAND(F.lit(~16))
    height = F.get(F.array(*[F.lit(float(h)) for h in FONT_HEIGHTS]), F.when(upright >= 0, upright))
    return (pixels - (F.greatest(thickness, F.lit(-1)) + 1) / 2) / height


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each list begins in the values, how many it has (null: 0), and the values."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = column.offsets.to_numpy().astype(np.int64)
    return at[:-1], n, column.values


def _listed(n: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=None if null is None else pa.array(null))


@F.arrow_udf(Y.ArrayType(_record("re", "im")))
def solve_poly(coefficients: pa.Array) -> pa.Array:
    """The roots of polynomials with ascending coefficients, by real and then imaginary part.

    They are eigenvalues of companion matrices, taken for all polynomials of a batch that have one degree at once.
    """
    at, n, values = _lists(coefficients)
    c = np.append(values.to_numpy(zero_copy_only=False).astype(float), 0.0)
    width = int(n.max(initial=0))
    inside = np.arange(width) < n[:, None]
    # by falling power, the leading zeros and those at the end (roots at 0) apart
    grid = np.where(inside, c[np.where(inside, at[:, None] + n[:, None] - 1 - np.arange(width), len(c) - 1)], 0.0)
    some = grid != 0
    known = some.any(axis=1) if width else np.zeros(len(n), bool)
    first = some.argmax(axis=1) if width else np.zeros(len(n), int)
    last = width - 1 - some[:, ::-1].argmax(axis=1) if width else first
    degree, zeros = np.where(known, last - first, 0), np.where(known, n - 1 - last, 0)
    roots = np.full((len(n), max(width, 1)), np.inf, complex)
    for d in np.unique(degree[degree > 0]):
        rows = np.flatnonzero(degree == d)
        p = grid[rows[:, None], first[rows, None] + np.arange(d + 1)]
        m = np.zeros((len(rows), d, d))
        m[:, np.arange(1, d), np.arange(d - 1)] = 1
        m[:, 0] = -p[:, 1:] / p[:, :1]
        roots[rows, :d] = np.linalg.eigvals(m)
    total, place = degree + zeros, np.arange(roots.shape[1])
    roots[(place >= degree[:, None]) & (place < total[:, None])] = 0
    found = np.sort(roots, axis=1)[place < total[:, None]]
    pair = pa.StructArray.from_arrays([pa.array(found.real.copy()), pa.array(found.imag.copy())], ["re", "im"])
    return _listed(total, pair, coefficients.is_null().to_numpy(zero_copy_only=False))


def ellipse_points(center: Spot, axes: Spot, rotation: Column, start: Column, end: Column, delta: Column) -> Column:
    """array<struct<x, y>>: whole vertices at every delta degrees and at the end angle; repeated ones once."""
    turn = F.radians(rotation)
    steps = F.ceil((end - start) / delta).cast("int")

    def vertex(k: Column) -> Column:
        t = F.radians(F.when(k == steps, end.cast("double")).otherwise(start + k * delta))
        x, y = axes[0] * F.cos(t), axes[1] * F.sin(t)
        place = center[0] + x * F.cos(turn) - y * F.sin(turn), center[1] + x * F.sin(turn) + y * F.cos(turn)
        return F.struct(*[F.rint(v).cast("long").alias(n) for n, v in zip("xy", place, strict=True)])

    corners = F.transform(F.sequence(F.lit(0), steps), vertex)
    # a one-element array carries the vertices into the lambda, so that they are made once
    return F.get(F.transform(F.array(corners), lambda all_: F.filter(all_, lambda p, k: (k == 0) | (p != F.get(all_, k - 1)))), F.lit(0))


def corners(center: Spot, size: Spot, degrees: Column) -> Column:
    """array<struct<x, y>> of a turned rectangle."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    w, h = size[0] / 2, size[1] / 2
    place = lambda i, j: F.struct((center[0] + i * w * c - j * h * s).alias("x"), (center[1] + i * w * s + j * h * c).alias("y"))
    return F.array(place(-1, -1), place(1, -1), place(1, 1), place(-1, 1))


def _polygons(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Corners (polygons, most, 2) and their numbers."""
    at, n, values = _lists(column)
    xy = np.stack([np.append(values.field(k).to_numpy(zero_copy_only=False).astype(float), 0.0) for k in ("x", "y")], -1)
    inside = np.arange(max(1, n.max(initial=0))) < n[:, None]
    return xy[np.where(inside, at[:, None] + np.arange(inside.shape[1]), len(xy) - 1)], n


def _next(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    i = np.arange(1, p.shape[1] + 1)
    return np.take_along_axis(p, np.where(i < n[:, None], i, 0)[..., None], 1)


def _signed_areas(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    q = _next(p, n)
    return np.where(np.arange(p.shape[1]) < n[:, None], p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1], 0.0).sum(axis=1) / 2


@F.arrow_udf(Y.StructType([Y.StructField("area", Y.DoubleType()), Y.StructField("corners", Y.ArrayType(_record("x", "y")))]))
def intersect_convex(a: pa.Array, b: pa.Array) -> pa.Array:
    """The area and corners of the common part of two convex polygons (array<struct<x, y>>); null is a polygon without corners.

    All polygons of a batch are clipped at the first side of the other, then at the second, and so on.
    """
    (p, n), (q, k) = _polygons(a), _polygons(b)
    n = np.where(k > 0, n, 0)
    i = np.arange(q.shape[1])
    turned = (_signed_areas(q, k) < 0)[:, None] & (i < k[:, None])
    q = np.take_along_axis(q, np.where(turned, k[:, None] - 1 - i, i)[..., None], 1)
    ends = _next(q, k)
    for j in range(q.shape[1]):
        here, x0, y0, x1, y1 = ((j < k)[:, None], *(v[:, None] for v in (*q[:, j].T, *ends[:, j].T)))
        real = np.arange(p.shape[1]) < n[:, None]
        s = (x1 - x0) * (p[..., 1] - y0) - (y1 - y0) * (p[..., 0] - x0)
        then = _next(p, n)
        t = (x1 - x0) * (then[..., 1] - y0) - (y1 - y0) * (then[..., 0] - x0)
        cut = real & here & (((s > 0) & (t < 0)) | ((s < 0) & (t > 0)))
        r = np.where(cut, s, 0.0) / np.where(cut, s - t, 1.0)
        kept = np.stack([real & ((s >= 0) | ~here), cut], -1).reshape(len(p), -1)
        spots = np.stack([p, p + r[..., None] * (then - p)], 2).reshape(len(p), -1, 2)
        n = kept.sum(axis=1)
        p = np.zeros((len(p), max(1, n.max(initial=0)), 2))
        rows, places = np.nonzero(kept)
        p[rows, (np.cumsum(kept, axis=1) - 1)[rows, places]] = spots[rows, places]
    flat = p[np.arange(p.shape[1]) < n[:, None]]
    corners = _listed(n, pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["x", "y"]))
    return pa.StructArray.from_arrays([pa.array(np.abs(_signed_areas(p, n))), corners], ["area", "corners"])


def group_rectangles(rects: DataFrame, eps: float = 0.2) -> DataFrame:
    """(set_id, place, x, y, width, height) of rectangles (set_id, pos, x, y, width, height): averaged pair by pair, in
    the order of pos, until no two of a set are similar. A set is one task's group, as it is one picture's finds."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept = geometry.group_rectangles(rows.sort_values("pos")[["x", "y", "width", "height"]].to_numpy(float), eps)
        return pd.DataFrame([(rows["set_id"].iloc[0], k, *r) for k, r in enumerate(kept)], columns=["set_id", "place", "x", "y", "width", "height"])

    return rects.select("set_id", "pos", "x", "y", "width", "height").groupBy("set_id").applyInPandas(run, f"set_id {rects.schema['set_id'].dataType.simpleString()}, place int, x long, y long, width long, height long")
