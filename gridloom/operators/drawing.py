"""Drawing: shapes become masks of a plane's pixels, and the masked pixels take the colour of the plane's channel."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from gridloom.operators.kernels import per_plane

Point = tuple[float, float]


def _set(m: np.ndarray, x: int, y: int) -> None:
    if 0 <= y < m.shape[0] and 0 <= x < m.shape[1]:
        m[y, x] = True


def _pixels(a: Point, b: Point, shape: tuple[int, int], reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of the line from its left end to its right one, as far as they are within `reach` of the image.

    The longer axis goes pixel by pixel; the other has moved as often as half the longer side, taken as the first error,
    has been used up, so each pixel is known without those before it.
    """
    (x, y), (u, v) = sorted((tuple(map(int, p)) for p in (a, b)), key=lambda p: p[0]) if a[0] != b[0] else (tuple(map(int, p)) for p in (a, b))
    steep = abs(v - y) >= u - x
    start, end, other, far, size = (y, v, x, u, shape[0]) if steep else (x, u, y, v, shape[1])
    sign, length, rise = (1 if end >= start else -1), abs(end - start), abs(far - other)
    low, high = ((-reach - start), (size - 1 + reach - start)) if sign > 0 else ((start - size + 1 - reach), (start + reach))
    k = np.arange(max(0, low), min(length, high) + 1)
    moved = -((length // 2 - k * rise) // length) if length else np.zeros(len(k), int)
    along, across = start + sign * k, other + (1 if far >= other else -1) * np.maximum(moved, 0)
    return (along, across) if steep else (across, along)


def _line(m: np.ndarray, a: Point, b: Point, thickness: int = 1) -> None:
    reach = (thickness + 1) // 2 if thickness > 1 else 0
    y, x = _pixels(a, b, m.shape, reach)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if dx * dx + dy * dy <= reach * reach:
                q, p = y + dy, x + dx
                inside = (q >= 0) & (q < m.shape[0]) & (p >= 0) & (p < m.shape[1])
                m[q[inside], p[inside]] = True


def clipped(a: Point, b: Point, rows: int, cols: int) -> tuple[Point, Point] | None:
    """The ends of a line moved onto the image's edge, the first one first; None where the line surely misses it. Whole
    numbers, cut towards zero."""
    ends, size = [[int(v) for v in p] for p in (a, b)], (cols, rows)
    beyond = lambda p, axis: -1 if p[axis] < 0 else 1 if p[axis] >= size[axis] else 0
    while True:
        if any(beyond(ends[0], k) * beyond(ends[1], k) > 0 for k in (0, 1)):
            return None
        out = [(p, o, k) for p, o in (ends, ends[::-1]) for k in (0, 1) if beyond(p, k)]
        if not out:
            return tuple(ends[0]), tuple(ends[1])
        p, o, k = out[0]
        edge = 0 if p[k] < 0 else size[k] - 1
        top, bottom = (edge - p[k]) * (o[1 - k] - p[1 - k]), o[k] - p[k]
        p[1 - k] += abs(top) // abs(bottom) * (1 if (top >= 0) == (bottom > 0) else -1)
        p[k] = edge


def _disc(m: np.ndarray, center: Point, radius: float) -> None:
    y, x = np.indices(m.shape)
    m |= (x - center[0]) ** 2 + (y - center[1]) ** 2 <= radius**2


def _ring(m: np.ndarray, center: Point, radius: int) -> None:
    x, y, d = radius, 0, 1 - radius
    while x >= y:
        for a, b in ((x, y), (y, x), (-x, y), (-y, x), (x, -y), (y, -x), (-x, -y), (-y, -x)):
            _set(m, int(center[0]) + a, int(center[1]) + b)
        y += 1
        if d < 0:
            d += 2 * y + 1
        else:
            x -= 1
            d += 2 * (y - x) + 1


def _polygon(m: np.ndarray, points: Sequence[Point], outline: bool = True) -> None:
    """Even-odd filling, scan line by scan line."""
    n = len(points)
    for y in range(m.shape[0]):
        cuts = []
        for (x0, y0), (x1, y1) in ((points[k], points[(k + 1) % n]) for k in range(n)):
            if (y0 <= y) != (y1 <= y):
                cuts.append(x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        cuts.sort()
        for a, b in zip(cuts[::2], cuts[1::2], strict=False):
            m[y, max(0, math.ceil(a)) : max(0, math.floor(b) + 1)] = True
    if outline:
        for k in range(n):
            _line(m, points[k], points[(k + 1) % n])


def painted(planes: DataFrame, shape: Callable[[np.ndarray], None], color: Sequence[float]) -> DataFrame:
    """Planes with the pixels that `shape` marks in the colour's entry of their channel (0 beyond its end)."""
    from pyspark.sql import functions as F

    values = F.coalesce(F.get(F.array(*[F.lit(float(v)) for v in color]), F.col("c")), F.lit(0.0))

    def run(a: np.ndarray, value: float) -> list[tuple]:
        m = np.zeros(a.shape, bool)
        shape(m)
        return [(*a.shape, np.where(m, value, a).ravel().tolist())]

    return per_plane(planes.withColumn("_v", values), run, "rows int, cols int, data array<double>", ["_v"])


def line(planes: DataFrame, a: Point, b: Point, color: Sequence[float], thickness: int = 1) -> DataFrame:
    """A line, clipped to the image before it is drawn; thick ones are discs at every pixel of the thin one."""

    def shape(m: np.ndarray) -> None:
        if seen := clipped(a, b, *m.shape):
            _line(m, *seen, thickness)

    return painted(planes, shape, color)


def rectangle(planes: DataFrame, a: Point, b: Point, color: Sequence[float], thickness: int = 1) -> DataFrame:
    x0, x1, y0, y1 = min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])

    def shape(m: np.ndarray) -> None:
        y, x = np.indices(m.shape)
        inside = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
        m |= inside if thickness < 0 else inside & ((x == x0) | (x == x1) | (y == y0) | (y == y1))

    return painted(planes, shape, color)


def circle(planes: DataFrame, center: Point, radius: int, color: Sequence[float], thickness: int = 1) -> DataFrame:
    return painted(planes, (lambda m: _disc(m, center, radius)) if thickness < 0 else (lambda m: _ring(m, center, radius)), color)


def ellipse_points(center: Point, axes: Point, rotation: float, start: float, end: float, delta: float) -> list[tuple[int, int]]:
    """Vertices at every delta degrees and at the end angle; repeated ones once."""
    turn, out = math.radians(rotation), []
    angles = [*np.arange(start, end, delta), end]
    for t in map(math.radians, angles):
        x, y = axes[0] * math.cos(t), axes[1] * math.sin(t)
        p = (round(center[0] + x * math.cos(turn) - y * math.sin(turn)), round(center[1] + x * math.sin(turn) + y * math.cos(turn)))
        if not out or out[-1] != p:
            out.append(p)
    return out


def polylines(planes: DataFrame, lines: Sequence[Sequence[Point]], closed: bool, color: Sequence[float], thickness: int = 1) -> DataFrame:
    def shape(m: np.ndarray) -> None:
        for points in lines:
            for a, b in zip(points, [*points[1:], *points[:1]] if closed else points[1:], strict=False):
                _line(m, a, b, thickness)

    return painted(planes, shape, color)


def ellipse(planes: DataFrame, center: Point, axes: Point, rotation: float, start: float, end: float, color: Sequence[float]) -> DataFrame:
    return polylines(planes, [ellipse_points(center, axes, rotation, start, end, 1.0)], False, color)


def fill_poly(planes: DataFrame, polygons: Sequence[Sequence[Point]], color: Sequence[float], offset: Point = (0, 0)) -> DataFrame:
    def shape(m: np.ndarray) -> None:
        for points in polygons:
            _polygon(m, [(x + offset[0], y + offset[1]) for x, y in points])

    return painted(planes, shape, color)


def fill_convex_poly(planes: DataFrame, points: Sequence[Point], color: Sequence[float]) -> DataFrame:
    return fill_poly(planes, [points], color)


def draw_marker(planes: DataFrame, at: Point, color: Sequence[float], tilted: bool = False, size: int = 20) -> DataFrame:
    (x, y), arm = at, size // 2 - 1
    arms = [((x - arm, y - arm), (x + arm, y + arm)), ((x - arm, y + arm), (x + arm, y - arm))] if tilted else [((x - arm, y), (x + arm, y)), ((x, y - arm), (x, y + arm))]
    return polylines(planes, arms, False, color)


def arrowed_line(planes: DataFrame, a: Point, b: Point, color: Sequence[float], tip: float = 0.1) -> DataFrame:
    size, back = math.hypot(b[0] - a[0], b[1] - a[1]) * tip, math.atan2(a[1] - b[1], a[0] - b[0])
    ends = [(round(b[0] + size * math.cos(back + s * math.pi / 6)), round(b[1] + size * math.sin(back + s * math.pi / 6))) for s in (1, -1)]
    return polylines(planes, [(a, b), (b, ends[0]), (b, ends[1])], False, color)


def draw_contours(planes: DataFrame, contours: Sequence[Sequence[Point]], which: int, color: Sequence[float], thickness: int = 1, offset: Point = (0, 0)) -> DataFrame:
    """One contour, or all with a negative number; filled with a negative thickness."""
    used = [[(x + offset[0], y + offset[1]) for x, y in c] for k, c in enumerate(contours) if which < 0 or k == which]
    return fill_poly(planes, used, color) if thickness < 0 else polylines(planes, used, True, color)


def draw_frame_axes(planes: DataFrame, camera, distortion: Sequence[float], rotation: Sequence[float], translation: Sequence[float], length: float, thickness: int = 3) -> DataFrame:
    """The axes of a frame seen by a camera, in planes of blue, green and red: x red, y green, z blue."""
    from gridloom.operators.calibration import _coefficients, rodrigues

    if length <= 0 or thickness <= 0:
        raise ValueError("length and thickness are positive")
    k1, k2, p1, p2, k3, *_ = _coefficients(distortion)

    def seen(p: Sequence[float]) -> Point:
        x, y, z = rodrigues(rotation) @ np.array(p, float) + np.array(translation, float)
        x, y = (x / z, y / z) if z else (x, y)
        r = x * x + y * y
        bend = 1 + k1 * r + k2 * r * r + k3 * r**3
        u, v = x * bend + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * bend + p1 * (r + 2 * y * y) + 2 * p2 * x * y
        return round(u * camera[0][0] + camera[0][2]), round(v * camera[1][1] + camera[1][2])

    origin = seen((0, 0, 0))
    for axis, color in ((0, (0, 0, 255)), (1, (0, 255, 0)), (2, (255, 0, 0))):
        planes = line(planes, origin, seen([length if k == axis else 0 for k in range(3)]), color, thickness)
    return planes
