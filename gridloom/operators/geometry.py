"""Contours and point sets: rows (set_id, pos, x, y). Sums over a set are windows and aggregates; what needs a whole set
in order, a hull or a fit, is numpy per set."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _in_order():
    return Window.partitionBy("set_id").orderBy("pos")


def edges(points: DataFrame, closed: bool = True) -> DataFrame:
    """(set_id, pos, x, y, u, v): every point with the one after it; the last with the first where the curve is closed."""
    whole = _in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.lead(c).over(_in_order())
    rows = points.select("set_id", "pos", "x", "y", *[(F.coalesce(after(c), F.first(c).over(whole)) if closed else after(c)).alias(n) for c, n in (("x", "u"), ("y", "v"))])
    return rows if closed else rows.where("u IS NOT NULL")


def arc_length(points: DataFrame, closed: bool) -> DataFrame:
    """(set_id, length)."""
    sides = edges(points, closed).groupBy("set_id").agg(F.sum(F.sqrt((F.col("u") - F.col("x")) ** 2 + (F.col("v") - F.col("y")) ** 2)).alias("length"))
    return points.select("set_id").distinct().join(sides, "set_id", "left").select("set_id", F.coalesce("length", F.lit(0.0)).alias("length"))


def contour_area(points: DataFrame, oriented: bool = False) -> DataFrame:
    """(set_id, area); fewer than three points have none."""
    area = F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y")) / 2
    area = F.when(F.count(F.lit(1)) < 3, F.lit(0.0)).otherwise(area if oriented else F.abs(area))
    return edges(points).groupBy("set_id").agg(area.alias("area"))


def bounding_rect(points: DataFrame) -> DataFrame:
    """(set_id, x, y, width, height) in whole pixels, both ends included."""
    low, high = (lambda c: F.floor(F.min(c))), (lambda c: F.floor(F.max(c)))
    return points.groupBy("set_id").agg(low("x").alias("x"), low("y").alias("y"), (high("x") - low("x") + 1).alias("width"), (high("y") - low("y") + 1).alias("height"))


def is_contour_convex(points: DataFrame) -> DataFrame:
    """(set_id, convex): all turns to one side; a straight one makes it false."""
    e = edges(points)
    whole = _in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dx, dy = F.col("u") - F.col("x"), F.col("v") - F.col("y")
    e = e.select("set_id", "pos", dx.alias("dx"), dy.alias("dy"))
    e = e.select("set_id", (F.col("dx") * F.coalesce(F.lead("dy").over(_in_order()), F.first("dy").over(whole)) - F.col("dy") * F.coalesce(F.lead("dx").over(_in_order()), F.first("dx").over(whole))).alias("t"))
    return e.groupBy("set_id").agg(((F.min("t") > 0) | (F.max("t") < 0)).alias("convex"))


def point_polygon_test(points: DataFrame, at: tuple[float, float], measure: bool = False) -> DataFrame:
    """(set_id, result): 1 inside, -1 outside, 0 on the edge, or that times the distance to the nearest edge."""
    if not all(map(math.isfinite, at)):
        return points.select("set_id").distinct().withColumn("result", F.lit(-math.sqrt(3.4028234663852886e38) if measure else -1.0))
    px, py = at
    x, y, u, v = (F.col(c) for c in "xyuv")
    dx, dy = u - x, v - y
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(size == 0, F.lit(0.0)).otherwise(((px - x) * dx + (py - y) * dy) / F.when(size == 0, F.lit(1.0)).otherwise(size))))
    distance = (x + t * dx - px) ** 2 + (y + t * dy - py) ** 2
    crosses = ((y > py) != (v > py)) & (px < x + (py - y) * dx / F.when(dy == 0, F.lit(1.0)).otherwise(dy))
    s = edges(points).groupBy("set_id").agg(F.min(distance).alias("_d"), F.sum(crosses.cast("int")).alias("_n"))
    sign = F.when(F.col("_d") == 0, F.lit(0.0)).when(F.col("_n") % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return s.select("set_id", (sign * F.sqrt("_d") if measure else sign).alias("result"))


def fit_line(points: DataFrame) -> DataFrame:
    """(set_id, vx, vy, x0, y0): least squares of the distances; vx is not negative."""
    s = points.groupBy("set_id").agg(F.avg("x").alias("x0"), F.avg("y").alias("y0"), F.covar_pop("x", "y").alias("_xy"), F.var_pop("x").alias("_xx"), F.var_pop("y").alias("_yy"))
    t = F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy")) / 2
    sign = F.when(F.cos(t) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return s.select("set_id", (sign * F.cos(t)).alias("vx"), (sign * F.sin(t)).alias("vy"), "x0", "y0")


def clip_line(lines: DataFrame, width: float, height: float, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """Segments (x0, y0, x1, y1) with `visible` and the clipped ends cx0 .. cy1, by the parameters at which they cross the sides."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low, high, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for d, q in ((-dx, F.col("x0") - x), (dx, x + width - 1 - F.col("x0")), (-dy, F.col("y0") - y), (dy, y + height - 1 - F.col("y0"))):
        r = q / F.when(d == 0, F.lit(1.0)).otherwise(d)
        low, high, out = F.when(d < 0, F.greatest(low, r)).otherwise(low), F.when(d > 0, F.least(high, r)).otherwise(high), out | ((d == 0) & (q < 0))
    seen = ~out & (low <= high)
    ends = {"cx0": F.col("x0") + low * dx, "cy0": F.col("y0") + low * dy, "cx1": F.col("x0") + high * dx, "cy1": F.col("y0") + high * dy}
    return lines.withColumns({"visible": seen} | {k: F.when(seen, v) for k, v in ends.items()})


def per_set(points: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows (set_id, ...) that kernel(points in order, (n, 2)) gives; a set is one task's group, so it is one contour."""
    names = ["set_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        xy = rows.sort_values("pos")[["x", "y"]].to_numpy(float)
        return pd.DataFrame([(rows["set_id"].iloc[0], *r) for r in kernel(xy)], columns=names)

    return points.select("set_id", "pos", "x", "y").groupBy("set_id").applyInPandas(run, f"set_id {points.schema['set_id'].dataType.simpleString()}, {schema}")


def straight(p: np.ndarray) -> float:
    """The cross product that points' own rounding can make of nothing; up to it a turn is straight and a point on a line."""
    size, span = np.abs(p).max(axis=0), np.ptp(p, axis=0)
    return float(1e-14 * (size[0] * span[1] + size[1] * span[0]))


def hull_indices(p: np.ndarray, clockwise: bool = False) -> list[int]:
    """Indices of the hull's corners from the lexicographically least, by the monotone chain; no corner is straight()."""
    least = straight(p) if len(p) else 0.0
    order = np.lexsort((p[:, 1], p[:, 0])).tolist()
    order = [k for n, k in enumerate(order) if n == 0 or (p[k] != p[order[n - 1]]).any()]
    if len(order) < 3:
        return order
    turn = lambda a, b, c: (p[b, 0] - p[a, 0]) * (p[c, 1] - p[a, 1]) - (p[b, 1] - p[a, 1]) * (p[c, 0] - p[a, 0])
    halves = []
    for line in (order, order[::-1]):
        half: list[int] = []
        for k in line:
            while len(half) > 1 and turn(half[-2], half[-1], k) <= least:
                half.pop()
            half.append(k)
        halves.append(half[:-1])
    out = halves[0] + halves[1]
    return [out[0], *out[:0:-1]] if clockwise else out


def convex_hull(points: DataFrame, clockwise: bool = False) -> DataFrame:
    """(set_id, place, index, x, y)."""
    return per_set(points, lambda p: [(n, k, float(p[k, 0]), float(p[k, 1])) for n, k in enumerate(hull_indices(p, clockwise))], "place int, index int, x double, y double")


def convexity_defects(points: DataFrame) -> DataFrame:
    """(set_id, start, end, far, depth): the farthest point between neighbouring hull corners, the first of equally far
    ones; depth in 1/256. Distances that differ by straight() are equal, and up to it a point is on the hull."""

    def run(p: np.ndarray) -> list[tuple]:
        hull, least, out = sorted(hull_indices(p)), straight(p), []
        for a, b in zip(hull, hull[1:] + hull[:1], strict=True):
            between = [k % len(p) for k in range(a + 1, b if b > a else b + len(p))]
            d = p[b] - p[a]
            size = math.sqrt(d[0] * d[0] + d[1] * d[1])
            if between and size:
                cross = np.abs(d[0] * (p[between, 1] - p[a, 1]) - d[1] * (p[between, 0] - p[a, 0]))
                most = float(cross.max())
                if most > least:
                    k = int((cross >= most - least).argmax())
                    out.append((a, b, between[k], int(round(most / size * 256))))
        return out

    return per_set(points, run, "start int, end int, far int, depth int")


def _min_rect(p: np.ndarray) -> tuple[float, float, float, float, float]:
    h = p[hull_indices(p)]
    found = []
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        c, s = math.cos(t), math.sin(t)
        q = h @ np.array([[c, -s], [s, c]])
        low, size = q.min(0), np.ptp(q, axis=0)
        m = low + size / 2
        found.append((size[0] * size[1], m[0] * c - m[1] * s, m[0] * s + m[1] * c, size[0], size[1], math.degrees(t)))
    # as of a triangle, whose three rectangles are equal
    most = min(f[0] for f in found) * (1 + 1e-9) + straight(p)
    _, x, y, w, k, angle = next(f for f in found if f[0] <= most)
    while angle >= 0:
        angle, w, k = angle - 90, k, w
    while angle < -90:
        angle, w, k = angle + 90, k, w
    return float(x), float(y), float(w), float(k), float(angle)


def min_area_rect(points: DataFrame) -> DataFrame:
    """(set_id, x, y, width, height, angle): the smallest rectangle, one side along a hull edge, the first edge of equal
    areas (to 1e-9 and straight()) from the hull's first corner; the angle is in [-90, 0)."""
    return per_set(points, lambda p: [_min_rect(p)], "x double, y double, width double, height double, angle double")


def _circle(points: list[np.ndarray]) -> tuple[np.ndarray, float]:
    if len(points) == 1:
        return points[0], 0.0
    if len(points) == 2:
        return (points[0] + points[1]) / 2, float(np.hypot(*(points[0] - points[1])) / 2)
    a, b, c = points
    m = 2 * np.array([b - a, c - a])
    if abs(np.linalg.det(m)) < 1e-12:
        return max((_circle([p, q]) for p, q in ((a, b), (a, c), (b, c))), key=lambda x: x[1])
    center = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
    return center, float(np.hypot(*(center - a)))


def _enclosing(p: np.ndarray) -> tuple[float, float, float]:
    inside = lambda c, q: np.hypot(*(q - c[0])) <= c[1] * (1 + 1e-9) + 1e-12
    c = _circle([p[0]])
    for i in range(1, len(p)):
        if not inside(c, p[i]):
            c = _circle([p[i]])
            for j in range(i):
                if not inside(c, p[j]):
                    c = _circle([p[i], p[j]])
                    for k in range(j):
                        if not inside(c, p[k]):
                            c = _circle([p[i], p[j], p[k]])
    return float(c[0][0]), float(c[0][1]), c[1]


def min_enclosing_circle(points: DataFrame) -> DataFrame:
    """(set_id, x, y, radius)."""
    return per_set(points, lambda p: [_enclosing(p)], "x double, y double, radius double")


def min_enclosing_triangle(points: DataFrame) -> DataFrame:
    """(set_id, area, x0 .. y2): the smallest triangle of hull corners that holds all points; zeros if there is none."""

    def run(p: np.ndarray) -> list[tuple]:
        h, best = p[hull_indices(p)], (float(np.finfo(float).max), *[0.0] * 6)
        side = lambda a, b: (b[0] - a[0]) * (h[:, 1] - a[1]) - (b[1] - a[1]) * (h[:, 0] - a[0])
        for i in range(len(h)):
            for j in range(i + 1, len(h)):
                for k in range(j + 1, len(h)):
                    t = h[[i, j, k]]
                    area = abs((t[1] - t[0])[0] * (t[2] - t[0])[1] - (t[1] - t[0])[1] * (t[2] - t[0])[0]) / 2
                    if area < best[0] and all((side(t[m], t[(m + 1) % 3]) >= -1e-9).all() for m in range(3)):
                        best = (float(area), *map(float, t.ravel()))
        return [best]

    return per_set(points, run, "area double, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")


def _conic(p: np.ndarray, c: np.ndarray) -> tuple[float, ...] | None:
    """Centre, axes and angle of a x^2 + b xy + c y^2 + d x + e y + f = 0 around the mean of p."""
    a, b, k, d, e, f = c
    det = 4 * a * k - b * b
    if det <= 0:
        return None
    x, y = (b * e - 2 * k * d) / det, (b * d - 2 * a * e) / det
    g = -(f + (d * x + e * y) / 2)
    values, vectors = np.linalg.eigh(np.array([[a, b / 2], [b / 2, k]]) * (1 if g > 0 else -1))
    if (values <= 0).any():
        return None
    r = np.sqrt(abs(g) / values)
    minor = vectors[:, r.argmin()]
    angle = math.degrees(math.atan2(minor[1], minor[0])) % 180
    mean = p.mean(0)
    return float(x + mean[0]), float(y + mean[1]), float(2 * r.min()), float(2 * r.max()), float(angle)


def fit_ellipse(points: DataFrame, direct: bool = False) -> DataFrame:
    """(set_id, x, y, width, height, angle) of the ellipse of least algebraic distance, width <= height; at least five
    points. Without `direct` the conic has a + c = 1, and where that is no ellipse the smallest rectangle of the points
    stands in; with it, 4ac - b^2 = 1."""

    def run(p: np.ndarray) -> list[tuple]:
        q = p - p.mean(0)
        x, y = q.T
        if not direct:
            m = np.column_stack([x * x - y * y, x * y, x, y, np.ones(len(q))])
            s = np.linalg.lstsq(m, -y * y, rcond=None)[0]
            found = _conic(p, np.array([s[0], s[1], 1 - s[0], s[2], s[3], s[4]]))
            return [found or _min_rect(p)]
        d1, d2 = np.column_stack([x * x, x * y, y * y]), np.column_stack([x, y, np.ones(len(q))])
        s1, s2, s3 = d1.T @ d1, d1.T @ d2, d2.T @ d2
        t = -np.linalg.pinv(s3) @ s2.T
        m = s1 + s2 @ t
        vectors = np.linalg.eig(np.array([m[2] / 2, -m[1], m[0] / 2]))[1]
        v = vectors.real
        ok = np.flatnonzero(4 * v[0] * v[2] - v[1] ** 2 > 0)
        found = _conic(p, np.concatenate([v[:, ok[0]], t @ v[:, ok[0]]])) if len(ok) else None
        return [found or _min_rect(p)]

    return per_set(points, run, "x double, y double, width double, height double, angle double")


#: The approximate-mean-square fit always meets a rank test and gives the direct one.
def fit_ellipse_ams(points: DataFrame) -> DataFrame:
    return fit_ellipse(points, True)


def _split(p: np.ndarray, a: int, b: int, epsilon: float) -> list[int]:
    if b - a < 2:
        return []
    d, q = p[b] - p[a], p[a + 1 : b] - p[a]
    size = math.hypot(*d)
    far = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / size if size else np.hypot(*q.T)
    k = a + 1 + int(far.argmax())
    return [*_split(p, a, k, epsilon), k, *_split(p, k, b, epsilon)] if far.max() > epsilon else []


def approx_poly_dp(points: DataFrame, epsilon: float, closed: bool) -> DataFrame:
    """(set_id, place, x, y): the curve with no left-out point farther than epsilon; a closed one is split at two far points."""

    def run(p: np.ndarray) -> list[tuple]:
        if closed and len(p) > 2:
            a = int(np.hypot(*(p - p[0]).T).argmax())
            b = int(np.hypot(*(p - p[a]).T).argmax())
            a, b = sorted((a, b))
            r = np.concatenate([p[a:], p[: a + 1]])
            m = b - a
            kept = [0, *_split(r, 0, m, epsilon), m, *_split(r, m, len(p), epsilon)]
            q = r[[k for n, k in enumerate(kept) if n == 0 or k != kept[n - 1]]]
        else:
            q = p[[0, *_split(p, 0, len(p) - 1, epsilon), len(p) - 1]] if len(p) > 1 else p
        return [(n, float(x), float(y)) for n, (x, y) in enumerate(q)]

    return per_set(points, run, "place int, x double, y double")


def approx_poly_n(points: DataFrame, sides: int) -> DataFrame:
    """(set_id, place, x, y): the inner vertex of the smallest triangle with its neighbours goes until `sides` are left."""

    def run(p: np.ndarray) -> list[tuple]:
        q = p.tolist()
        while len(q) > max(2, sides):
            cost = [abs((q[k][0] - q[k - 1][0]) * (q[k + 1][1] - q[k - 1][1]) - (q[k][1] - q[k - 1][1]) * (q[k + 1][0] - q[k - 1][0])) for k in range(1, len(q) - 1)]
            del q[1 + int(np.argmin(cost))]
        return [(n, float(x), float(y)) for n, (x, y) in enumerate(q)]

    return per_set(points, run, "place int, x double, y double")


def intersect_convex(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> tuple[float, list[tuple[float, float]]]:
    """(area, corners) of the common part of two convex polygons, by clipping one at each side of the other."""
    area = lambda p: sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, [*p[1:], *p[:1]], strict=True)) / 2
    out, clip = [tuple(map(float, p)) for p in a], [tuple(map(float, p)) for p in b]
    if area(clip) < 0:
        clip.reverse()
    for (x0, y0), (x1, y1) in zip(clip, [*clip[1:], *clip[:1]], strict=True):
        side = lambda p: (x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)  # noqa: B023, E731
        kept = []
        for p, q in zip(out, [*out[1:], *out[:1]], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                kept.append(p)
            if (s > 0 and t < 0) or (s < 0 and t > 0):
                r = s / (s - t)
                kept.append((p[0] + r * (q[0] - p[0]), p[1] + r * (q[1] - p[1])))
        out = kept
        if not out:
            return 0.0, []
    return abs(area(out)), out


def rectangle_corners(x: float, y: float, width: float, height: float, angle: float) -> list[tuple[float, float]]:
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [(x + i * width / 2 * c - j * height / 2 * s, y + i * width / 2 * s + j * height / 2 * c) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def rotated_rectangle_intersection(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[int, list[tuple[float, float]]]:
    """0 and nothing, or 1 and the corners of the common part."""
    area, corners = intersect_convex(rectangle_corners(*a), rectangle_corners(*b))
    return (1, corners) if area > 0 else (0, [])


def group_rectangles(rects: Sequence[Sequence[float]], eps: float = 0.2) -> list[list[int]]:
    """Rectangles (x, y, w, h) averaged pair by pair until no two are similar."""
    out, changed = [list(map(float, r)) for r in rects], True
    while changed:
        changed = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                a, b = out[i], out[j]
                delta = eps * (min(a[2], b[2]) + min(a[3], b[3])) / 2
                if all(abs(p - q) <= delta for p, q in ((a[0], b[0]), (a[1], b[1]), (a[0] + a[2], b[0] + b[2]), (a[1] + a[3], b[1] + b[3]))):
                    out[i] = [(p + q) / 2 for p, q in zip(a, b, strict=True)]
                    del out[j]
                    changed = True
                    break
            if changed:
                break
    return [[round(v) for v in r] for r in out]
