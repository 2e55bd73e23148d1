"""Line drawing, edges, corners, Hough lines, tiles and flooding against rules spelled out pixel by pixel."""

import math

import numpy as np
import pytest

from gridloom.operators import drawing as W
from gridloom.operators import kernels as K
from gridloom.sources import images as I


def frame(spark, images):
    return spark.createDataFrame([(k, 0, *a.shape, a.astype(float).ravel().tolist()) for k, a in enumerate(images)], I.PLANE).repartition(4)


def back(df):
    return {r.img: np.array(r.data).reshape(r.rows, r.cols) for r in df.collect()}


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.img, []).append(r)
    return out


def images(seed, n=60, binary=False):
    rng = np.random.default_rng(seed)
    shapes = [(int(rng.integers(1, 12)), int(rng.integers(1, 12))) for _ in range(n // 3)] + [(8, 8)] * (n - n // 3)
    return [(rng.random(s) < 0.3) * 255 if binary else rng.integers(0, 256 if k % 2 else 4, s) * (1 if k % 2 else 60) for k, s in enumerate(shapes)]


def walked(a, b):
    """A line one pixel after another from its left end, the first error half the longer side."""
    (x, y), (u, v) = (b, a) if b[0] < a[0] else (a, b)
    dx, dy, sx, sy = abs(u - x), abs(v - y), np.sign(u - x), np.sign(v - y)
    out, error = [(x, y)], max(dx, dy) // 2
    while (x, y) != (u, v):
        if dx > dy:
            x, error = x + sx, error - dy
            if error < 0:
                y, error = y + sy, error + dx
        else:
            y, error = y + sy, error - dx
            if error < 0:
                x, error = x + sx, error + dy
        out.append((int(x), int(y)))
    return out


def test_every_line_of_a_plane():
    for a in np.ndindex(8, 8):
        for b in np.ndindex(8, 8):
            m, want = np.zeros((8, 8), bool), np.zeros((8, 8), bool)
            W._line(m, a, b)
            for x, y in walked(a, b):
                want[y, x] = True
            assert (m == want).all(), (a, b)


def test_lines_beyond_the_plane():
    rng = np.random.default_rng(1)
    for _ in range(400):
        a, b = (tuple(map(int, p)) for p in rng.integers(-20, 30, (2, 2)))
        for thickness in (1, 3):
            m, want = np.zeros((7, 9), bool), np.zeros((7, 9), bool)
            W._line(m, a, b, thickness)
            r = (thickness + 1) // 2 if thickness > 1 else 0
            for x, y in walked(a, b):
                for dy in range(-r, r + 1):
                    for dx in range(-r, r + 1):
                        if dx * dx + dy * dy <= r * r and 0 <= y + dy < 7 and 0 <= x + dx < 9:
                            want[y + dy, x + dx] = True
            assert (m == want).all(), (a, b, thickness)
    assert W.clipped((-4, 2), (4, 6), 8, 8) == ((0, 4), (4, 6)) and W.clipped((-4, 2), (-1, 6), 8, 8) is None
    assert W.clipped((3, -5), (3, 50), 8, 8) == ((3, 0), (3, 7)) and W.clipped((-5, -1), (-1, -5), 8, 8) is None
    m = np.zeros((8, 8), bool)
    W._line(m, (-(10**9), 3), (10**9, 4))
    assert m.any()


def plain_canny(a, low, high, l2):
    h, w = a.shape
    mirror = lambda p, n: 0 if n == 1 else abs((p + n - 1) % (2 * n - 2) - n + 1)
    at = lambda y, x: int(a[mirror(y, h), mirror(x, w)])
    gx, gy = np.zeros(a.shape, int), np.zeros(a.shape, int)
    for y, x in np.ndindex(h, w):
        gx[y, x] = sum(s * (at(y + d, x + 1) - at(y + d, x - 1)) for d, s in ((-1, 1), (0, 2), (1, 1)))
        gy[y, x] = sum(s * (at(y + 1, x + d) - at(y - 1, x + d)) for d, s in ((-1, 1), (0, 2), (1, 1)))
    m = np.sqrt(gx * gx + gy * gy) if l2 else np.abs(gx) + np.abs(gy)
    state = np.zeros(a.shape, int)
    for y, x in np.ndindex(h, w):
        p, q = abs(gx[y, x]), abs(gy[y, x])
        d = (0, -1) if q * 1000 <= p * 414 else (-1, 0) if p * 1000 <= q * 414 else (-1, -1) if (gx[y, x] > 0) == (gy[y, x] > 0) else (1, -1)
        near = lambda s: m[min(max(y + s * d[0], 0), h - 1), min(max(x + s * d[1], 0), w - 1)]  # noqa: B023, E731
        if m[y, x] > near(1) and m[y, x] >= near(-1):
            state[y, x] = 2 if m[y, x] > high else m[y, x] > low
    changed = True
    while changed:
        changed = False
        for y, x in zip(*np.nonzero(state == 1), strict=True):
            if (state[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] == 2).any():
                state[y, x], changed = 2, True
    return (state == 2) * 255


@pytest.mark.parametrize("l2", [False, True])
def test_canny(spark, l2):
    many = images(2)
    got = back(K.canny(frame(spark, many), 220, 90, l2))
    assert all((got[k] == plain_canny(a, 90, 220, l2)).all() for k, a in enumerate(many))
    step = np.array([[0, 0, 0, 255, 255, 255]] * 6)
    assert (back(K.canny(frame(spark, [step]), 50, 150))[0] == np.array([[0, 0, 255, 0, 0, 0]] * 6)).all()


def plain_corners(a, most, quality, distance, block):
    h, w = a.shape
    at = lambda y, x: float(a[y, x]) if 0 <= y < h and 0 <= x < w else 0.0
    scores = []
    for y, x in np.ndindex(h, w):
        p = q = r = 0.0
        for v in range(y - block // 2, y + block // 2 + 1):
            for u in range(x - block // 2, x + block // 2 + 1):
                gx = sum(s * (at(v + d, u + 1) - at(v + d, u - 1)) for d, s in ((-1, 1), (0, 2), (1, 1)))
                gy = sum(s * (at(v + 1, u + d) - at(v - 1, u + d)) for d, s in ((-1, 1), (0, 2), (1, 1)))
                p, q, r = p + gx * gx, q + gx * gy, r + gy * gy
        scores.append(((p + r - math.sqrt((p - r) ** 2 + 4 * q * q)) / 2, y, x))
    limit, edge, out = quality * max(0, *(s[0] for s in scores)), max(block - 1, 1), []
    for s, y, x in sorted((s for s in scores if s[0] > max(limit, 1e-300)), key=lambda s: -s[0]):
        if edge <= y < h - edge and edge <= x < w - edge and all((y - v) ** 2 + (x - u) ** 2 > distance**2 for u, v in out):
            out.append((x, y))
    return out[:most] if most else out


@pytest.mark.parametrize("block,distance", [(3, 2.0), (2, 0.0), (5, 1.5)])
def test_good_features(spark, block, distance):
    many = [a for a in images(3) if a.size > 1]
    got = rows_of(K.good_features(frame(spark, many), 4, 0.05, distance, block))
    for k, a in enumerate(many):
        assert [(r.x, r.y) for r in sorted(got.get(k, []), key=lambda r: r.rank)] == plain_corners(a, 4, 0.05, distance, block)


def plain_peaks(a, rho, theta, threshold):
    h, w = a.shape
    top, n = math.floor(math.sqrt(h * h + w * w)) + 1.0, math.ceil(math.pi / theta)
    votes = {}
    for y, x in zip(*np.nonzero(a), strict=True):
        for k in range(n):
            cell = (math.floor((x * math.cos(k * theta) + y * math.sin(k * theta) + top) / rho + 0.5), k)
            votes[cell] = votes.get(cell, 0) + 1
    out = []
    for (r, k), v in sorted(votes.items(), key=lambda t: (-t[1], t[0][1], t[0][0])):
        if v > threshold and len(out) < 16 and not any(abs(r - p) <= 6 and abs(k - q) <= 6 for p, q, _ in out):
            out.append((r, k, v))
    return [(r * rho - top, k * theta, v) for r, k, v in out]


@pytest.mark.parametrize("rho,theta", [(1.0, math.pi / 18), (0.7, 0.5), (2.0, 0.1)])
def test_hough(spark, rho, theta):
    many = images(4, binary=True)
    lines, segments = rows_of(K.hough_lines(frame(spark, many), rho, theta, 2)), rows_of(K.hough_segment(frame(spark, many), rho, theta, 2, 1))
    for k, a in enumerate(many):
        peaks = plain_peaks(a, rho, theta, 2)
        assert [(r.rho, r.theta, r.votes) for r in sorted(lines.get(k, []), key=lambda r: r.rank)] == [(float(np.float32(r)), float(np.float32(t)), v) for r, t, v in peaks]
        want = []
        for r, t, _ in peaks:
            on = [(-x * math.sin(t) + y * math.cos(t), i, x, y) for i, (y, x) in enumerate(zip(*np.nonzero(a), strict=True)) if abs(x * math.cos(t) + y * math.sin(t) - r) < 0.35]
            if on:
                on.sort(key=lambda p: p[0])
                runs = [[on[0]]]
                for p in on[1:]:
                    if p[0] - runs[-1][-1][0] > 3:
                        runs.append([])
                    runs[-1].append(p)
                best = max(runs, key=lambda run: run[-1][0] - run[0][0])
                p, q = sorted((best[0][1:], best[-1][1:]))
                want = [(p[1], p[2], q[1], q[2])]
                break
        assert [(s.x0, s.y0, s.x1, s.y1) for s in segments.get(k, [])] == want


def plain_flood(a, marks):
    h, w = a.shape
    m = marks.copy()
    if h < 3 or w < 3:
        return np.where(m == 0, -1, m)
    m[[0, -1]] = m[:, [0, -1]] = -1
    cross = lambda y, x: ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))
    inside = [(y, x) for y in range(1, h - 1) for x in range(1, w - 1)]
    for level in sorted({a[p] for p in inside}):
        for p in inside:
            if a[p] == level and m[p] > 0 and len({m[q] for q in cross(*p) if m[q] > 0 and a[q] < level}) > 1:
                m[p] = -1
        queue = [p for p in np.ndindex(h, w) if m[p] > 0]
        known = set(queue)
        for p in queue:
            if m[p] == 0:
                near = {m[q] for q in cross(*p) if m[q] > 0}
                m[p] = -1 if len(near) > 1 else next(iter(near), 0)
            if m[p] > 0:
                for q in cross(*p):
                    if m[q] == 0 and a[q] == level and q not in known:
                        known.add(q)
                        queue.append(q)
    return m


def test_watershed(spark):
    rng, many = np.random.default_rng(5), images(5, 90)
    marks = [np.where(rng.random(a.shape) < 0.12, rng.integers(1, 4, a.shape), 0) for a in many]
    checks, uniform, slope = (np.array([10, 200] * 8).reshape(4, 4), np.full((5, 5), 100), np.array([[0] * 4, [0, 15, 18, 0], [0, 27, 30, 0], [0] * 4]))
    pair, far = np.array([[0] * 4, [0, 1, 2, 0], [0, 1, 2, 0], [0] * 4]), np.zeros((5, 5), int)
    far[1, 1], far[3, 3] = 1, 2
    many, marks = [checks, uniform, slope, *many], [pair, far, pair, *marks]
    got = back(K.watershed(frame(spark, many), frame(spark, marks)))
    assert got[0][1:3, 1:3].tolist() == [[1, 2], [1, 2]] and got[1][1:4, 1:4].tolist() == [[1, 1, -1], [1, -1, 2], [-1, 2, 2]] and got[2][1:3, 1:3].tolist() == [[1, 2], [1, -1]]
    for k, (a, m) in enumerate(zip(many, marks, strict=True)):
        assert (got[k] == plain_flood(a, m)).all(), k


def test_clahe_of_odd_grids_and_limits(spark):
    many = images(6, 30)
    for clip, grid in ((0.5, (2, 2)), (2.0, (2, 3)), (40.0, (20, 30)), (1.0, (1, 1))):
        got = back(K.clahe(frame(spark, many), clip, grid))
        for k, a in enumerate(many):
            (h, w), f = a.shape, np.float32
            ty, tx = min(grid[0], h), min(grid[1], w)
            luts = {}
            for i, j in np.ndindex(ty, tx):
                part = a[i * h // ty : (i + 1) * h // ty, j * w // tx : (j + 1) * w // tx]
                hist = np.bincount(part.ravel(), minlength=256)
                if clip >= 1:
                    most = max(int(clip * part.size / 256), 1)
                    over = int((hist - np.minimum(hist, most)).sum())
                    hist = np.minimum(hist, most) + over // 256
                    for n in range(over % 256):
                        hist[n * (256 // (over % 256))] += 1
                luts[i, j] = np.rint(np.cumsum(hist).astype(f) * (f(255) / f(part.size)))
            for y, x in np.ndindex(h, w):
                v = min(max(f(y) * f(ty) / f(h) - f(0.5), f(0)), f(ty - 1))
                u = min(max(f(x) * f(tx) / f(w) - f(0.5), f(0)), f(tx - 1))
                i, j = int(v), int(u)
                p, q = f(v - f(i)), f(u - f(j))
                look = lambda d, e: f(luts[min(i + d, ty - 1), min(j + e, tx - 1)][a[y, x]])  # noqa: B023, E731
                mixed = (look(0, 0) * (f(1) - q) + look(0, 1) * q) * (f(1) - p) + (look(1, 0) * (f(1) - q) + look(1, 1) * q) * p
                assert got[k][y, x] == min(max(np.rint(mixed), 0), 255), (clip, grid, k, y, x)
