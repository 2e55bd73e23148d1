"""Operators whose steps depend on each other inside one image: numpy per plane, one Arrow batch of planes at a time."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions import numeric as N
from gridloom.functions.planes import REFLECT_101
from gridloom.sources.images import PLANE


def _planes_of(b: pa.RecordBatch) -> Iterator[tuple]:
    """(img, c, values as (rows, cols), further columns ...) of each row; the values are views of the batch."""
    data = b.column(4)
    values, ends = data.values.to_numpy(zero_copy_only=False), data.offsets.to_numpy()
    for k, (img, c, rows, cols, *more) in enumerate(zip(*(b.column(n).to_pylist() for n in range(b.num_columns) if n != 4), strict=True)):
        yield img, c, values[ends[k] : ends[k + 1]].reshape(rows, cols), *more


def per_plane(planes: DataFrame, kernel: Callable[[np.ndarray], Iterable[tuple]], schema: str, extra: Sequence[str] = ()) -> DataFrame:
    """Rows (img, c, ...) that kernel(values) gives for each plane; values is (rows, cols). `extra` names columns whose
    values follow as further arguments. schema lists what comes after img and c."""
    full = f"img long, c int, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(full))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(img, c, *r) for img, c, a, *more in _planes_of(b) for r in kernel(a, *more)]
            columns = list(zip(*out, strict=True)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return planes.select("img", "c", "rows", "cols", "data", *extra).mapInArrow(scan, full)


def per_image(planes: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], extra: Sequence[str] = ()) -> DataFrame:
    """Planes that kernel makes of planes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.asarray(kernel(a, *more), np.float64) for _, _, a, *more in _planes_of(b)]
            flat = pa.array(np.concatenate([m.ravel() for m in made]) if made else np.zeros(0))
            ends = np.concatenate(([0], np.cumsum([m.size for m in made]))).astype(np.int32)
            sides = [pa.array([m.shape[k] for m in made], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *sides, pa.ListArray.from_arrays(pa.array(ends), flat)], ["img", "c", "rows", "cols", "data"])

    return planes.select("img", "c", "rows", "cols", "data", *extra).mapInArrow(scan, PLANE)


def _neighbours(connectivity: int) -> list[tuple[int, int]]:
    four = [(-1, 0), (0, -1), (0, 1), (1, 0)]
    return four if connectivity == 4 else [*four, (-1, -1), (-1, 1), (1, -1), (1, 1)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n-1 and links a-b the smallest node that each reaches: minimum labels and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for ends in (a, b):
            np.minimum.at(root, root[ends], low)
        while not np.array_equal(root, further := root[root]):
            root = further
        if np.array_equal(root, before):
            return root


def label(a: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Labels of the non-zero regions, from 1 in the order in which a scan meets them: runs of pixels, joined where they
    touch a run of the row above."""
    wide, reach = a.shape[1] + 2, 1 if connectivity == 8 else 0
    edges = np.diff(np.pad((a != 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, start), end = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    above = (y - 1) * wide
    first = np.searchsorted(y * wide + end, above + start - reach, "right")
    stop = np.maximum(first, np.searchsorted(y * wide + start, above + end + reach, "left"))
    count = stop - first
    below = np.repeat(np.arange(len(y)), count)
    touched = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(below))
    number = np.unique(_roots(len(y), below, touched), return_inverse=True)[1] + 1
    out = np.zeros(a.shape, int)
    out[a != 0] = np.repeat(number, end - start)
    return out


def connected_components(planes: DataFrame, connectivity: int = 8) -> DataFrame:
    return per_image(planes, lambda a: label(a, connectivity))


def component_stats(planes: DataFrame, connectivity: int = 8) -> DataFrame:
    """(img, c, label, left, top, width, height, area, center_x, center_y), the background as label 0."""

    def stats(a: np.ndarray) -> Iterator[tuple]:
        labels = label(a, connectivity)
        y, x = (v.ravel() for v in np.indices(a.shape))
        k = labels.ravel()
        n = labels.max(initial=0) + 1
        area = np.bincount(k, minlength=n)
        low, high = np.full((2, n), max(a.shape)), np.full((2, n), -1)
        for side, v in enumerate((x, y)):
            np.minimum.at(low[side], k, v)
            np.maximum.at(high[side], k, v)
        cx, cy = (np.bincount(k, v, n) / np.maximum(area, 1) for v in (x, y))
        for j in range(n):
            if area[j]:
                yield j, int(low[0, j]), int(low[1, j]), int(high[0, j] - low[0, j]) + 1, int(high[1, j] - low[1, j]) + 1, int(area[j]), float(cx[j]), float(cy[j])
            elif j == 0:
                yield 0, 0, 0, 0, 0, 0, 0.0, 0.0

    return per_plane(planes, stats, "label int, left int, top int, width int, height int, area int, center_x double, center_y double")


#: Step lengths (straight, diagonal, knight's move) of the chamfer distances.
_CHAMFER = {("l1", 3): (1.0, 2.0, None), ("c", 3): (1.0, 1.0, None), ("l2", 3): (0.955, 1.3693, None), ("l2", 5): (1.0, 1.4, 2.0)}


def chamfer(a: np.ndarray, kind: str = "l2", mask: int = 3) -> np.ndarray:
    """Distance of every pixel to the nearest zero, in two passes of whole rows; 1e30 if there is none."""
    straight, diagonal, knight = _CHAMFER[kind, mask if kind == "l2" else 3]
    steps = [(1, 0, straight), (1, 1, diagonal), (1, -1, diagonal)]
    if knight:
        steps += [(2, 1, knight), (2, -1, knight), (1, 2, knight), (1, -2, knight)]
    h, w = a.shape
    d = np.full((h + 2, w + 4), 1e30)
    d[2:, 2:-2] = np.where(a == 0, 0.0, 1e30)
    run = straight * np.arange(w)
    for _ in range(2):  # downwards, then turned by half a circle
        for y in range(2, h + 2):
            row = np.minimum.reduce([d[y, 2:-2], *(d[y - dy, 2 - dx : 2 - dx + w] + s for dy, dx, s in steps)])
            row = np.minimum(row, np.minimum.accumulate(row - run) + run)
            d[y, 2:-2] = np.where(row < 1e29, row, 1e30)
        d[2:] = d[:1:-1, ::-1].copy()
    return d[2:, 2:-2]


def distance_transform(planes: DataFrame, kind: str = "l2", mask: int = 3) -> DataFrame:
    return per_image(planes, lambda a: chamfer(a, kind, mask))


def distance_transform_with_labels(planes: DataFrame, kind: str = "l2") -> DataFrame:
    """(img, c, rows, cols, data, labels): exact distances, and the 8-connected region of zeros that is nearest."""

    def run(a: np.ndarray) -> list[tuple]:
        if not (a == 0).any():
            return [(*a.shape, [1e30] * a.size, [0] * a.size)]
        h, w = a.shape
        y, far = np.arange(h)[:, None], h + w
        up = np.maximum.accumulate(np.where(a == 0, y, -far), axis=0)  # the nearest zero of the column above and below
        down = np.minimum.accumulate(np.where(a == 0, y, 2 * far)[::-1], axis=0)[::-1]
        near = np.where(y - up <= down - y, up, down)
        gap = np.abs(y - near).astype(float)
        join = {"l1": np.add, "c": np.maximum}.get(kind, np.hypot)
        best, by = np.where(gap < far, gap, np.inf), np.broadcast_to(np.arange(w), a.shape).copy()
        for dx in range(1, w):  # columns further and further away, while any can still be nearer
            if dx > best.max():
                break
            for x, z in ((slice(dx, w), slice(0, w - dx)), (slice(0, w - dx), slice(dx, w))):
                d = np.where(gap[:, z] < far, join(gap[:, z], dx), np.inf)
                nearer = d < best[:, x]
                best[:, x][nearer], by[:, x][nearer] = d[nearer], np.broadcast_to(np.arange(w)[z], d.shape)[nearer]
        marks = label((a == 0).astype(int))[near[y, by], by]
        return [(h, w, best.ravel().tolist(), marks.ravel().tolist())]

    return per_plane(planes, run, "rows int, cols int, data array<double>, labels array<int>")


def flooded(a: np.ndarray, seed: tuple[int, int], low: float, high: float, connectivity: int = 4) -> np.ndarray:
    """Pixels connected to the seed (y, x) whose values lie within low below and high above the seed's."""
    regions = label((a >= a[seed] - low) & (a <= a[seed] + high), connectivity)
    return regions == regions[seed]


def flood_fill(planes: DataFrame, seed: tuple[int, int], value: float, low: float = 0.0, high: float = 0.0, connectivity: int = 4) -> DataFrame:
    return per_image(planes, lambda a: np.where(flooded(a, seed, low, high, connectivity), value, a))


def watershed(planes: DataFrame, markers: DataFrame) -> DataFrame:
    """Marked regions flooded level by level; -1 on the frame, where regions meet, and at marks between older regions.

    At each gray level, marks of that level beside two or more regions of lower levels give way; then the unmarked pixels
    of the level take the region beside them, first those beside what is marked, in the order of the scan, then those
    beside these. Images of fewer than three rows or columns are all frame; their marks stay.
    """

    def run(a: np.ndarray, marks: list) -> np.ndarray:
        m = np.array(marks, int).reshape(a.shape)
        if min(a.shape) < 3:
            return np.where(m == 0, -1, m)
        m[[0, -1], :] = m[:, [0, -1]] = -1
        w, v = a.shape[1], a.ravel()
        m = m.ravel()
        inner = np.flatnonzero(np.pad(np.ones((a.shape[0] - 2, w - 2), bool), 1).ravel())
        inner = inner[np.argsort(v[inner], kind="stable")]
        sides = (-w, w, -1, 1)  # in the order in which a pixel reaches them
        for level in np.split(inner, np.flatnonzero(np.diff(v[inner])) + 1):
            seeds = level[m[level] > 0]
            beside = np.stack([np.where((m[seeds + d] > 0) & (v[seeds + d] < v[level[0]]), m[seeds + d], 0) for d in sides])
            high = beside.max(axis=0, initial=0)
            m[seeds[(high > 0) & ((beside > 0) & (beside != high)).any(axis=0)]] = -1
            bare = level[m[level] == 0]
            met = np.stack([m[bare + d] > 0 for d in (-w, -1, 1, w)])
            first = met.argmax(axis=0)  # the marked neighbour that the scan comes to first, and its turn to reach this pixel
            key = (bare + np.array([-w, -1, 1, w])[first]) * 4 + np.array([1, 3, 2, 0])[first]
            reached = bare[met.any(axis=0)]
            queue = deque(reached[np.argsort(key[met.any(axis=0)], kind="stable")].tolist())
            waiting, open_pixels = set(queue), set(bare.tolist())
            while queue:
                p = queue.popleft()
                around = {int(m[p + d]) for d in sides if m[p + d] > 0}
                if len(around) > 1:
                    m[p] = -1
                elif around:
                    m[p] = around.pop()
                    for d in sides:
                        if p + d in open_pixels and p + d not in waiting:
                            waiting.add(p + d)
                            queue.append(p + d)
        return m.reshape(a.shape)

    both = planes.where("c = 0").join(markers.selectExpr("img", "data AS _marks"), "img")
    return per_image(both, run, ["_marks"])


#: The eight directions (dy, dx), clockwise from the right.
_TURNS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def borders(a: np.ndarray) -> list[tuple[list[tuple[int, int]], bool, int]]:
    """Outer borders and hole borders of the non-zero regions by border following: (points (x, y), is a hole, number of
    the border that encloses it, -1 for none), in the order of the scan."""
    f = np.zeros((a.shape[0] + 2, a.shape[1] + 2), int)
    f[1:-1, 1:-1] = a != 0
    found: list[tuple[list[tuple[int, int]], bool, int]] = []
    for y in range(1, f.shape[0] - 1):
        last = 1
        for x in range(1, f.shape[1] - 1):
            if f[y, x] == 0:
                continue
            outer, hole = f[y, x] == 1 and f[y, x - 1] == 0, f[y, x] >= 1 and f[y, x + 1] == 0
            if outer or hole:
                if not outer and f[y, x] > 1:
                    last = f[y, x]
                parent = -1
                if last != 1:
                    before = abs(last) - 2
                    parent = before if found[before][1] != (not outer) else found[before][2]
                points = _follow(f, y, x, 4 if outer else 0, len(found) + 2)
                found.append((points, not outer, parent))
            if f[y, x] not in (0, 1):
                last = f[y, x]
    return found


def _follow(f: np.ndarray, y: int, x: int, back: int, number: int) -> list[tuple[int, int]]:
    """One border from (y, x), whose neighbour in direction `back` is outside; marks it in f."""
    start = next((k % 8 for k in range(back + 1, back + 9) if f[y + _TURNS[k % 8][0], x + _TURNS[k % 8][1]] != 0), None)
    if start is None:
        f[y, x] = -number
        return [(x - 1, y - 1)]
    first = (y + _TURNS[start][0], x + _TURNS[start][1])
    at, came, points = (y, x), start, []
    while True:
        crossed_right = False
        for k in range(came - 1, came - 9, -1):  # anticlockwise from where it came
            dy, dx = _TURNS[k % 8]
            if f[at[0] + dy, at[1] + dx] != 0:
                break
            crossed_right |= k % 8 == 0
        if crossed_right:
            f[at] = -number
        elif f[at] == 1:
            f[at] = number
        points.append((at[1] - 1, at[0] - 1))
        following = (at[0] + dy, at[1] + dx)
        if following == (y, x) and at == first:
            return points
        came = _TURNS.index((at[0] - following[0], at[1] - following[1]))
        at = following


def simplified(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without the points inside of straight runs of a closed chain."""
    n = len(points)
    if n < 3:
        return points
    step = lambda a, b: (b[0] - a[0], b[1] - a[1])
    return [points[k] for k in range(n) if step(points[k - 1], points[k]) != step(points[k], points[(k + 1) % n])]


EXTERNAL, LIST, CCOMP, TREE = range(4)


def find_contours(planes: DataFrame, mode: int = TREE, simple: bool = True, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """(img, c, contour, next, previous, child, parent, points array<struct<x, y>>): contours with their places in the hierarchy."""

    def run(a: np.ndarray) -> Iterator[tuple]:
        found = borders(a)
        keep = [k for k, (_, hole, parent) in enumerate(found) if mode != EXTERNAL or (not hole and parent < 0)]
        number = {k: n for n, k in enumerate(keep)}
        parents = []
        for k in keep:
            _, hole, parent = found[k]
            if mode in (EXTERNAL, LIST) or (mode == CCOMP and not hole):
                parent = -1
            parents.append(number.get(parent, -1))
        family: dict[int, list[int]] = {}
        for n, parent in enumerate(parents):
            family.setdefault(parent, []).append(n)
        place = {n: i for same in family.values() for i, n in enumerate(same)}
        for n, k in enumerate(keep):
            same, at = family[parents[n]], place[n]
            child = family[n][0] if n in family else -1
            points = simplified(found[k][0]) if simple else found[k][0]
            yield n, same[at + 1] if at + 1 < len(same) else -1, same[at - 1] if at else -1, child, parents[n], [{"x": x + offset[0], "y": y + offset[1]} for x, y in points]

    return per_plane(planes, run, "contour int, next int, previous int, child int, parent int, points array<struct<x:int,y:int>>")


def find_contours_link_runs(planes: DataFrame) -> DataFrame:
    """find_contours() in two levels, with every pixel of a contour."""
    return find_contours(planes, CCOMP, simple=False)


def otsu_level(a: np.ndarray) -> int:
    """The 8-bit level that maximises the variance between the classes at or below it and above it; the first of equals."""
    share = np.bincount(a.astype(int).ravel(), minlength=256) / a.size
    q, m = share.cumsum(), (share * np.arange(256)).cumsum()
    sound = np.minimum(q, 1 - q) >= 1.1920929e-07
    low, high = m / np.where(sound, q, 1), (m[-1] - m) / np.where(sound, 1 - q, 1)
    return int(np.round(np.where(sound, q * (1 - q) * (low - high) ** 2, 0), 9).argmax())


def otsu_threshold(planes: DataFrame, maximum: float, kind: int) -> DataFrame:
    return _by_level(planes, otsu_level, maximum, kind)


def equalized(planes: DataFrame) -> DataFrame:
    """8-bit planes with an even histogram: the table of the counts, from the least value that occurs, in one pass."""

    def run(a: np.ndarray) -> np.ndarray:
        counts = np.bincount(a.astype(int).ravel(), minlength=256)
        first = counts[np.flatnonzero(counts)[0]] if a.size else 0
        if first == a.size:
            return a
        return np.clip(np.rint((counts.cumsum() - first) * 255.0 / (a.size - first)), 0, 255)[a.astype(int)]

    return per_image(planes, run)


def triangle_level(a: np.ndarray) -> int:
    """The 8-bit level farthest from the line between the histogram's peak and its longer tail."""
    h = np.bincount(a.astype(int).ravel(), minlength=256).astype(float)
    used = np.flatnonzero(h)
    left, right, peak = max(0, used[0] - 1), min(255, used[-1] + 1), int(h.argmax())
    turned = peak - left < right - peak
    if turned:
        h, left, peak = h[::-1], 255 - right, 255 - peak
    k = np.arange(left + 1, peak + 1)
    level = left if not len(k) else int(k[(h[peak] * k + (left - peak) * h[k]).argmax()]) - 1
    return 255 - level if turned else level


def triangle_threshold(planes: DataFrame, maximum: float, kind: int) -> DataFrame:
    return _by_level(planes, triangle_level, maximum, kind)


def _by_level(planes: DataFrame, level: Callable[[np.ndarray], int], maximum: float, kind: int) -> DataFrame:
    def run(a: np.ndarray) -> np.ndarray:
        above = a > (t := level(a))
        return [np.where(above, maximum, 0), np.where(above, 0, maximum), np.minimum(a, t), np.where(above, a, 0), np.where(above, 0, a)][kind]

    return per_image(planes, run)


def clahe(planes: DataFrame, clip: float = 40.0, tiles: tuple[int, int] = (8, 8), levels: int = 256) -> DataFrame:
    """Equalised by tiles with histograms clipped from a limit of 1 on, the tiles' tables mixed bilinearly.

    A grid has no more tiles than the image has rows or columns. Scales and mixtures are 32-bit floats.
    """
    grid, f = tiles, np.float32

    def run(a: np.ndarray) -> np.ndarray:
        h, w = a.shape
        tiles = min(max(grid[0], 1), h), min(max(grid[1], 1), w)
        tables = np.zeros((*tiles, levels), f)
        for i in range(tiles[0]):
            for j in range(tiles[1]):
                part = a[i * h // tiles[0] : max(i * h // tiles[0] + 1, (i + 1) * h // tiles[0]), j * w // tiles[1] : max(j * w // tiles[1] + 1, (j + 1) * w // tiles[1])]
                hist = np.bincount(part.astype(int).ravel(), minlength=levels)
                if clip >= 1:
                    most = max(1, int(clip * part.size / levels))
                    over = int(np.maximum(hist - most, 0).sum())
                    hist = np.minimum(hist, most) + over // levels
                    rest = over % levels
                    if rest:
                        hist[np.arange(0, levels, max(1, levels // rest))[:rest]] += 1
                tables[i, j] = np.rint(np.cumsum(hist).astype(f) * (f(levels - 1) / f(part.size)))
        y, x = (np.clip(np.arange(n, dtype=f) * f(t) / f(n) - f(0.5), f(0), f(t - 1)) for n, t in ((h, tiles[0]), (w, tiles[1])))
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        fy, fx = (y - y0.astype(f))[:, None], (x - x0.astype(f))[None, :]
        rows = [np.clip(v, 0, tiles[0] - 1)[:, None] for v in (y0, y0 + 1)]
        cols = [np.clip(v, 0, tiles[1] - 1)[None, :] for v in (x0, x0 + 1)]
        v = a.astype(int)
        mixed = (tables[rows[0], cols[0], v] * (1 - fx) + tables[rows[0], cols[1], v] * fx) * (1 - fy) + (tables[rows[1], cols[0], v] * (1 - fx) + tables[rows[1], cols[1], v] * fx) * fy
        return np.clip(np.rint(mixed), 0, levels - 1)

    return per_image(planes, run)


def canny(planes: DataFrame, low: float, high: float, l2: bool = False) -> DataFrame:
    """Edges of 3 x 3 gradients: maxima across the edge, kept if strong or connected to strong ones."""
    low, high = sorted((low, high))

    def run(a: np.ndarray) -> np.ndarray:
        p = padded(a, (1, 1, 1, 1), REFLECT_101)
        h, w = a.shape
        at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
        gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
        m = np.hypot(gx, gy) if l2 else np.abs(gx) + np.abs(gy)
        q = np.pad(m, 1, mode="edge")
        near = lambda dy, dx: q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        # fixed value: a gradient lies along an axis if its other part is at most 0.414 of this one
        flat, steep = np.abs(gy) * 1000 <= np.abs(gx) * 414, np.abs(gx) * 1000 <= np.abs(gy) * 414
        over = lambda dy, dx: (m > near(dy, dx)) & (m >= near(-dy, -dx))
        top = np.where(flat, over(0, -1), np.where(steep, over(-1, 0), np.where((gx < 0) == (gy < 0), over(-1, -1), over(1, -1))))
        weak = top & (m > low)
        regions = label(weak.astype(int))
        strong = np.unique(regions[weak & (m > high)])
        return np.where(weak & np.isin(regions, strong), 255, 0)

    return per_image(planes, run)


def good_features(planes: DataFrame, most: int, quality: float, distance: float, block: int = 3) -> DataFrame:
    """(img, c, rank, x, y, response): the pixels of largest smaller eigenvalue, no two within `distance`.

    Gradients count what is outside of the image as 0 and are summed over the block, outside as inside. Pixels over
    `quality` of the largest value are taken in falling order, equal ones in that of the scan, at least block - 1 from the
    edge; each bars the disc around it. most limits their number, 0 doesn't.
    """

    def run(a: np.ndarray) -> Iterator[tuple]:
        h, w = a.shape
        r, margin = max(block, 1) // 2, max(block - 1, 1)
        p = np.pad(a, r + 1)
        gx, gy = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2], p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:])
        xx, xy, yy = (sum(t[i : i + h, j : j + w] for i in range(2 * r + 1) for j in range(2 * r + 1)) for t in (gx * gx, gx * gy, gy * gy))
        s = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2
        free = s > max(quality * max(0.0, s.max(initial=0)), np.finfo(float).tiny)
        free[:margin], free[:, :margin], free[max(0, h - margin) :], free[:, max(0, w - margin) :] = False, False, False, False
        y, x = np.nonzero(free)
        reach, rank = math.floor(distance), 0
        dy, dx = np.mgrid[-reach : reach + 1, -reach : reach + 1]
        disc = dy * dy + dx * dx <= distance * distance
        for k in np.argsort(-s[y, x], kind="stable").tolist():
            v, u = int(y[k]), int(x[k])
            if free[v, u]:
                yield rank, u, v, float(s[v, u])
                rank += 1
                if most and rank == most:
                    return
                top, left = max(0, v - reach), max(0, u - reach)
                part = free[top : v + reach + 1, left : u + reach + 1]
                part &= ~disc[top - v + reach :, left - u + reach :][: part.shape[0], : part.shape[1]]

    return per_plane(planes, run, "rank int, x int, y int, response double")


def _peaks(x: np.ndarray, y: np.ndarray, shape: tuple[int, int], rho: float, theta: float, threshold: int) -> Iterator[tuple[float, float, int]]:
    """(distance, angle, votes) of at most 16 lines over the threshold, most votes first, then the least angle and distance;
    each has six cells of both around it to itself. Cells go from minus the diagonal on; one angle is counted at a time."""
    top = math.floor(math.hypot(*shape)) + 1.0
    n, cells = math.ceil(math.pi / theta), math.ceil(2 * top / rho) + 2
    votes = np.stack([np.bincount(np.floor((x * math.cos(k * theta) + y * math.sin(k * theta) + top) / rho + 0.5).astype(int), minlength=cells)[:cells] for k in range(n)])
    for _ in range(16):
        k, r = np.unravel_index(votes.argmax(), votes.shape)
        if votes[k, r] <= max(threshold, 0):
            return
        yield r * rho - top, k * theta, int(votes[k, r])
        votes[max(0, k - 6) : k + 7, max(0, r - 6) : r + 7] = 0


def hough_lines(planes: DataFrame, rho: float, theta: float, threshold: int) -> DataFrame:
    """(img, c, rank, rho, theta, votes): at most 16 peaks, each with a window of 13 x 13 to itself."""

    def run(a: np.ndarray) -> Iterator[tuple]:
        y, x = np.nonzero(a)
        for k, (r, t, votes) in enumerate(_peaks(x, y, a.shape, rho, theta, threshold)):
            yield k, float(np.float32(r)), float(np.float32(t)), votes

    return per_plane(planes, run, "rank int, rho double, theta double, votes int")


# linear algebra: a plane is a matrix
def determinant(planes: DataFrame) -> DataFrame:
    """(img, c, determinant), 0 where the elimination meets a pivot of no size."""

    def run(a: np.ndarray) -> list[tuple]:
        a, out = a.copy(), 1.0
        for k in range(len(a)):
            p = k + int(np.abs(a[k:, k]).argmax())
            if abs(a[p, k]) < 100 * np.finfo(float).eps:
                return [(0.0,)]
            if p != k:
                a[[k, p]] = a[[p, k]]
                out = -out
            out *= a[k, k]
            a[k + 1 :] -= np.outer(a[k + 1 :, k] / a[k, k], a[k])
        return [(float(out),)]

    return per_plane(planes, run, "determinant double")


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix from the largest, and the eigenvectors as rows, by cyclic rotations."""
    a, v = (a + a.T) / 2, np.eye(len(a))
    for _ in range(60):
        if np.abs(np.triu(a, 1)).max(initial=0) < 1e-14 * max(1.0, np.abs(np.diag(a)).max(initial=0)):
            break
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if a[p, q] == 0:
                    continue
                t = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if t >= 0 else -1) / (abs(t) + math.hypot(t, 1))
                c = 1 / math.hypot(t, 1)
                turn = np.eye(len(a))
                turn[p, p] = turn[q, q] = c
                turn[p, q], turn[q, p] = t * c, -t * c
                a, v = turn.T @ a @ turn, v @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order].T


def eigen(planes: DataFrame) -> DataFrame:
    """(img, c, values, vectors): eigenvalues from the largest, eigenvectors as rows."""

    def run(a: np.ndarray) -> list[tuple]:
        values, vectors = jacobi(a)
        return [(values.tolist(), vectors.ravel().tolist())]

    return per_plane(planes, run, "values array<double>, vectors array<double>")


def solve_poly(coefficients: Sequence[float]) -> list[complex]:
    """Roots of a polynomial with ascending coefficients."""
    return [complex(r) for r in np.roots(list(coefficients)[::-1])]


def dft(planes: DataFrame, scale: bool = False) -> DataFrame:
    """The forward transform of real planes: (img, c, rows, cols, data, imaginary)."""

    def run(a: np.ndarray) -> list[tuple]:
        f = np.fft.fft2(a) / (a.size if scale else 1)
        return [(*a.shape, f.real.ravel().tolist(), f.imag.ravel().tolist())]

    return per_plane(planes, run, "rows int, cols int, data array<double>, imaginary array<double>")


def optimal_dft_size(n: int) -> int:
    """The least number of at least n without prime factors over 5; -1 for negative or too large numbers."""
    if n < 0 or n >= 2_125_764_000:
        return -1
    best = None
    for a in range(32):
        for b in range(21):
            left = 2**a * 3**b
            if best is not None and left >= best:
                break
            while left < n:
                left *= 5
            best = left if best is None else min(best, left)
    return best


def hanning_window(rows: int, cols: int) -> np.ndarray:
    if rows < 2 or cols < 2:
        raise ValueError("sides of 2 or more")
    w = lambda n: 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return np.sqrt(np.outer(w(rows), w(cols)))


def structuring_element(kind: str, rows: int, cols: int, anchor: tuple[int, int] = (-1, -1)) -> np.ndarray:
    """'rect', 'cross', 'ellipse' or 'diamond' of ones; the anchor (x, y) moves the cross."""
    out = np.zeros((rows, cols), int)
    ry, rx = rows // 2, cols // 2
    if kind == "rect":
        out[:] = 1
    elif kind == "cross":
        out[anchor[1] if anchor[1] >= 0 else ry, :] = 1
        out[:, anchor[0] if anchor[0] >= 0 else rx] = 1
    else:
        for y in range(rows):
            dy = y - ry
            if kind == "diamond":
                half = rx - abs(dy)
            else:
                half = -1 if abs(dy) > ry else round(rx * math.sqrt(max(0.0, 1 - (dy / ry) ** 2))) if ry else rx
            if half >= 0:
                out[y, max(0, rx - half) : rx + half + 1] = 1
    return out


def kmeans(points: np.ndarray, k: int, iterations: int = 10, epsilon: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(compactness, labels, centers): seeded with the point farthest from the origin, then the farthest from all seeds."""
    centers = [points[(points**2).sum(1).argmax()]]
    while len(centers) < k:
        centers.append(points[np.min([((points - c) ** 2).sum(1) for c in centers], axis=0).argmax()])
    centers = np.array(centers, float)
    for _ in range(iterations):
        labels = ((points[:, None] - centers) ** 2).sum(2).argmin(1)
        moved = np.array([points[labels == j].mean(0) if (labels == j).any() else centers[j] for j in range(k)])
        shift, centers = np.abs(moved - centers).max(), moved
        if shift <= epsilon:
            break
    d = ((points[:, None] - centers) ** 2).sum(2)
    return float(d.min(1).sum()), d.argmin(1), centers


def hough_segment(planes: DataFrame, rho: float, theta: float, threshold: int, gap: int) -> DataFrame:
    """(img, c, x0, y0, x1, y1): the longest run of edge pixels on the first peak that has any within 0.35 of its line.

    Gaps up to gap + 2 along the line are bridged, and of equally long runs the first stays. The end that the scan comes
    to first is given first.
    """

    def run(a: np.ndarray) -> list[tuple]:
        y, x = np.nonzero(a)
        for r, t, _ in _peaks(x, y, a.shape, rho, theta, threshold):
            on = np.flatnonzero(np.abs(x * math.cos(t) + y * math.sin(t) - r) < 0.35)
            if len(on):
                along = y[on] * math.cos(t) - x[on] * math.sin(t)
                order = np.argsort(along, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(along[order]) > max(gap, 0) + 2.0) + 1)
                longest = max(parts, key=lambda part: along[part[-1]] - along[part[0]])
                p, q = sorted((on[longest[0]], on[longest[-1]]))
                return [(int(x[p]), int(y[p]), int(x[q]), int(y[q]))]
        return []

    return per_plane(planes, run, "x0 int, y0 int, x1 int, y1 int")


def padded(a: np.ndarray, reach: tuple[int, int, int, int], border: int, outside: float = 0.0) -> np.ndarray:
    """a with (top, bottom, left, right) more rows and columns, filled as the border says."""
    from gridloom.functions.planes import border_place

    top, bottom, left, right = reach
    y = [border_place(p, a.shape[0], border) for p in range(-top, a.shape[0] + bottom)]
    x = [border_place(p, a.shape[1], border) for p in range(-left, a.shape[1] + right)]
    out = a[np.ix_([0 if p is None else p for p in y], [0 if p is None else p for p in x])]
    out[[k for k, p in enumerate(y) if p is None]] = outside
    out[:, [k for k, p in enumerate(x) if p is None]] = outside
    return out


def around(a: np.ndarray, offsets: Sequence[tuple[int, int]], border: int, outside: float = 0.0) -> Iterator[np.ndarray]:
    """For each offset (dy, dx) the values that lie so far from every pixel."""
    dy, dx = zip(*offsets, strict=True)
    top, bottom, left, right = max(0, -min(dy)), max(0, max(dy)), max(0, -min(dx)), max(0, max(dx))
    p = padded(a, (top, bottom, left, right), border, outside)
    for u, v in offsets:
        yield p[top + u : top + u + a.shape[0], left + v : left + v + a.shape[1]]


def weighted(planes: DataFrame, weights: Sequence[tuple[int, int, float]], border: int) -> DataFrame:
    """At every pixel the sum of weight * value at (y + dy, x + dx); a constant border counts as 0."""
    used = [t for t in weights if t[2] != 0]

    def run(a: np.ndarray) -> np.ndarray:
        out = np.zeros(a.shape)
        if used:
            for part, (_, _, w) in zip(around(a, [t[:2] for t in used], border), used, strict=True):
                out += w * part
        return out

    return per_image(planes, run)


def ordered(planes: DataFrame, offsets: Sequence[tuple[int, int]], border: int, outside: float, rank: int) -> DataFrame:
    """At every pixel the value of that rank among those at the offsets; -1 is the greatest."""

    def run(a: np.ndarray) -> np.ndarray:
        parts = np.stack(list(around(a, offsets, border, outside)))
        return parts.min(axis=0) if rank == 0 else parts.max(axis=0) if rank == -1 else np.partition(parts, rank, axis=0)[rank]

    return per_image(planes, run)


def correlated(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The sums of kernel * a at every place where the kernel lies inside a: 64 rows of a against all rows of the kernel in
    one product, then summed down."""
    h, w = kernel.shape
    rows, cols = a.shape[0] - h + 1, a.shape[1] - w + 1
    out = np.zeros((rows, cols))
    for top in range(0, rows, 64):
        own = min(64, rows - top)
        lines = np.lib.stride_tricks.sliding_window_view(a[top : top + own + h - 1], w, axis=1)
        parts = (kernel @ lines.reshape(-1, w).T).reshape(h, own + h - 1, cols)
        for i in range(h):
            out[top : top + own] += parts[i, i : i + own]
    return out


def _masked_template(planes: DataFrame, t: np.ndarray, w: np.ndarray, method: int) -> DataFrame:
    """With weights w: differences from the weighted means, where a method centres, times w, in place of the values."""
    if t.shape != w.shape:
        raise ValueError("a mask has its template's size")
    centres = method in (4, 5)
    with np.errstate(invalid="ignore", divide="ignore"):
        values = (t - ((t * w).sum() / w.sum() if centres else 0.0)) * w
    energy, weight = float((values * values).sum()), w.sum()

    def run(a: np.ndarray) -> np.ndarray:
        rows, cols = a.shape[0] - t.shape[0] + 1, a.shape[1] - t.shape[1] + 1
        if rows < 1 or cols < 1:
            return np.zeros((max(rows, 0), max(cols, 0)))
        crossed, squares = correlated(a, w * values), correlated(a * a, w * w) if method != 2 else 0.0
        with np.errstate(invalid="ignore", divide="ignore"):
            if centres:
                mean = correlated(a, w) / weight
                crossed = crossed - mean * float((w * values).sum())
                whole, squares = squares, squares - 2 * mean * correlated(a, w * w) + mean * mean * float((w * w).sum())
                level = squares < 1e-12 * whole  # a window of one value: what is left is rounding
                squares, crossed = np.where(level, 0.0, squares), np.where(level, 0.0, crossed)
            top = crossed if method > 1 else np.maximum(0, squares - 2 * crossed + energy)
            return top / np.sqrt(squares * energy) if method % 2 else top

    return per_image(planes, run)


def match_template(planes: DataFrame, template: Sequence[Sequence[float]], method: int, mask: Sequence[Sequence[float]] | None = None, mask_depth: int = N.U8) -> DataFrame:
    """Maps of how well a one-channel template fits at each place: 0 SQDIFF, 2 CCORR, 4 CCOEFF, and 1, 3, 5 normalised.

    A norm of 0 gives 1 for method 1 and 0 for the others; a constant template gives 1 throughout method 5. An 8-bit mask
    takes the places where it isn't 0, a float one weighs them; with a mask, a norm of 0 gives what the quotient gives.
    An empty mask is none.
    """
    t = np.array(template, float)
    if mask is not None and np.size(mask):
        m = np.array(mask, float)
        return _masked_template(planes, t, (m != 0).astype(float) if mask_depth == N.U8 else m, method)
    h, w = t.shape
    centred, square = t - t.mean(), float((t * t).sum())
    spread = float((centred * centred).sum())

    def box(a: np.ndarray) -> np.ndarray:
        s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
        s[1:, 1:] = a.cumsum(axis=0).cumsum(axis=1)
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    def run(a: np.ndarray) -> np.ndarray:
        rows, cols = a.shape[0] - h + 1, a.shape[1] - w + 1
        if rows < 1 or cols < 1:
            return np.zeros((max(rows, 0), max(cols, 0)))
        crossed = correlated(a, centred if method in (4, 5) else t)
        if method in (2, 4):
            return crossed
        if method == 5 and spread == 0:
            return np.ones((rows, cols))
        squares = box(a * a)
        if method == 5:
            plain = box(a)
            squares = squares - plain * plain / (h * w)
            squares[squares < 1e-9 * np.maximum(1.0, plain * plain)] = 0
        top = np.maximum(0, squares - 2 * crossed + square) if method in (0, 1) else crossed
        if method == 0:
            return top
        norm = np.sqrt(np.maximum(0, squares) * (spread if method == 5 else square))
        flat = norm == 0
        return np.where(flat, 1.0 if method == 1 else 0.0, np.clip(top / np.where(flat, 1, norm), -1, 1))

    return per_image(planes, run)
