"""Two-dimensional window operators. A plane is one row, so a window needs neither a shuffle nor a join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import planes as P
from gridloom.operators.common import COLS, D, ROWS, changed, paired
from gridloom.operators.kernels import match_template, ordered, weighted

Kernel = Sequence[Sequence[float]]
ERODE, DILATE, OPEN, CLOSE, GRADIENT, TOPHAT, BLACKHAT = range(7)


def _offsets(kernel: Kernel, anchor: tuple[int, int] = (-1, -1)) -> list[tuple[int, int, float]]:
    """(dy, dx, weight); the anchor is (x, y), and a negative part of it is the middle."""
    ax = anchor[0] if anchor[0] >= 0 else len(kernel[0]) // 2
    ay = anchor[1] if anchor[1] >= 0 else len(kernel) // 2
    return [(i - ay, j - ax, float(w)) for i, line in enumerate(kernel) for j, w in enumerate(line)]


#: Sums and orders of more values than this are numpy per image; the interpreted expressions would cost more than Arrow does.
EXPRESSION_TAPS = 9


def summed(planes: DataFrame, weights: list[tuple[int, int, float]], border: int) -> DataFrame:
    """Planes of the weighted sums around every pixel."""
    if len(weights) > EXPRESSION_TAPS:
        return weighted(planes, weights, border)
    return changed(planes, P.taps(D(), ROWS(), COLS(), weights, border))


def _each(planes: DataFrame, data: Column, depth: int, delta: float = 0.0, rule: str = "generic") -> DataFrame:
    return changed(planes, F.transform(data, lambda v: N.saturate(v + delta if delta else v, depth, rule)))


def filter2d(planes: DataFrame, kernel: Kernel, depth: int = N.F64, anchor: tuple[int, int] = (-1, -1), delta: float = 0.0, border: int = P.REFLECT_101) -> DataFrame:
    """Correlation with a kernel; a constant border counts as 0."""
    return _each(summed(planes, _offsets(kernel, anchor), border), D(), depth, delta)


def sep_filter2d(planes: DataFrame, kernel_x: Sequence[float], kernel_y: Sequence[float], depth: int = N.F64, anchor: tuple[int, int] = (-1, -1), delta: float = 0.0, border: int = P.REFLECT_101) -> DataFrame:
    """A row filter, then a column filter, with double precision between."""
    across = summed(planes, _offsets([kernel_x], (anchor[0], 0)), border)
    return _each(summed(across, _offsets([[w] for w in kernel_y], (0, anchor[1])), border), D(), depth, delta)


def box_filter(planes: DataFrame, rows: int, cols: int, depth: int = N.U8, normalise: bool = True, anchor: tuple[int, int] = (-1, -1), border: int = P.REFLECT_101, source: int = N.U8) -> DataFrame:
    """Sums or means of a box. Means of 8-bit values use the fixed-point reciprocal 65536 div area."""
    planes, sums = summed(planes, _offsets([[1.0] * cols] * rows, anchor), border), D()
    if not normalise:
        return _each(planes, sums, depth, rule="wrap" if depth == N.I32 else "generic")
    if source == N.U8 and depth == N.U8:
        scale = float(65536 // (rows * cols))
        return changed(planes, F.transform(sums, lambda v: F.least(F.lit(255.0), F.floor((v * scale + 32768) / 65536).cast("double"))))
    return changed(planes, F.transform(sums, lambda v: N.saturate(v / (rows * cols), depth)))


def blur(planes: DataFrame, rows: int, cols: int, depth: int = N.U8, anchor: tuple[int, int] = (-1, -1), border: int = P.REFLECT_101) -> DataFrame:
    return box_filter(planes, rows, cols, depth, True, anchor, border, depth)


def sqr_box_filter(planes: DataFrame, rows: int, cols: int, normalise: bool = True, anchor: tuple[int, int] = (-1, -1), border: int = P.REFLECT_101, depth: int = N.F32) -> DataFrame:
    squares = changed(planes, F.transform(D(), lambda v: v * v))
    return changed(summed(squares, _offsets([[1.0] * cols] * rows, anchor), border), F.transform(D(), lambda v: N.saturate(v / (rows * cols) if normalise else v, depth)))


def _square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def median_blur(planes: DataFrame, size: int) -> DataFrame:
    """The middle value of an odd square, the border repeated."""
    if size % 2 == 0 or size < 1:
        raise ValueError("the size is odd")
    if size * size > EXPRESSION_TAPS:
        return ordered(planes, _square(size), P.REPLICATE, 0.0, size * size // 2)
    return changed(planes, P.neighbours(D(), ROWS(), COLS(), _square(size), P.REPLICATE, 0.0, lambda v: F.get(F.array_sort(v), F.lit(size * size // 2))))


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    """Weights of sum 1; three taps without a sigma are 1/4, 1/2, 1/4."""
    if sigma <= 0 and size == 3:
        return [0.25, 0.5, 0.25]
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) / 2 - 1) + 0.8
    line = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(line) for w in line]


def gaussian_blur(planes: DataFrame, rows: int, cols: int, sigma_x: float, sigma_y: float = 0.0, border: int = P.REFLECT_101, depth: int = N.U8) -> DataFrame:
    x, y = gaussian_kernel(cols, sigma_x), gaussian_kernel(rows, sigma_y if sigma_y > 0 else sigma_x)
    return _each(summed(planes, _offsets([[a * b for b in x] for a in y]), border), D(), depth)


def _floored(whole: float):
    return lambda v: F.floor(v / whole).cast("double")


def stack_blur(planes: DataFrame, rows: int, cols: int, depth: int = N.U8) -> DataFrame:
    """Triangular weights 1 .. r + 1 .. 1 over rows, then columns; whole depths lose their fractions after each pass."""
    out = planes
    for size, line in ((cols, lambda w: [w]), (rows, lambda w: [[x] for x in w])):
        r = size // 2
        weights = [float(r + 1 - abs(k)) for k in range(-r, r + 1)]
        whole = float((r + 1) ** 2)
        scaled = [(dy, dx, w / whole) for dy, dx, w in _offsets(line(weights))] if depth not in N.RANGE else _offsets(line(weights))
        sums = P.taps(D(), ROWS(), COLS(), scaled, P.REPLICATE)
        out = changed(out, F.transform(sums, _floored(whole)) if depth in N.RANGE else sums)
    return out


def bilateral_filter(planes: DataFrame, diameter: int, sigma_color: float, sigma_space: float, border: int = P.REFLECT_101, depth: int = N.U8) -> DataFrame:
    """Each channel on its own, over a square window."""
    size = diameter if diameter > 0 else 2 * round(1.5 * sigma_space) + 1
    space, color = -0.5 / (sigma_space * sigma_space), -0.5 / (sigma_color * sigma_color)

    def value(d: Column, y: Column, x: Column) -> Column:
        centre, top, bottom = P.at(d, COLS(), y, x), F.lit(0.0), F.lit(0.0)
        for dy, dx in _square(size):
            v = F.coalesce(P.at(d, COLS(), P.border_index(y + dy, ROWS(), border), P.border_index(x + dx, COLS(), border)), F.lit(0.0))
            w = F.exp((v - centre) * (v - centre) * color + float((dy * dy + dx * dx) * space))
            top, bottom = top + w * v, bottom + w
        return N.saturate(top / bottom, depth)

    return changed(planes, P.grid_over(D(), ROWS(), COLS(), value))


def _extreme(planes: DataFrame, kernel: Kernel | None, anchor: tuple[int, int], iterations: int, border: int, outside: float | None, least: bool) -> DataFrame:
    used = [(dy, dx) for dy, dx, w in _offsets(kernel or [[1.0] * 3] * 3, anchor) if w != 0]
    neutral = float("inf") if least else float("-inf")
    for _ in range(iterations if used else 0):
        if len(used) > EXPRESSION_TAPS:
            planes = ordered(planes, used, border, neutral if outside is None else outside, 0 if least else -1)
            continue
        planes = changed(planes, P.neighbours(D(), ROWS(), COLS(), used, border, neutral if outside is None else outside, F.array_min if least else F.array_max))
    return planes


def erode(planes: DataFrame, kernel: Kernel | None = None, anchor: tuple[int, int] = (-1, -1), iterations: int = 1, border: int = P.CONSTANT, outside: float | None = None) -> DataFrame:
    """The least value under the kernel. A border without a value does not count."""
    return _extreme(planes, kernel, anchor, iterations, border, outside, True)


def dilate(planes: DataFrame, kernel: Kernel | None = None, anchor: tuple[int, int] = (-1, -1), iterations: int = 1, border: int = P.CONSTANT, outside: float | None = None) -> DataFrame:
    """The greatest value under the kernel; a border value is negated."""
    return _extreme(planes, kernel, anchor, iterations, border, None if outside is None else -outside, False)


def morphology_ex(planes: DataFrame, operation: int, kernel: Kernel | None = None, anchor: tuple[int, int] = (-1, -1), iterations: int = 1, border: int = P.CONSTANT) -> DataFrame:
    from gridloom.operators.arithmetic import subtract

    less = lambda p: erode(p, kernel, anchor, iterations, border)
    more = lambda p: dilate(p, kernel, anchor, iterations, border)
    if operation == GRADIENT:
        return subtract(more(planes), less(planes))
    if operation == TOPHAT:
        return subtract(planes, more(less(planes)))
    if operation == BLACKHAT:
        return subtract(less(more(planes)), planes)
    return {ERODE: less, DILATE: more, OPEN: lambda p: more(less(p)), CLOSE: lambda p: less(more(p))}[operation](planes)


_DIFFERENCE = {3: {0: [1, 2, 1], 1: [-1, 0, 1], 2: [1, -2, 1]}}


def _binomial(n: int) -> list[int]:
    return [math.comb(n, k) for k in range(n + 1)]


def derivative_kernel(order: int, size: int) -> list[float]:
    """Sobel's kernel: a binomial one differenced `order` times. Size 1 stands for 3 without smoothing."""
    if size == 1:
        return [0.0, 1.0, 0.0] if order == 0 else [float(v) for v in _DIFFERENCE[3][order]]
    line = _binomial(size - 1 - order)
    for _ in range(order):
        line = [(line[k - 1] if k else 0) - (line[k] if k < len(line) else 0) for k in range(len(line) + 1)]
    return [float(v) for v in line]


def _outer(y: Sequence[float], x: Sequence[float], scale: float = 1.0) -> list[list[float]]:
    return [[a * b * scale for b in x] for a in y]


def sobel(planes: DataFrame, dx: int, dy: int, depth: int = N.I16, size: int = 3, scale: float = 1.0, delta: float = 0.0, border: int = P.REFLECT_101) -> DataFrame:
    if not (0 <= dx <= 2 and 0 <= dy <= 2 and 1 <= dx + dy <= 2):
        raise ValueError("orders of 0 to 2, together 1 or 2")
    return filter2d(planes, _outer(derivative_kernel(dy, size), derivative_kernel(dx, size), scale), depth, delta=delta, border=border)


def scharr(planes: DataFrame, dx: int, dy: int, depth: int = N.I16, scale: float = 1.0, delta: float = 0.0, border: int = P.REFLECT_101) -> DataFrame:
    if (dx, dy) not in ((1, 0), (0, 1)):
        raise ValueError("one first derivative")
    smooth, step = [3.0, 10.0, 3.0], [-1.0, 0.0, 1.0]
    return filter2d(planes, _outer(smooth, step, scale) if dx else _outer(step, smooth, scale), depth, delta=delta, border=border)


def laplacian(planes: DataFrame, depth: int = N.I16, size: int = 1, scale: float = 1.0, delta: float = 0.0, border: int = P.REFLECT_101) -> DataFrame:
    if size == 1:
        kernel = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
    elif size == 3:
        kernel = [[2, 0, 2], [0, -8, 0], [2, 0, 2]]
    else:
        a, b = derivative_kernel(2, size), derivative_kernel(0, size)
        kernel = [[p + q for p, q in zip(u, v, strict=True)] for u, v in zip(_outer(b, a), _outer(a, b), strict=True)]
    return filter2d(planes, [[float(w) * scale for w in line] for line in kernel], depth, delta=delta, border=border)


def spatial_gradient(planes: DataFrame, border: int = P.REFLECT_101) -> tuple[DataFrame, DataFrame]:
    return sobel(planes, 1, 0, border=border), sobel(planes, 0, 1, border=border)


_FIVE = [1.0, 4.0, 6.0, 4.0, 1.0]


def pyr_down(planes: DataFrame, border: int = P.REFLECT_101, depth: int = N.U8) -> DataFrame:
    """Smoothed with five binomial weights a side, every other row and column kept."""
    if border & ~P.ISOLATED in (P.CONSTANT, P.WRAP):
        raise ValueError("unsupported border")
    smooth = summed(planes, _offsets(_outer(_FIVE, _FIVE)), border)
    finish = (lambda v: F.floor((v + 128) / 256).cast("double")) if depth in N.RANGE else (lambda v: v / 256)
    rows, cols = F.floor((ROWS() + 1) / 2).cast("int"), F.floor((COLS() + 1) / 2).cast("int")
    return changed(smooth, F.transform(P.gather(D(), COLS(), rows, cols, lambda y, x: (2 * y, 2 * x)), finish), rows, cols)


def pyr_up(planes: DataFrame, border: int = P.REFLECT_101, depth: int = N.U8) -> DataFrame:
    """Twice the size: zeros between the values, then the weights of pyr_down, four times as heavy."""

    def value(d: Column, y: Column, x: Column) -> Column:
        total = F.lit(0.0)
        for i, a in enumerate(_FIVE):
            for j, b in enumerate(_FIVE):
                sy, sx = P.border_index(y + i - 2, 2 * ROWS(), border), P.border_index(x + j - 2, 2 * COLS(), border)
                there = (F.pmod(sy, F.lit(2)) == 0) & (F.pmod(sx, F.lit(2)) == 0)
                total = total + F.when(there, P.at(d, COLS(), F.floor(sy / 2).cast("int"), F.floor(sx / 2).cast("int"))).otherwise(F.lit(0.0)) * (a * b)
        return F.floor((total + 32) / 64).cast("double") if depth in N.RANGE else total / 64

    return changed(planes, P.grid_over(D(), 2 * ROWS(), 2 * COLS(), value), 2 * ROWS(), 2 * COLS())


def _structure(planes: DataFrame, block: int, size: int, border: int, eight_bit: bool) -> DataFrame:
    """Planes with the block sums xx, xy and yy of gradient products, scaled."""
    scale = 1.0 / (2 ** (size - 1) * (255.0 if eight_bit else 1.0)) / block
    dx, dy = (P.taps(D(), ROWS(), COLS(), _offsets(_outer(derivative_kernel(b, size), derivative_kernel(a, size), scale)), border) for a, b in ((1, 0), (0, 1)))
    rows = planes.withColumns({"_dx": dx, "_dy": dy})
    box = _offsets([[1.0] * block] * block)
    pairs = {"xx": ("_dx", "_dx"), "xy": ("_dx", "_dy"), "yy": ("_dy", "_dy")}
    rows = rows.withColumns({f"_{k}": F.zip_with(a, b, lambda p, q: p * q) for k, (a, b) in pairs.items()})
    return rows.withColumns({k: P.taps(F.col(f"_{k}"), ROWS(), COLS(), box, border) for k in pairs})


def corner_harris(planes: DataFrame, block: int, size: int, k: float, border: int = P.REFLECT_101, eight_bit: bool = True) -> DataFrame:
    rows = _structure(planes, block, size, border, eight_bit)
    return changed(rows, F.transform(F.arrays_zip("xx", "xy", "yy"), lambda t: t["xx"] * t["yy"] - t["xy"] * t["xy"] - k * (t["xx"] + t["yy"]) * (t["xx"] + t["yy"])))


def corner_min_eigen_val(planes: DataFrame, block: int, size: int = 3, border: int = P.REFLECT_101, eight_bit: bool = True) -> DataFrame:
    rows = _structure(planes, block, size, border, eight_bit)
    return changed(rows, F.transform(F.arrays_zip("xx", "xy", "yy"), lambda t: (t["xx"] + t["yy"]) / 2 - F.sqrt((t["xx"] - t["yy"]) * (t["xx"] - t["yy"]) / 4 + t["xy"] * t["xy"])))


def pre_corner_detect(planes: DataFrame, size: int = 3, border: int = P.REFLECT_101, eight_bit: bool = True) -> DataFrame:
    """Dx^2 Dyy + Dy^2 Dxx - 2 Dx Dy Dxy."""
    scale = 1.0 / (2 ** (size - 1) * (255.0 if eight_bit else 1.0))
    orders = {"dx": (1, 0), "dy": (0, 1), "dxx": (2, 0), "dyy": (0, 2), "dxy": (1, 1)}
    rows = planes.withColumns({k: P.taps(D(), ROWS(), COLS(), _offsets(_outer(derivative_kernel(b, size), derivative_kernel(a, size), scale)), border) for k, (a, b) in orders.items()})
    return changed(rows, F.transform(F.arrays_zip(*orders), lambda t: t["dx"] * t["dx"] * t["dyy"] + t["dy"] * t["dy"] * t["dxx"] - 2 * t["dx"] * t["dy"] * t["dxy"]))


def gradient_magnitude(planes: DataFrame, border: int = P.REFLECT_101) -> DataFrame:
    x, y = spatial_gradient(planes, border)
    return changed(paired(x, y), F.zip_with(D(), "data2", lambda a, b: F.abs(a) + F.abs(b)))
