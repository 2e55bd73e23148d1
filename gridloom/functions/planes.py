"""Planes: one row per image channel, its values row by row in one array.

A plane is (img, c, rows, cols, data ARRAY<DOUBLE>). All values of a plane are in one row, so windows, warps and
reductions are expressions over an array that need no shuffle; two images meet in one equi-join on (img, c). The
functions here build such expressions; they stay in the JVM and are evaluated lazily with the rest of a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANT, REPLICATE, REFLECT, WRAP, REFLECT_101, ISOLATED = 0, 1, 2, 3, 4, 16

Number = Column | int | float


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once. A column that a lambda names may be replaced by its own expression when
    projections are merged, and would then be computed anew for every element; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def border_index(p: Column, n: Number, border: int) -> Column:
    """The index inside 0 .. n-1 that stands for p; null where a constant border has no pixel."""
    n, kind = col(n), border & ~ISOLATED
    if kind == REPLICATE:
        return F.greatest(F.lit(0), F.least(n - 1, p))
    if kind == WRAP:
        return F.pmod(p, n)
    if kind == REFLECT:
        k = F.pmod(p, 2 * n)
        return F.when(k < n, k).otherwise(2 * n - 1 - k)
    if kind == REFLECT_101:
        k = F.pmod(p, F.greatest(F.lit(1), 2 * n - 2))
        return F.when(n == 1, F.lit(0)).when(k < n, k).otherwise(2 * n - 2 - k)
    return F.when((p >= 0) & (p < n), p)


def border_place(p: int, n: int, border: int) -> int | None:
    """border_index for Python integers."""
    kind = border & ~ISOLATED
    if 0 <= p < n:
        return p
    if kind == REPLICATE:
        return min(max(p, 0), n - 1)
    if kind == WRAP:
        return p % n
    if kind == REFLECT:
        k = p % (2 * n)
        return k if k < n else 2 * n - 1 - k
    if kind == REFLECT_101:
        k = p % max(1, 2 * n - 2)
        return 0 if n == 1 else k if k < n else 2 * n - 2 - k
    return None


def grid(rows: Number, cols: Number, value: Callable[[Column, Column], Column]) -> Column:
    """An array of rows x cols values, each from its y and x."""
    rows, cols = col(rows), col(cols)
    cells = F.transform(F.sequence(F.lit(0), rows * cols - 1), lambda i: value(_div(i, cols), F.pmod(i, cols)))
    return F.when(rows * cols > 0, cells).otherwise(F.array().cast("array<double>"))


def grid_over(data: Column, rows: Number, cols: Number, value: Callable[[Column, Column, Column], Column]) -> Column:
    """An array of rows x cols values, each from data, its y and x."""
    return let(data, lambda d: grid(rows, cols, lambda y, x: value(d, y, x)))


def at(data: Column, cols: Number, y: Column, x: Column) -> Column:
    """The value at (y, x); null if either is null."""
    return F.get(data, (y * col(cols) + x).cast("int"))


def gather(data: Column, cols: Number, out_rows: Number, out_cols: Number, source: Callable[[Column, Column], tuple[Column, Column]], outside: Number = 0.0) -> Column:
    """An array whose value at (y, x) is that of `source(y, x)`, or `outside` where source gives null."""
    return let(data, lambda d: grid(out_rows, out_cols, lambda y, x: F.coalesce(at(d, cols, *source(y, x)), col(outside))))


def taps(data: Column, rows: Number, cols: Number, weights: list[tuple[int, int, float]], border: int, outside: float = 0.0) -> Column:
    """At every pixel the sum of weight * value at (y + dy, x + dx) over the weights (dy, dx, weight)."""

    def value(d: Column, y: Column, x: Column) -> Column:
        total = None
        for dy, dx, w in weights:
            if w == 0:
                continue
            v = F.coalesce(at(d, cols, border_index(y + dy, rows, border), border_index(x + dx, cols, border)), F.lit(float(outside)))
            v = v if w == 1 else v * F.lit(float(w))
            total = v if total is None else total + v
        return F.lit(0.0) if total is None else total

    return grid_over(data, rows, cols, value)


def neighbours(data: Column, rows: Number, cols: Number, offsets: list[tuple[int, int]], border: int, outside: float, reduce: Callable[[Column], Column]) -> Column:
    """At every pixel `reduce` of the array of values at the offsets (dy, dx)."""

    def value(d: Column, y: Column, x: Column) -> Column:
        return reduce(F.array(*[F.coalesce(at(d, cols, border_index(y + dy, rows, border), border_index(x + dx, cols, border)), F.lit(float(outside))) for dy, dx in offsets]))

    return grid_over(data, rows, cols, value)


def total(data: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    """The sum of `of` each value, from the first to the last."""
    return F.aggregate(data, F.lit(0.0), lambda acc, v: acc + of(v))


def running(data: Column, rows: Number, cols: Number) -> Column:
    """Summed-area table with a leading row and column of zeros: value at (y, x) is the sum of all above and to the left."""
    return let(data, lambda d: _running(d, rows, cols))


def _running(data: Column, rows: Number, cols: Number) -> Column:
    rows, cols = col(rows), col(cols)
    start = F.transform(F.sequence(F.lit(0), cols), lambda _: F.lit(0.0))

    def row(y: Column) -> Column:
        line = F.slice(data, y * cols + 1, cols)
        return F.aggregate(line, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def add(acc: Column, y: Column) -> Column:
        last = F.slice(acc, -(cols + 1), cols + 1)
        return F.concat(acc, F.zip_with(last, row(y), lambda a, b: a + b))

    return F.aggregate(F.sequence(F.lit(0), rows - 1), start, add)
