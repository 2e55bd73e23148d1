"""Linear algebra and transforms as expressions over planes, and k-means as a loop of joins over a checked small side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import planes as P
from gridloom.operators.common import COLS, D, ROWS, changed, paired

TRANSPOSE_A, TRANSPOSE_B, TRANSPOSE_C = 1, 2, 4


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, c: DataFrame | None = None, beta: float = 0.0, flags: int = 0) -> DataFrame:
    """alpha * A B + beta * C for matrices of equal img and c; the flags transpose operands first."""
    from gridloom.operators.layout import transpose

    a, b = transpose(a) if flags & TRANSPOSE_A else a, transpose(b) if flags & TRANSPOSE_B else b
    both = a.join(b.select("img", "c", F.col("rows").alias("_r"), F.col("cols").alias("_k"), F.col("data").alias("_b")), ["img", "c"])
    fits = F.when(COLS() == F.col("_r"), F.col("_b")).otherwise(F.raise_error(F.lit("matrices do not fit")))

    def product(x: Column, y: Column) -> Column:
        cell = lambda i, j: F.aggregate(F.sequence(F.lit(0), COLS() - 1), F.lit(0.0), lambda s, k: s + F.get(x, i * COLS() + k) * F.get(y, k * F.col("_k") + j))
        return P.grid(ROWS(), F.col("_k"), lambda i, j: cell(i, j) * float(alpha))

    out = changed(both, P.let(D(), lambda x: P.let(fits, lambda y: product(x, y))), ROWS(), F.col("_k"))
    if c is None or beta == 0:
        return out
    return changed(paired(out, transpose(c) if flags & TRANSPOSE_C else c), F.zip_with(D(), "data2", lambda p, q: p + q * float(beta)))


def dft(planes: DataFrame, imaginary: bool = False) -> DataFrame:
    """The real (or imaginary) part of the forward transform, a row pass and a column pass."""

    def value(d: Column, v: Column, u: Column) -> Column:
        def turn(i: Column) -> Column:
            y, x = F.floor(i / COLS()), F.pmod(i, COLS())
            return (v * y / ROWS() + u * x / COLS()) * (2 * math.pi)

        wave = (lambda t: -F.sin(t)) if imaginary else F.cos
        return F.aggregate(F.sequence(F.lit(0), ROWS() * COLS() - 1), F.lit(0.0), lambda s, i: s + F.get(d, i) * wave(turn(i)))

    return changed(planes, P.grid_over(D(), ROWS(), COLS(), value))


def hanning_window(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """(y, x, v)."""
    if rows < 2 or cols < 2:
        raise ValueError("sides of 2 or more")
    at = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("y"), F.pmod("id", F.lit(cols)).cast("int").alias("x"))
    w = lambda c, n: 0.5 * (1 - F.cos(F.col(c) * (2 * math.pi / (n - 1))))
    return at.withColumn("v", F.sqrt(w("y", rows) * w("x", cols)))


def optimal_dft_sizes(numbers: DataFrame) -> DataFrame:
    """(n, size) for each distinct n: the least number of at least n without prime factors over 5, or -1."""
    sizes = sorted({2**a * 3**b * 5**c for a in range(32) for b in range(20) for c in range(14) if 2**a * 3**b * 5**c <= 2_125_764_000})
    table = F.array(*[F.lit(s) for s in sizes])
    found = F.element_at(F.filter(table, lambda s: s >= F.col("n")), 1)
    return numbers.select("n").distinct().select("n", F.when((F.col("n") < 0) | (F.col("n") >= 2_125_764_000), F.lit(-1)).otherwise(found).cast("long").alias("size"))


# fixed values: the height of each face's capitals in its own units
FONT_HEIGHTS = (21, 9, 21, 21, 21, 13, 21, 21)


def font_scale(face: int, pixels: int, thickness: int = 1) -> float:
    """The scale at which a face, upright or slanted (+ 16), has that height."""
    if not 0 <= face & ~16 < len(FONT_HEIGHTS):
        raise ValueError(f"no face {face}")
    return (pixels - (max(thickness, -1) + 1) / 2) / FONT_HEIGHTS[face & ~16]


def kmeans(points: DataFrame, k: int, iterations: int = 10) -> DataFrame:
    """(label, center) of points (id, v array<double>): seeded with the point farthest from the origin, then the one
    farthest from all seeds; k centers are literals of each plan, points are only read, and one row per label is gathered."""
    square = lambda v, c: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in c]), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    far = lambda score: points.select(F.max_by("v", F.struct(score, -F.col("id"))).alias("v")).first()["v"]
    centers = [far(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))]
    while len(centers) < k:
        centers.append(far(F.least(*[square("v", c) for c in centers]) if len(centers) > 1 else square("v", centers[0])))
    for _ in range(iterations):
        nearest = F.array_min(F.array(*[F.struct(square("v", c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centers)]))["j"]
        means = F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(len(centers[0]))])
        rows = points.withColumn("label", nearest).groupBy("label").agg(means.alias("center")).collect()  # k rows
        moved = {r["label"]: r["center"] for r in rows}
        centers = [moved.get(j, c) for j, c in enumerate(centers)]
    return points.sparkSession.createDataFrame(list(enumerate(centers)), "label int, center array<double>")
