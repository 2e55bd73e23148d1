"""Alignment of exposures by median bitmaps: shifts that leave the fewest differing bits, from coarse to fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import planes as P
from gridloom.functions.tables import settled
from gridloom.operators.arithmetic import to_gray
from gridloom.operators.common import D, changed


def grayed(planes: DataFrame) -> DataFrame:
    """One 8-bit plane per image: the luma of three channels, else the first channel."""
    three = planes.groupBy("img").agg(F.count(F.lit(1)).alias("_k")).where("_k = 3").select("img")
    return to_gray(planes.join(three, "img"), 2).unionByName(planes.where("c = 0").join(three, "img", "left_anti"))


def _sampled(data: Column, cols: Column, step: int) -> Column:
    """Every step-th value of every step-th row; what is left over at the ends goes."""
    return P.gather(data, cols, F.floor(F.col("rows") / step).cast("int"), F.floor(F.col("cols") / step).cast("int"), lambda y, x: (y * step, x * step))


def bitmap(data: Column, exclude: float) -> Column:
    """3 where a value is above the median and far from it, 2 where it is below and far, 0 within `exclude` of it. The
    median is one more than the last of the lower half."""
    half = F.floor(F.size(data) / 2).cast("int")
    median = F.when(half > 0, F.get(F.array_sort(data), half - 1) + 1).otherwise(F.lit(0.0))
    return P.let(median, lambda m: F.transform(data, lambda v: F.when(F.abs(v - m) > exclude, F.when(v > m, F.lit(3)).otherwise(F.lit(2))).otherwise(F.lit(0))))


def _differing(a: Column, b: Column, rows: Column, cols: Column, sy: Column, sx: Column) -> Column:
    """Bits of a that differ from those of b moved by (sy, sx); excluded ones and those outside count on neither side."""

    def bit(sum_: Column, v: Column, i: Column) -> Column:
        y, x = F.floor(i / cols).cast("int") - sy, F.pmod(i, cols) - sx
        inside = (y >= 0) & (x >= 0) & (y < rows) & (x < cols)
        return sum_ + F.when(inside & (v + F.get(b, (y * cols + x).cast("int")) == 5), 1).otherwise(0)

    pairs = F.arrays_zip(a.alias("v"), F.sequence(F.lit(0), F.size(a) - 1).alias("i"))
    return F.aggregate(pairs, F.lit(0), lambda s, t: bit(s, t["v"], t["i"]))


def pivots(exposures: DataFrame) -> DataFrame:
    """(img, scene, pivot): the image in the middle of its scene, by img."""
    own = Window.partitionBy("scene")
    placed = exposures.where("scene IS NOT NULL").select("img", "scene").distinct().withColumns({"_k": F.row_number().over(own.orderBy("img")) - 1, "_n": F.count(F.lit(1)).over(own)})
    middle = placed.where(F.col("_k") == F.floor(F.col("_n") / 2)).select("scene", F.col("img").alias("pivot"))
    return placed.select("img", "scene").join(middle, "scene").select("img", "scene", "pivot")


def shifts(planes: DataFrame, exposures: DataFrame, max_bits: int = 6, exclude: float = 4.0) -> DataFrame:
    """(img, scene, pivot, dx, dy, differing): how far each exposure of a scene has to move to lie on the scene's pivot.

    At most max_bits levels, of halved sides. At each the shift is doubled and its eight neighbours are tried too; of
    equal ones the first by dx, then dy, is taken. Bits that are moved out of the image differ from none, so small images
    want few levels. A pair of images is one row, joined once.
    """
    if max_bits < 1:
        raise ValueError("at least one level")
    gray = settled(grayed(planes))
    listed = pivots(exposures.join(gray.select("img"), "img", "left_semi"))
    first = gray.select(F.col("img").alias("pivot"), "rows", "cols", F.col("data").alias("_a"))
    other = gray.select("img", F.col("rows").alias("_r"), F.col("cols").alias("_c"), F.col("data").alias("_b"))
    both = listed.join(first, "pivot").join(other, "img")
    same = (F.col("rows") == F.col("_r")) & (F.col("cols") == F.col("_c"))
    both = both.withColumn("_b", F.when(same, F.col("_b")).otherwise(F.raise_error(F.lit("exposures of a scene differ in size"))))
    # bits of the longer side, less two: the coarsest level
    top = F.greatest(F.lit(0), F.least(F.length(F.bin(F.greatest("rows", "cols"))) - 2, F.lit(max_bits - 1)))
    both = settled(both.select("img", "scene", "pivot", "rows", "cols", "_a", "_b", top.alias("_top"), F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0).alias("differing")))
    for level in range(both.agg(F.max("_top")).first()[0] or 0, -1, -1):
        step = 1 << level
        rows, cols = F.floor(F.col("rows") / step).cast("int"), F.floor(F.col("cols") / step).cast("int")
        ready = settled(both.withColumns({"_p": bitmap(_sampled(F.col("_a"), F.col("cols"), step), exclude), "_q": bitmap(_sampled(F.col("_b"), F.col("cols"), step), exclude), "_h": rows, "_w": cols, "_x": 2 * F.col("dx"), "_y": 2 * F.col("dy")}))
        tried = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        err = F.transform(tried, lambda t: F.struct(_differing(F.col("_p"), F.col("_q"), F.col("_h"), F.col("_w"), F.col("_y") + t["j"], F.col("_x") + t["i"]).alias("e"), t["i"].alias("i"), t["j"].alias("j")))
        now = (F.col("_top") >= level) & (F.size("_p") > 0)
        best = ready.withColumn("_best", F.when(now, F.array_min(err)))
        moved = F.col("_best.e") < F.size("_p")
        both = settled(
            best.select(
                "img", "scene", "pivot", "rows", "cols", "_a", "_b", "_top",
                F.when(now & moved, F.col("_x") + F.col("_best.i")).otherwise(F.col("_x")).alias("dx"),
                F.when(now & moved, F.col("_y") + F.col("_best.j")).otherwise(F.col("_y")).alias("dy"),
                F.coalesce(F.col("_best.e"), F.lit(0)).alias("differing"),
            )
        )
    return both.select("img", "scene", "pivot", "dx", "dy", "differing")


def shifted_planes(planes: DataFrame, moves: DataFrame) -> DataFrame:
    """Planes moved by (img, dx, dy); what comes in from outside is 0."""
    both = planes.join(moves.select("img", "dx", "dy"), "img")

    def source(y: Column, x: Column) -> tuple[Column, Column]:
        v, u = y - F.col("dy"), x - F.col("dx")
        inside = (v >= 0) & (u >= 0) & (v < F.col("rows")) & (u < F.col("cols"))
        return F.when(inside, v), F.when(inside, u)

    return changed(both, P.gather(D(), F.col("cols"), F.col("rows"), F.col("cols"), source))


def align_mtb(planes: DataFrame, exposures: DataFrame, max_bits: int = 6, exclude: float = 4.0) -> DataFrame:
    """The planes of all exposures, moved onto their scene's pivot."""
    return shifted_planes(planes, shifts(planes, exposures, max_bits, exclude))
