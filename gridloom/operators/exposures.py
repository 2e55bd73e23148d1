"""Exposures of one scene: fusion by quality, radiance by response, the response itself, and alignment by bitmaps.

Planes come with a table (img, scene, seconds) of exposures; images that it doesn't list are left out, a null scene is
none. Sums over a scene's exposures are grouped by pixel, so a scene of any number of exposures is spread over tasks.
Exposures of a scene have one size. The merged planes have the scene as their img.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import planes as P
from gridloom.functions.tables import settled
from gridloom.operators.common import D, changed, mapped, paired
from gridloom.operators.neighbourhood import _FIVE, _offsets, _outer, pyr_down, summed

LEVELS = 256
_CROSS = [(0, 0, -4.0), (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)]


def tent(z: Column) -> Column:
    """How far a level can be trusted: 1 at both ends, 128 in the middle."""
    return F.when(z < LEVELS // 2, z + 1.0).otherwise(LEVELS - z)


def _level(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(LEVELS - 1.0), F.rint(v)))


def _of_scenes(planes: DataFrame, exposures: DataFrame) -> DataFrame:
    shots = exposures.where("scene IS NOT NULL").select("img", "scene", F.col("seconds").cast("double").alias("seconds"))
    return planes.join(shots, "img")


def added(df: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """The arrays `names` of (rows, cols) planes added up value by value over all rows of equal keys."""
    px = df.select(*keys, "rows", "cols", F.posexplode(F.arrays_zip(*[F.col(n) for n in names])).alias("_i", "_v"))
    sums = px.groupBy(*keys, "rows", "cols", "_i").agg(*[F.sum(f"_v.{n}").alias(n) for n in names])
    whole = sums.groupBy(*keys).agg(*[F.min(x).alias(f"_{x}") for x in ("rows", "cols")], F.max("rows").alias("rows"), F.max("cols").alias("cols"), F.array_sort(F.collect_list(F.struct("_i", *names))).alias("_p"))
    same = (F.col("_rows") == F.col("rows")) & (F.col("_cols") == F.col("cols"))
    rows = F.when(same, F.col("rows")).otherwise(F.raise_error(F.lit("exposures of a scene differ in size")))
    return whole.select(*keys, rows.alias("rows"), "cols", *[F.col("_p")[n].alias(n) for n in names])


def _stacked(planes: DataFrame) -> DataFrame:
    """(img, rows, cols, _p): an image's channels, of which there are few, in one row."""
    return planes.groupBy("img").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.transform(F.array_sort(F.collect_list(F.struct("c", "data"))), lambda p: p["data"]).alias("_p"))


def _per_pixel(use) -> Column:
    """An array with use(values of all channels) for every pixel of a stacked image."""
    return P.let(F.col("_p"), lambda p: F.transform(F.get(p, F.lit(0)), lambda _, i: use(F.transform(p, lambda d: F.get(d, i)))))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def quality(planes: DataFrame, contrast: float = 1.0, saturation: float = 1.0, exposedness: float = 1.0) -> DataFrame:
    """One plane per image of unit values: what each pixel is worth, from contrast, saturation (three channels only) and
    nearness to the middle of the range, each to its power."""
    gray = _per_pixel(lambda v: F.when(F.size(v) == 3, F.get(v, F.lit(0)) * 0.299 + F.get(v, F.lit(1)) * 0.587 + F.get(v, F.lit(2)) * 0.114).otherwise(F.get(v, F.lit(0))))
    spread = _per_pixel(lambda v: F.when(F.size(v) == 3, P.let(_mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))))).otherwise(F.lit(1.0)))
    middle = _per_pixel(lambda v: F.exp(F.aggregate(v, F.lit(0.0), lambda s, x: s - (x - 0.5) * (x - 0.5) / 0.08)))
    parts = _stacked(planes).select("img", F.lit(0).alias("c"), "rows", "cols", gray.alias("_g"), spread.alias("_s"), middle.alias("_m"))
    edges = P.taps(F.col("_g"), F.col("rows"), F.col("cols"), _CROSS, P.REFLECT_101)
    worth = F.transform(F.arrays_zip(edges.alias("_e"), "_s", "_m"), lambda t: F.pow(F.abs(t["_e"]), F.lit(contrast)) * F.pow(t["_s"], F.lit(saturation)) * F.pow(t["_m"], F.lit(exposedness)) + 1e-12)
    return parts.select("img", "c", "rows", "cols", worth.alias("data"))


def _raised(planes: DataFrame, like: DataFrame) -> DataFrame:
    """pyr_up to the size of `like`, whose odd sides lack the last row or column. Many taps, so numpy per image."""
    even = lambda k: F.when(F.pmod(k, F.lit(2)) == 0, F.floor(k / 2).cast("int"))
    spread = changed(planes, P.gather(D(), F.col("cols"), 2 * F.col("rows"), 2 * F.col("cols"), lambda y, x: (even(y), even(x))), 2 * F.col("rows"), 2 * F.col("cols"))
    full = summed(spread, _offsets(_outer(_FIVE, _FIVE)), P.REFLECT_101)
    sizes = like.select("img", "c", F.col("rows").alias("_r"), F.col("cols").alias("_c"))
    whole = (F.col("_r") == F.col("rows")) & (F.col("_c") == F.col("cols"))
    cut = P.gather(D(), F.col("cols"), F.col("_r"), F.col("_c"), lambda y, x: (y, x))
    return changed(full.join(sizes, ["img", "c"]).withColumn("data", F.transform(F.when(whole, D()).otherwise(cut), lambda v: v / 64)), D(), F.col("_r"), F.col("_c"))


def _combined(a: DataFrame, b: DataFrame, value) -> DataFrame:
    return changed(paired(a, b), F.zip_with(D(), F.col("data2"), value))


def merge_mertens(planes: DataFrame, exposures: DataFrame, contrast: float = 1.0, saturation: float = 1.0, exposedness: float = 1.0) -> DataFrame:
    """Exposure fusion: 8-bit planes in, planes of unit values out, blended by quality at every level of a pyramid.

    Levels go down as often as the shorter side can be halved; each image takes part in as many levels as it has.
    """
    shots = _of_scenes(planes, exposures)
    # the bits of the shorter side, less one, are the levels below an image
    top = (F.length(F.bin(F.least("rows", "cols"))) - 1).alias("_top")
    scenes = settled(shots.select("img", "scene", top).distinct())
    unit = settled(mapped(shots.select("img", "c", "rows", "cols", "data"), lambda v: v / 255.0))
    worth = settled(quality(unit, contrast, saturation, exposedness).join(scenes, "img"))
    sums = added(worth, ["scene"], "data").select("scene", F.col("data").alias("_t"))
    weight = worth.join(sums, "scene").select("img", "c", "rows", "cols", F.zip_with("data", "_t", lambda v, t: v / t).alias("data"))
    last = scenes.agg(F.max("_top")).first()[0] or 0
    levels, image = [], unit
    for level in range(last + 1):
        weight, detail = settled(weight), image
        if level < last:
            deeper = scenes.where(F.col("_top") > level).select("img")
            lower = settled(pyr_down(image.join(deeper, "img", "left_semi"), depth=N.F64))
            detail = _combined(image, _raised(lower, image), lambda v, u: v - u).unionByName(image.join(deeper, "img", "left_anti"))
        blended = paired(detail, _every_channel(weight, detail)).join(scenes, "img").withColumn("_v", F.zip_with("data", "data2", lambda v, w: v * w))
        levels.append(settled(added(blended, ["scene", "c"], "_v").select(F.col("scene").alias("img"), "c", "rows", "cols", F.col("_v").alias("data"))))
        if level < last:
            image, weight = lower, pyr_down(weight.join(deeper, "img", "left_semi"), depth=N.F64)
    out = levels[-1]
    for below in reversed(levels[:-1]):
        up = _raised(out, below)
        out = settled(_combined(below, up, lambda v, u: v + u).unionByName(below.join(out, ["img", "c"], "left_anti")))
    return out


def _every_channel(weight: DataFrame, planes: DataFrame) -> DataFrame:
    """The weights of an image once for each of its channels."""
    return planes.select("img", "c").join(weight.drop("c"), "img").select("img", "c", "rows", "cols", "data")


def merge_debevec(planes: DataFrame, exposures: DataFrame, response: DataFrame | None = None) -> DataFrame:
    """Radiance: 8-bit planes in, planes of radiances out, the mean of log response less log seconds, weighted by the
    mean of `tent` over the channels. `response` is (c, level, response); without it, it is the level, that of 0 being 1.
    """
    shots = _of_scenes(planes, exposures)
    if shots.where("seconds IS NULL OR NOT seconds > 0").limit(1).count():
        raise ValueError("an exposure takes over 0 seconds")
    trust = _stacked(shots.select("img", "c", "rows", "cols", "data")).select("img", _per_pixel(lambda v: _mean(F.transform(v, lambda x: tent(_level(x))))).alias("_w"))
    terms = shots.join(trust, "img")
    if response is None:
        curve = lambda v: F.log(F.greatest(F.lit(1.0), _level(v)))
    else:
        # 256 rows a channel
        curves = response.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "response"))), lambda p: F.log(p["response"])).alias("_g"))
        terms = terms.join(F.broadcast(curves), "c")
        curve = lambda v: F.get(F.col("_g"), _level(v).cast("int"))
    late = F.log("seconds")
    terms = terms.withColumn("_x", P.let(late, lambda t: F.zip_with("data", "_w", lambda v, w: w * (curve(v) - t))))
    sums = added(terms, ["scene", "c"], "_x", "_w")
    return sums.select(F.col("scene").alias("img"), "c", "rows", "cols", F.zip_with("_x", "_w", lambda x, w: F.exp(x / w)).alias("data"))


def calibrate_debevec(planes: DataFrame, exposures: DataFrame, samples: int = 70, smoothness: float = 10.0) -> DataFrame:
    """The response (c, level, response) of every channel by least squares over all pixels of all scenes.

    A pixel's unknown radiance is eliminated where the pixel is: what is left are sums per pair of levels, 256 x 256 a
    channel whatever the input. They weigh as much as `samples` pixels beside the smoothness of the log response.
    """
    shots = _of_scenes(planes, exposures)
    px = shots.select("scene", "c", F.log("seconds").alias("_t"), F.posexplode("data").alias("_i", "_v")).withColumn("z", _level(F.col("_v")).cast("int"))
    u = tent(F.col("z")) * tent(F.col("z"))
    seen = px.groupBy("scene", "c", "_i", "z").agg(F.sum(u).alias("u"), F.sum(u * F.col("_t")).alias("b"))
    # at most 256 levels a pixel
    point = seen.groupBy("scene", "c", "_i").agg(F.collect_list(F.struct("z", "u", "b")).alias("_l"), F.sum("u").alias("_u"), F.sum("b").alias("_b"))
    point = settled(point)
    each = point.select("c", "_u", "_b", "_l", F.explode("_l").alias("a"))
    right = each.groupBy("c", F.col("a.z").alias("z")).agg(F.sum("a.u").alias("d"), F.sum(F.col("a.b") - F.col("a.u") * F.col("_b") / F.col("_u")).alias("b"))
    both = each.select("c", "_u", "a", F.explode("_l").alias("e")).groupBy("c", F.col("a.z").alias("z"), F.col("e.z").alias("y")).agg(F.sum(F.col("a.u") * F.col("e.u") / F.col("_u")).alias("n"))
    counts = {r.c: r["count"] for r in point.groupBy("c").count().collect()}
    ends = {c: (np.zeros((LEVELS, LEVELS)), np.zeros(LEVELS)) for c in counts}
    for r in right.collect():  # at most 256 rows a channel
        ends[r.c][0][r.z, r.z] += r.d
        ends[r.c][1][r.z] += r.b
    for r in both.collect():  # at most 65,536 rows a channel
        ends[r.c][0][r.z, r.y] -= r.n
    weight = np.minimum(np.arange(LEVELS) + 1.0, LEVELS - np.arange(LEVELS))
    bend = np.zeros((LEVELS - 1, LEVELS))
    for k in range(LEVELS - 2):
        bend[k, k : k + 3] = smoothness * weight[k + 1] * np.array([1.0, -2.0, 1.0])
    bend[-1, LEVELS // 2] = 1.0  # the response of the middle level is 1
    rows = []
    for c, (normal, side) in sorted(ends.items()):
        scale = samples / counts[c]
        log = np.linalg.lstsq(normal * scale + bend.T @ bend, side * scale, rcond=None)[0]
        rows += [(c, k, float(math.exp(v))) for k, v in enumerate(log)]
    return planes.sparkSession.createDataFrame(rows, "c int, level int, response double")
