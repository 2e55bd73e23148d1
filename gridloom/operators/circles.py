"""Circles by votes along gradients. Votes are rows that are counted where they arise and then by place, so no task holds
an accumulator; peaks, the choice among near centres and radii are joins of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions.tables import settled
from gridloom.operators.common import paired
from gridloom.operators.kernels import canny
from gridloom.operators.neighbourhood import sobel

_PLANE = ["img", "c"]


def edge_gradients(planes: DataFrame, edges: DataFrame) -> DataFrame:
    """(img, c, rows, cols, y, x, dx, dy) of the edges' pixels that have a gradient."""
    both = paired(edges, sobel(planes, 1, 0, depth=N.F64), sobel(planes, 0, 1, depth=N.F64))
    px = both.select("img", "c", "rows", "cols", F.posexplode(F.arrays_zip("data", F.col("data2").alias("dx"), F.col("data3").alias("dy"))).alias("_i", "_v"))
    px = px.where((F.col("_v.data") != 0) & ((F.col("_v.dx") != 0) | (F.col("_v.dy") != 0)))
    return px.select("img", "c", "rows", "cols", F.floor(F.col("_i") / F.col("cols")).cast("int").alias("y"), F.pmod("_i", "cols").alias("x"), "_v.dx", "_v.dy")


def circle_votes(gradients: DataFrame, dp: float, min_radius: int, max_radius: int) -> DataFrame:
    """(img, c, cy, cx, votes): every edge pixel votes for the cells, dp pixels a side, at each radius on both sides of it."""
    long = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * dp
    rays = gradients.withColumn("_long", long).withColumn("_r", F.explode(F.concat(F.sequence(F.lit(min_radius), F.lit(max_radius)), F.sequence(F.lit(-max_radius), F.lit(-min_radius)))))
    cell = lambda p, d: F.floor(F.col(p) / dp + 0.5 + F.col("_r") * F.col(d) / F.col("_long")).cast("int")
    votes = rays.select(*_PLANE, "rows", "cols", cell("y", "dy").alias("cy"), cell("x", "dx").alias("cx"))
    inside = (F.col("cy") >= 0) & (F.col("cx") >= 0) & (F.col("cy") < F.ceil(F.col("rows") / dp)) & (F.col("cx") < F.ceil(F.col("cols") / dp))
    return votes.where(inside).groupBy(*_PLANE, "cy", "cx").agg(F.count(F.lit(1)).alias("votes"))


def peaks(votes: DataFrame, threshold: int) -> DataFrame:
    """Cells with over threshold votes, more than the cells to the left and above, no fewer than those to the right and
    below: one shuffle, in which each cell tells its neighbours."""
    to = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate([(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)])]))
    told = votes.select("*", to.alias("_t")).select(*_PLANE, (F.col("cy") + F.col("_t.dy")).alias("cy"), (F.col("cx") + F.col("_t.dx")).alias("cx"), "_t.k", "votes")
    of = lambda *ks: F.coalesce(F.max(F.when(F.col("k").isin(*ks), F.col("votes"))), F.lit(0))
    cells = told.groupBy(*_PLANE, "cy", "cx").agg(of(0).alias("votes"), of(1, 2).alias("_before"), of(3, 4).alias("_after"))
    return cells.where((F.col("votes") > threshold) & (F.col("votes") > F.col("_before")) & (F.col("votes") >= F.col("_after"))).drop("_before", "_after")


def _around(df: DataFrame, y: str, x: str, side: float, spread: bool) -> DataFrame:
    """df by square of a grid; with spread, also by the squares beside."""
    square = lambda k: F.floor(F.col(k) / side).cast("int")
    if not spread:
        return df.withColumns({"_gy": square(y), "_gx": square(x)})
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    df = df.withColumn("_sy", F.explode(steps)).withColumn("_sx", F.explode(steps))
    return df.withColumns({"_gy": square(y) + F.col("_sy"), "_gx": square(x) + F.col("_sx")}).drop("_sy", "_sx")


def apart(centres: DataFrame, min_dist: float) -> DataFrame:
    """Of (img, c, cy, cx, votes, y, x), in falling order of votes, then by cy and cx, each that is not nearer than
    min_dist to one chosen before.

    In rounds: what no undecided centre goes before is chosen, and what is near to it goes. Peaks aren't adjacent, so the
    pairs of near ones grow with the peaks and min_dist only.
    """
    if min_dist <= 0:
        return centres
    key = ["cy", "cx"]
    left = centres = settled(centres)
    a = _around(left, "y", "x", min_dist, True)
    b = _around(left, "y", "x", min_dist, False).select(*_PLANE, "_gy", "_gx", F.col("cy").alias("hy"), F.col("cx").alias("hx"), F.col("votes").alias("_hv"), F.col("y").alias("_y"), F.col("x").alias("_x"))
    dy, dx = F.col("y") - F.col("_y"), F.col("x") - F.col("_x")
    first = F.struct(-F.col("_hv"), "hy", "hx") < F.struct(-F.col("votes"), "cy", "cx")
    near = settled(a.join(b, [*_PLANE, "_gy", "_gx"]).where(first & (dy * dy + dx * dx < min_dist * min_dist)).select(*_PLANE, "cy", "cx", "hy", "hx"))
    out = None
    left = left.select(*_PLANE, *key)
    while not near.isEmpty():
        chosen = settled(left.join(near, [*_PLANE, *key], "left_anti"))
        gone = near.join(chosen.withColumnsRenamed({"cy": "hy", "cx": "hx"}), [*_PLANE, "hy", "hx"], "left_semi").select(*_PLANE, *key).distinct()
        out = chosen if out is None else out.union(chosen)
        left = settled(left.join(chosen, [*_PLANE, *key], "left_anti").join(gone, [*_PLANE, *key], "left_anti"))
        near = settled(near.join(left, [*_PLANE, *key], "left_semi").join(left.withColumnsRenamed({"cy": "hy", "cx": "hx"}), [*_PLANE, "hy", "hx"], "left_semi"))
    out = left if out is None else out.union(left)
    return centres.join(out, [*_PLANE, *key], "left_semi")


def hough_circles(planes: DataFrame, dp: float = 1.0, min_dist: float = 1.0, canny_high: float = 100.0, threshold: int = 100, min_radius: int = 1, max_radius: int = 0, edges: DataFrame | None = None) -> DataFrame:
    """Circles (img, c, x, y, radius, votes, support) of 8-bit planes.

    Edges are those of canny with canny_high and half of it, unless given. A centre lies half a cell beyond its cell's
    number, as users of this method expect. Its radius, in whole pixels, is that with the most edge pixels (support) for
    its length, the smaller of equal ones; a centre without such pixels is none. max_radius 0 stands for the longest side
    of any plane.
    """
    if dp <= 0 or min_radius < 0:
        raise ValueError("dp is over 0 and a radius not under it")
    low = max(1, min_radius)
    if max_radius <= 0:
        max_radius = planes.agg(F.max(F.greatest("rows", "cols"))).first()[0] or low
    if max_radius < low:
        raise ValueError("the greatest radius is under the smallest")
    found = settled(edge_gradients(planes, canny(planes, canny_high / 2, canny_high) if edges is None else edges))
    tops = peaks(circle_votes(found, float(dp), low, max_radius), threshold)
    centres = settled(apart(tops.withColumns({"y": (F.col("cy") + 0.5) * float(dp), "x": (F.col("cx") + 0.5) * float(dp)}), min_dist))
    side = max_radius + 1.0
    points = _around(found.select(*_PLANE, F.col("y").alias("_y"), F.col("x").alias("_x")), "_y", "_x", side, False)
    met = _around(centres, "y", "x", side, True).join(points, [*_PLANE, "_gy", "_gx"])
    dy, dx = F.col("_y") - F.col("y"), F.col("_x") - F.col("x")
    met = met.select(*_PLANE, "y", "x", "votes", F.floor(F.sqrt(dy * dy + dx * dx) + 0.5).cast("int").alias("radius")).where(F.col("radius").between(low, max_radius))
    rings = met.groupBy(*_PLANE, "y", "x", "votes", "radius").agg(F.count(F.lit(1)).alias("support"))
    best = rings.groupBy(*_PLANE, "y", "x", "votes").agg(F.max(F.struct((F.col("support") / F.col("radius")).alias("_s"), (-F.col("radius")).alias("_r"), "support")).alias("_b"))
    return best.select(*_PLANE, "x", "y", (-F.col("_b._r")).alias("radius"), "votes", "_b.support")
