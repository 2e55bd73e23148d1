"""Registered queries of geometry, linear algebra, cameras, drawing and the operators that work image by image."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import arithmetic as A
from gridloom.operators import calibration as C
from gridloom.operators import colormaps as M
from gridloom.operators import consensus as O
from gridloom.operators import drawing as W
from gridloom.operators import geometry as G
from gridloom.operators import kernels as K
from gridloom.operators import linear as N
from gridloom.operators import resampling as S
from gridloom.operators import systems as Y
from gridloom.functions import numeric as V
from gridloom.plans import fixtures as X
from gridloom.plans.fixtures import BINARY, COLOR, EIGHT, POLYGONS, REAL, binary, color, eight, pixels, pixels_sql, polygons, real, shift_sql, shifted
from gridloom.sources import images as I
from gridloom.streaming import tracking as T

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_POLY = f"(SELECT set_id, pos, CAST(pos AS DOUBLE) AS x, y FROM ({POLYGONS}))"
_EDGES = f"(SELECT set_id, pos, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS v FROM {_POLY} WINDOW w AS (PARTITION BY set_id ORDER BY pos))"
_CAMERA = np.array([[6.0, 0, 3.5], [0, 5.5, 3.25], [0, 0, 1]])
_BEND = [0.05, -0.01, 0.002, -0.001]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select([(F.round(f.name, places) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def of_sets(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: rounded(op(polygons(spark, d)))
    if sql:
        SQL[name] = sql


def of_planes(name: str, load: Callable, op: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: rounded(op(load(spark, d)))


of_sets("arc_length_closed", lambda p: G.arc_length(p, True), f"SELECT set_id, {r6('sum(sqrt((u - x) * (u - x) + (v - y) * (v - y)))')} AS length FROM {_EDGES} GROUP BY set_id")
of_sets("arc_length_open", lambda p: G.arc_length(p, False), f"SELECT set_id, {r6('coalesce(sum(sqrt((u - x) * (u - x) + (v - y) * (v - y))), 0)')} AS length FROM (SELECT set_id, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM {_POLY} WINDOW w AS (PARTITION BY set_id ORDER BY pos)) GROUP BY set_id")
of_sets("contour_area", G.contour_area, f"SELECT set_id, {r6('CASE WHEN count(*) < 3 THEN 0 ELSE abs(sum(x * v - u * y)) / 2 END')} AS area FROM {_EDGES} GROUP BY set_id")
of_sets("bounding_rect", G.bounding_rect, f"SELECT set_id, CAST(floor(min(x)) AS BIGINT) AS x, CAST(floor(min(y)) AS BIGINT) AS y, CAST(floor(max(x)) - floor(min(x)) + 1 AS BIGINT) AS width, CAST(floor(max(y)) - floor(min(y)) + 1 AS BIGINT) AS height FROM {_POLY} GROUP BY set_id")
of_sets("is_contour_convex", G.is_contour_convex, f"SELECT set_id, min(t) > 0 OR max(t) < 0 AS convex FROM (SELECT set_id, dx * coalesce(lead(dy) OVER w, first_value(dy) OVER w) - dy * coalesce(lead(dx) OVER w, first_value(dx) OVER w) AS t FROM (SELECT set_id, pos, u - x AS dx, v - y AS dy FROM {_EDGES}) WINDOW w AS (PARTITION BY set_id ORDER BY pos)) GROUP BY set_id")
_DIST = "(SELECT set_id, y, v, x, u, CASE WHEN s = 0 THEN 0 ELSE greatest(0, least(1, ((5 - x) * (u - x) + (50 - y) * (v - y)) / s)) END AS t FROM (SELECT *, (u - x) * (u - x) + (v - y) * (v - y) AS s FROM " + _EDGES + "))"
of_sets("point_polygon_test", lambda p: G.point_polygon_test(p, (5.0, 50.0), True), f"SELECT set_id, {r6('CASE WHEN d = 0 THEN 0 WHEN n % 2 = 1 THEN sqrt(d) ELSE -sqrt(d) END')} AS result FROM (SELECT set_id, min((x + t * (u - x) - 5) * (x + t * (u - x) - 5) + (y + t * (v - y) - 50) * (y + t * (v - y) - 50)) AS d, sum(CASE WHEN (y > 50) <> (v > 50) AND 5 < x + (50 - y) * (u - x) / (v - y) THEN 1 ELSE 0 END) AS n FROM {_DIST} GROUP BY set_id)")
of_sets("fit_line", G.fit_line, f"SELECT set_id, {r6('CASE WHEN cos(t) < 0 THEN -cos(t) ELSE cos(t) END')} AS vx, {r6('CASE WHEN cos(t) < 0 THEN -sin(t) ELSE sin(t) END')} AS vy, {r6('x0')} AS x0, {r6('y0')} AS y0 FROM (SELECT set_id, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS t, avg(x) AS x0, avg(y) AS y0 FROM {_POLY} GROUP BY set_id)")
QUERIES["clip_line"] = lambda spark, d: rounded(G.clip_line(G.edges(polygons(spark, d)).select("set_id", F.col("pos").cast("long").alias("pos"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("u").alias("x1"), F.col("v").alias("y1")), 20, 60)).select("set_id", "pos", "visible", "cx0", "cy0", "cx1", "cy1")
_LOW = "greatest(0, CASE WHEN d1 < 0 THEN q1 / d1 END, CASE WHEN d2 < 0 THEN q2 / d2 END, CASE WHEN d3 < 0 THEN q3 / d3 END, CASE WHEN d4 < 0 THEN q4 / d4 END)"
_HIGH = _LOW.replace("greatest(0", "least(1").replace("< 0", "> 0")
_SEEN = f"NOT ((d1 = 0 AND (q1 < 0 OR q2 < 0)) OR (d3 = 0 AND (q3 < 0 OR q4 < 0))) AND {_LOW} <= {_HIGH}"
SQL["clip_line"] = f"SELECT set_id, CAST(pos AS BIGINT) AS pos, visible, {', '.join(f'CASE WHEN visible THEN {r6(v)} END AS {k}' for k, v in (('cx0', 'q1 - low * d1'), ('cy0', 'q3 - low * d3'), ('cx1', 'q1 - high * d1'), ('cy1', 'q3 - high * d3')))} FROM (SELECT *, {_SEEN} AS visible, {_LOW} AS low, {_HIGH} AS high FROM (SELECT set_id, pos, -(u - x) AS d1, x AS q1, u - x AS d2, 19 - x AS q2, -(v - y) AS d3, y AS q3, v - y AS d4, 59 - y AS q4 FROM {_EDGES}))"
# x grows along a set, so a point is on the lower (upper) hull if it turns left (right) from the steepest (flattest) point
# before it to the flattest (steepest) one after it; turns up to `least` are straight
_LEAST = f"(SELECT set_id, 1e-14 * (max(abs(x)) * (max(y) - min(y)) + max(abs(y)) * (max(x) - min(x))) AS least FROM {_POLY} GROUP BY set_id)"
_SLOPES = f"(SELECT a.set_id, a.pos, a.x, a.y, {', '.join(f'{pick}([b.x, b.y], (b.y - a.y) / (b.x - a.x)) FILTER (WHERE b.pos {side} a.pos) AS {name}' for pick, side, name in (('arg_min', '<', 'f0'), ('arg_max', '<', 'f1'), ('arg_min', '>', 't0'), ('arg_max', '>', 't1')))} FROM {_POLY} a LEFT JOIN {_POLY} b ON a.set_id = b.set_id AND a.pos <> b.pos GROUP BY 1, 2, 3, 4)"
_TURN = lambda f, t: f"(x - {f}[1]) * ({t}[2] - {f}[2]) - (y - {f}[2]) * ({t}[1] - {f}[1])"
_HULL = f"(SELECT set_id, pos, x, y, 0 AS side, pos AS ord FROM {_SLOPES} JOIN {_LEAST} USING (set_id) WHERE f1 IS NULL OR t0 IS NULL OR {_TURN('f1', 't0')} > least UNION ALL SELECT set_id, pos, x, y, 1, -pos FROM {_SLOPES} JOIN {_LEAST} USING (set_id) WHERE -({_TURN('f0', 't1')}) > least)"
of_sets("convex_hull", G.convex_hull, f"SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY side, ord) - 1 AS INTEGER) AS place, CAST(pos - 1 AS INTEGER) AS index, {r6('x')} AS x, {r6('y')} AS y FROM {_HULL}")
_GAPS = f"(SELECT *, lead(pos) OVER w AS np, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {_HULL} WINDOW w AS (PARTITION BY set_id ORDER BY pos))"
_DEPTHS = f"(SELECT h.set_id, h.pos AS a, h.np AS b, p.pos AS far, sqrt((nx - h.x) * (nx - h.x) + (ny - h.y) * (ny - h.y)) AS size, abs((nx - h.x) * (p.y - h.y) - (ny - h.y) * (p.x - h.x)) AS d FROM {_GAPS} h JOIN {_POLY} p ON p.set_id = h.set_id AND p.pos > h.pos AND p.pos < h.np)"
_MOST = f"(SELECT *, max(d) OVER (PARTITION BY set_id, a, b) AS most FROM {_DEPTHS} JOIN {_LEAST} USING (set_id))"
of_sets("convexity_defects", G.convexity_defects, f"SELECT set_id, CAST(a - 1 AS INTEGER) AS start, CAST(b - 1 AS INTEGER) AS \"end\", CAST(min(far) - 1 AS INTEGER) AS far, CAST(round_even(any_value(most / size * 256), 0) AS INTEGER) AS depth FROM {_MOST} WHERE most > least AND d >= most - least GROUP BY set_id, a, b")
# every hull edge's turn, and the hull's extent along and across it; the angle goes into [-90, 0) by quarter turns
_TURNS = f"(SELECT set_id, atan2(coalesce(lead(y) OVER w, first_value(y) OVER w) - y, coalesce(lead(x) OVER w, first_value(x) OVER w) - x) AS t, side, ord FROM {_HULL} WINDOW w AS (PARTITION BY set_id ORDER BY side, ord))"
_EXTENTS = f"(SELECT e.set_id, e.side, e.ord, t, min(x * cos(t) + y * sin(t)) AS u0, max(x * cos(t) + y * sin(t)) AS u1, min(y * cos(t) - x * sin(t)) AS v0, max(y * cos(t) - x * sin(t)) AS v1 FROM {_TURNS} e JOIN {_HULL} h USING (set_id) GROUP BY 1, 2, 3, 4)"
# the first edge of those with the least area; a triangle's three rectangles are equal
_BEST = f"(SELECT set_id, unnest(arg_min(struct_pack(t, u0, u1, v0, v1), (side, ord))) FROM (SELECT *, (u1 - u0) * (v1 - v0) AS area, min(area) OVER (PARTITION BY set_id) AS low FROM {_EXTENTS} JOIN {_LEAST} USING (set_id)) WHERE area <= low * (1 + 1e-9) + least GROUP BY set_id)"
of_sets("min_area_rect", G.min_area_rect, f"SELECT set_id, {r6('(u0 + u1) / 2 * cos(t) - (v0 + v1) / 2 * sin(t)')} AS x, {r6('(u0 + u1) / 2 * sin(t) + (v0 + v1) / 2 * cos(t)')} AS y, {r6('CASE WHEN q % 2 = 0 THEN u1 - u0 ELSE v1 - v0 END')} AS width, {r6('CASE WHEN q % 2 = 0 THEN v1 - v0 ELSE u1 - u0 END')} AS height, {r6('degrees(t) - 90 * q')} AS angle FROM (SELECT *, CAST(floor(degrees(t) / 90) + 1 AS BIGINT) AS q FROM {_BEST})")
of_sets("min_enclosing_circle", G.min_enclosing_circle)
of_sets("min_enclosing_triangle", G.min_enclosing_triangle)
of_sets("fit_ellipse", lambda p: G.fit_ellipse(_five(p)))
of_sets("fit_ellipse_direct", lambda p: G.fit_ellipse(_five(p), True))
of_sets("fit_ellipse_ams", lambda p: G.fit_ellipse_ams(_five(p)))
of_sets("approx_poly_dp", lambda p: G.approx_poly_dp(p, 10.0, True))
of_sets("approx_poly_n", lambda p: G.approx_poly_n(p, 5))


def _five(points: DataFrame) -> DataFrame:
    """Sets of five points or more."""
    return points.join(points.groupBy("set_id").count().where("count >= 5").select("set_id"), "set_id", "left_semi")


def _strong(planes: DataFrame) -> DataFrame:
    """Matrices with 3 added on the diagonal, which makes them well conditioned."""
    from gridloom.functions.planes import let
    from gridloom.operators.common import changed

    return changed(planes, let(F.col("data"), lambda d: F.transform(d, lambda v, i: F.when(i % 9 == 0, v + 3).otherwise(v))))


def _decomposed(planes: DataFrame) -> DataFrame:
    """What the eigenvalues and vectors of a symmetric part must satisfy: their sum, sum of squares, and scalar products."""
    value, vector = F.col("values"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("vectors", k * 8 + 1, F.lit(8)))
    product = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    found = K.eigen(planes).withColumn("vector", vector)
    grid = F.flatten(F.transform("vector", lambda p, i: F.transform("vector", lambda q, j: F.when(F.abs(product(p, q) - F.when(i == j, 1.0).otherwise(0.0)) < 1e-9, 1).otherwise(0))))
    falling = F.forall(F.sequence(F.lit(1), F.lit(7)), lambda k: F.get(value, k - 1) >= F.get(value, k))
    return rounded(found.select("img", "c", F.aggregate(value, F.lit(0.0), lambda s, v: s + v).alias("trace"), F.aggregate(value, F.lit(0.0), lambda s, v: s + v * v).alias("squares"), F.aggregate(grid, F.lit(0), lambda s, v: s + v).alias("orthonormal"), falling.alias("falling")))


# linear algebra
_MAT = f"({REAL})"
QUERIES["gemm"] = lambda spark, d: pixels(N.gemm(real(spark, d), shifted(real(spark, d)), 2.0, shifted(real(spark, d), 2), 0.5))
SQL["gemm"] = pixels_sql(f"SELECT p.img, 0 AS c, p.y, p.x, 2 * p.v + 0.5 * s.v AS v FROM (SELECT a.img, a.y, b.x, sum(a.v * b.v) AS v FROM ({REAL}) a JOIN ({shift_sql(REAL)}) b ON a.img = b.img AND a.x = b.y GROUP BY 1, 2, 3) p JOIN ({shift_sql(REAL, 2)}) s ON s.img = p.img AND s.y = p.y AND s.x = p.x")
QUERIES["optimal_dft_size"] = lambda spark, d: N.optimal_dft_sizes(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n")))
SQL["optimal_dft_size"] = "SELECT n, min(s) AS size FROM (SELECT o_orderkey AS n FROM orders) JOIN (SELECT CAST(pow(2, a) * pow(3, b) * pow(5, c) AS BIGINT) AS s FROM range(0, 26) t(a) CROSS JOIN range(0, 16) u(b) CROSS JOIN range(0, 11) v(c) WHERE pow(2, a) * pow(3, b) * pow(5, c) < 3e7) ON s >= n GROUP BY n, rowid".replace(", rowid", "")
QUERIES["dft"] = lambda spark, d: pixels(N.dft(real(spark, d)))
SQL["dft"] = pixels_sql(f"SELECT s.img, 0 AS c, j AS y, i AS x, sum(s.v * cos(2 * pi() * (j * s.y + i * s.x) / 8)) AS v FROM {_MAT} s CROSS JOIN range(0, 8) a(j) CROSS JOIN range(0, 8) b(i) GROUP BY s.img, j, i")
QUERIES["dft_imaginary"] = lambda spark, d: pixels(N.dft(real(spark, d), imaginary=True))
SQL["dft_imaginary"] = SQL["dft"].replace("sum(s.v * cos(", "sum(-s.v * sin(")
QUERIES["determinant"] = lambda spark, d: rounded(K.determinant(I.roi(real(spark, d), 1, 2, 3, 3)))
_CELL = lambda y, x: f"max(v) FILTER (WHERE y = {y + 1} AND x = {x + 2})"
SQL["determinant"] = f"SELECT img, CAST(c AS INTEGER) AS c, {r6(' + '.join(f'{_CELL(0, a)} * ({_CELL(1, b)} * {_CELL(2, c)} - {_CELL(1, c)} * {_CELL(2, b)})' for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1))))} AS determinant FROM {_MAT} GROUP BY img, c"
# matrices that are easy to check: the inverse times the matrix is one, the solution put in gives the right side
QUERIES["invert"] = lambda spark, d: pixels(N.gemm(Y.invert(_strong(real(spark, d))).drop("ok"), _strong(real(spark, d))))
SQL["invert"] = pixels_sql(f"SELECT img, c, y, x, CASE WHEN y = x THEN 1.0 ELSE 0.0 END AS v FROM {_MAT}")
QUERIES["solve"] = lambda spark, d: pixels(N.gemm(_strong(real(spark, d)), Y.solve(_strong(real(spark, d)), shifted(real(spark, d))).drop("ok")))
SQL["solve"] = pixels_sql(f"SELECT a.img, a.c, b.y, b.x, b.v FROM (SELECT DISTINCT img, c FROM {_MAT}) a JOIN ({shift_sql(REAL)}) b ON a.img = b.img")


def _bonded(planes: DataFrame) -> DataFrame:
    """Symmetric matrices that are well conditioned: the sum of a strong one and its transpose."""
    from gridloom.operators.layout import transpose

    return A.add(_strong(planes), transpose(_strong(planes)), depth=V.F64)


def _marred(planes: DataFrame) -> DataFrame:
    """Of every four images: a positive definite one, one that isn't symmetric, one without a last row and column, a negative one."""
    both = _bonded(planes).select("img", "c", F.col("data").alias("_s"))
    kind, edge = F.pmod("img", F.lit(4)), lambda i: (i >= 56) | (i % 8 == 7)
    data = F.when(kind == 1, F.col("data")).when(kind == 2, F.transform("_s", lambda v, i: F.when(edge(i), 0.0).otherwise(v))).when(kind == 3, F.transform("_s", lambda v: -v)).otherwise(F.col("_s"))
    return _strong(planes).join(both, ["img", "c"]).select("img", "c", "rows", "cols", data.alias("data"))


_METHODS = {"lu": Y.LU, "cholesky": Y.CHOLESKY, "qr": Y.QR}
for _name, _method in _METHODS.items():
    QUERIES[f"invert_{_name}"] = lambda spark, d, m=_method: pixels(N.gemm(Y.invert(_bonded(real(spark, d)), m).drop("ok"), _bonded(real(spark, d))))
    SQL[f"invert_{_name}"] = SQL["invert"]
    QUERIES[f"solve_{_name}"] = lambda spark, d, m=_method: pixels(N.gemm(_bonded(real(spark, d)), Y.solve(_bonded(real(spark, d)), shifted(real(spark, d)), m).drop("ok")))
    SQL[f"solve_{_name}"] = SQL["solve"]
    QUERIES[f"decomposes_{_name}"] = lambda spark, d, m=_method: Y.invert(_marred(real(spark, d)), m).select("img", "ok")
    SQL[f"decomposes_{_name}"] = f"SELECT DISTINCT img, {'img % 4 = 0' if _name == 'cholesky' else 'img % 4 <> 2'} AS ok FROM {_MAT}"
# eight equations for five unknowns: what an answer is the right side of is found again
QUERIES["solve_tall"] = lambda spark, d: pixels(Y.solve(_tall(real(spark, d)), N.gemm(_tall(real(spark, d)), I.roi(shifted(real(spark, d)), 0, 0, 5, 3))).drop("ok"))
SQL["solve_tall"] = pixels_sql(f"SELECT b.img, b.c, b.y, b.x, b.v FROM ({shift_sql(REAL)}) b JOIN (SELECT DISTINCT img FROM {_MAT}) a ON a.img = b.img WHERE b.y < 5 AND b.x < 3")


def _tall(planes: DataFrame) -> DataFrame:
    return I.roi(_strong(planes), 0, 0, 8, 5)


QUERIES["eigen"] = lambda spark, d: _decomposed(real(spark, d))
SQL["eigen"] = f"SELECT CAST(img AS BIGINT) AS img, 0 AS c, {r6('sum(CASE WHEN y = x THEN v ELSE 0 END)')} AS trace, {r6('sum(w * w)')} AS squares, 64 AS orthonormal, true AS falling FROM (SELECT a.img, a.y, a.x, a.v, (a.v + b.v) / 2 AS w FROM {_MAT} a JOIN {_MAT} b ON a.img = b.img AND a.y = b.x AND a.x = b.y) GROUP BY img"
QUERIES["kmeans"] = lambda spark, d: rounded(N.kmeans(spark.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) = 64").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 4, 5).select("label", F.transform("center", lambda v: F.round(v, 5) + 0.0).alias("center")))

# image by image
of_planes("connected_components", binary, lambda p: X.to_pixels(K.connected_components(p)))
_REACH = f"reach AS (SELECT img, y, x, y * 8 + x AS k FROM ({BINARY}) WHERE v <> 0 UNION SELECT p.img, p.y, p.x, r.k FROM reach r JOIN ({BINARY}) p ON p.img = r.img AND p.v <> 0 AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1)"
_LABELS = f"(SELECT b.img, b.c, b.y, b.x, CASE WHEN b.v = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY b.img, b.v ORDER BY f.k) END AS l FROM ({BINARY}) b LEFT JOIN (SELECT img, y, x, min(k) AS k FROM reach GROUP BY img, y, x) f ON f.img = b.img AND f.y = b.y AND f.x = b.x)"
SQL["connected_components"] = f"WITH RECURSIVE {_REACH} " + pixels_sql(f"SELECT img, c, y, x, l AS v FROM {_LABELS}")
of_planes("component_stats", binary, K.component_stats)
SQL["component_stats"] = f"WITH RECURSIVE {_REACH} SELECT CAST(img AS BIGINT) AS img, CAST(c AS INTEGER) AS c, CAST(l AS INTEGER) AS label, CAST(min(x) AS INTEGER) AS \"left\", CAST(min(y) AS INTEGER) AS top, CAST(max(x) - min(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height, CAST(count(*) AS INTEGER) AS area, {r6('avg(x)')} AS center_x, {r6('avg(y)')} AS center_y FROM {_LABELS} GROUP BY img, c, l"
QUERIES["distance_transform"] = lambda spark, d: pixels(K.distance_transform(binary(spark, d)))
# without obstacles the chamfer distance is that of the free steps: diagonals as far as both sides go, then straight on
SQL["distance_transform"] = pixels_sql(f"SELECT a.img, a.c, a.y, a.x, coalesce(min(1.3693 * least(abs(a.y - z.y), abs(a.x - z.x)) + 0.955 * abs(abs(a.y - z.y) - abs(a.x - z.x))), 1e30) AS v FROM ({BINARY}) a LEFT JOIN (SELECT * FROM ({BINARY}) WHERE v = 0) z ON a.img = z.img GROUP BY 1, 2, 3, 4")
QUERIES["distance_transform_l1"] = lambda spark, d: pixels(K.distance_transform(binary(spark, d), "l1"))
SQL["distance_transform_l1"] = pixels_sql(f"SELECT a.img, a.c, a.y, a.x, coalesce(min(abs(a.y - z.y) + abs(a.x - z.x)), 1e30) AS v FROM ({BINARY}) a LEFT JOIN (SELECT * FROM ({BINARY}) WHERE v = 0) z ON a.img = z.img GROUP BY 1, 2, 3, 4")
QUERIES["distance_transform_exact"] = lambda spark, d: pixels(K.distance_transform_with_labels(binary(spark, d)).drop("labels"))
SQL["distance_transform_exact"] = pixels_sql(f"SELECT a.img, a.c, a.y, a.x, coalesce(min(sqrt((a.y - z.y) * (a.y - z.y) + (a.x - z.x) * (a.x - z.x))), 1e30) AS v FROM ({BINARY}) a LEFT JOIN (SELECT * FROM ({BINARY}) WHERE v = 0) z ON a.img = z.img GROUP BY 1, 2, 3, 4")
of_planes("flood_fill", eight, lambda p: X.to_pixels(K.flood_fill(p, (3, 3), 255.0, 20, 20)))
SQL["flood_fill"] = f"WITH RECURSIVE e AS (SELECT p.*, s.v AS base FROM ({EIGHT}) p JOIN ({EIGHT}) s ON s.img = p.img AND s.y = 3 AND s.x = 3), reach AS (SELECT img, y, x FROM e WHERE y = 3 AND x = 3 UNION SELECT e.img, e.y, e.x FROM reach r JOIN e ON e.img = r.img AND abs(e.v - e.base) <= 20 AND abs(e.y - r.y) + abs(e.x - r.x) = 1) " + pixels_sql("SELECT e.img, e.c, e.y, e.x, CASE WHEN r.img IS NULL THEN e.v ELSE 255.0 END AS v FROM e LEFT JOIN reach r ON r.img = e.img AND r.y = e.y AND r.x = e.x")
of_planes("watershed", eight, lambda p: X.to_pixels(K.watershed(p, _markers(p))))
QUERIES["find_contours_link_runs"] = lambda spark, d: K.find_contours_link_runs(binary(spark, d)).select("img", "contour", "next", "previous", "child", "parent", F.to_json("points").alias("points"))
QUERIES["find_contours"] = lambda spark, d: K.find_contours(binary(spark, d)).select("img", "contour", "next", "previous", "child", "parent", F.to_json("points").alias("points"))
of_planes("threshold_triangle", eight, lambda p: X.to_pixels(K.triangle_threshold(p, 255.0, 0)))
# seen from the longer tail (turned or not): the level that lies farthest from the line between the tail's end and the peak
_LEVELS = f"(SELECT img, c, CAST(v AS BIGINT) AS lev, count(*) AS n FROM ({EIGHT}) GROUP BY 1, 2, 3)"
_TAIL = f"(SELECT *, peak - lo < hi - peak AS turned FROM (SELECT img, c, greatest(0, min(lev) - 1) AS lo, least(255, max(lev) + 1) AS hi, max(n) AS top, arg_min(lev, (-n, lev)) AS peak FROM {_LEVELS} GROUP BY 1, 2))"
_STEPS = f"(SELECT *, CASE WHEN turned THEN 255 - hi ELSE lo END AS l, CASE WHEN turned THEN 255 - peak ELSE peak END AS p FROM {_TAIL})"
_FARTHEST = f"(SELECT s.img, s.c, s.turned, arg_min(j, (-(top * j + (l - p) * coalesce(n, 0)), j)) - 1 AS t FROM {_STEPS} s JOIN range(0, 256) r(j) ON j > l AND j <= p LEFT JOIN {_LEVELS} h ON h.img = s.img AND h.c = s.c AND h.lev = CASE WHEN turned THEN 255 - j ELSE j END GROUP BY 1, 2, 3)"
SQL["threshold_triangle"] = pixels_sql(f"SELECT q.img, q.c, q.y, q.x, CASE WHEN q.v > coalesce(CASE WHEN s.turned THEN 255 - t ELSE t END, CASE WHEN s.turned THEN 255 - l ELSE l END) THEN 255.0 ELSE 0.0 END AS v FROM ({EIGHT}) q JOIN {_STEPS} s USING (img, c) LEFT JOIN {_FARTHEST} f USING (img, c)")
of_planes("clahe", eight, lambda p: X.to_pixels(K.clahe(p, 2.0, (2, 2))))
of_planes("canny", eight, lambda p: X.to_pixels(K.canny(p, 100, 200)))
of_planes("good_features", eight, lambda p: K.good_features(p, 5, 0.1, 2.0))
of_planes("hough_lines", binary, lambda p: K.hough_lines(p, 1.0, math.pi / 18, 5))
of_planes("mean_shift", eight, lambda p: T.mean_shift_planes(p, (2, 2, 4, 4)))
of_planes("cam_shift", eight, lambda p: T.cam_shift_planes(p, (2, 2, 4, 4)))


def _markers(planes: DataFrame) -> DataFrame:
    from gridloom.functions.planes import grid
    from gridloom.operators.common import changed

    return changed(planes, grid(F.col("rows"), F.col("cols"), lambda y, x: F.when((y == 2) & (x == 2), 1.0).when((y == 5) & (x == 5), 2.0).otherwise(0.0)))


def drawn(name: str, op: Callable[[DataFrame], DataFrame], covered: str | None = None) -> None:
    """A query that draws with 99 on the 8-bit planes; `covered` is the SQL condition of the drawn pixels."""
    QUERIES[name] = lambda spark, d: pixels(op(eight(spark, d)))
    if covered:
        SQL[name] = pixels_sql(f"SELECT img, c, y, x, CASE WHEN {covered} THEN 99.0 ELSE v END AS v FROM ({EIGHT})")


drawn("draw_rectangle", lambda p: W.rectangle(p, (1, 2), (5, 6), [99]), "x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6 AND (x IN (1, 5) OR y IN (2, 6))")
drawn("draw_rectangle_filled", lambda p: W.rectangle(p, (1, 2), (5, 6), [99], -1), "x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6")
drawn("draw_circle_filled", lambda p: W.circle(p, (3, 4), 2, [99], -1), "(x - 3) * (x - 3) + (y - 4) * (y - 4) <= 4")
drawn("draw_line_diagonal", lambda p: W.line(p, (1, 1), (6, 6), [99]), "x = y AND x BETWEEN 1 AND 6")
drawn("draw_marker", lambda p: W.draw_marker(p, (3, 3), [99], size=8), "(x = 3 AND y BETWEEN 0 AND 6) OR (y = 3 AND x BETWEEN 0 AND 6)")
drawn("fill_poly", lambda p: W.fill_poly(p, [[(1, 1), (6, 1), (6, 5), (1, 5)]], [99]), "x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 5")
drawn("draw_circle", lambda p: W.circle(p, (3, 3), 3, [99]))
drawn("draw_line", lambda p: W.line(p, (0, 1), (7, 4), [99]), "y = 1 + round(3 * x / 7.0)")
drawn("draw_ellipse", lambda p: W.ellipse(p, (4, 4), (3, 2), 30, 0, 360, [99]))
drawn("draw_polylines", lambda p: W.polylines(p, [[(0, 0), (4, 2), (7, 7)]], True, [99]))
drawn("draw_arrow", lambda p: W.arrowed_line(p, (0, 0), (6, 5), [99], 0.3))
drawn("draw_contours", lambda p: W.draw_contours(p, [[(1, 1), (5, 1), (3, 6)]], -1, [99], -1))

# cameras: the points are the events' (number, value) over 100, ten units away
_R, _T = (0.1, -0.05, 0.2), (0.3, -0.2, 10.0)
QUERIES["project_points"] = lambda spark, d: rounded(C.project_points(_solid(spark, d), _R, _T, _CAMERA, _BEND).select("set_id", "pos", "u", "v"))


def _solid(spark, d):
    return polygons(spark, d).select("set_id", F.col("pos").cast("long").alias("pos"), (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"), F.lit(1.0).alias("z"))


_ROT = C.rodrigues(_R)
_FRAME = f"(SELECT set_id, pos, {', '.join(f'x * {float(_ROT[k][0])!r} + y * {float(_ROT[k][1])!r} + CAST({float(_ROT[k][2]) + _T[k]!r} AS DOUBLE) AS p{k}' for k in range(3))} FROM (SELECT set_id, pos, x / 100 AS x, y / 100 AS y FROM {_POLY}))"
_BENT = f"x * k + {2 * _BEND[2]!r} * x * y + {_BEND[3]!r} * (r + 2 * x * x) AS bx, y * k + {_BEND[2]!r} * (r + 2 * y * y) + {2 * _BEND[3]!r} * x * y AS b_y"
SQL["project_points"] = f"SELECT set_id, CAST(pos AS BIGINT) AS pos, {r6('bx * 6 + 3.5')} AS u, {r6('b_y * 5.5 + 3.25')} AS v FROM (SELECT set_id, pos, {_BENT} FROM (SELECT *, 1 + {_BEND[0]!r} * r + {_BEND[1]!r} * r * r AS k FROM (SELECT *, x * x + y * y AS r FROM (SELECT set_id, pos, p0 / p2 AS x, p1 / p2 AS y FROM {_FRAME}))))"
QUERIES["fisheye_project_points"] = lambda spark, d: rounded(C.fisheye_project_points(_solid(spark, d), _R, _T, _CAMERA, (0.01, 0.002, 0, 0)).select("set_id", "pos", "u", "v"))
_FISH = "CASE WHEN r = 0 THEN 1 ELSE atan(r) * (1 + 0.01 * pow(atan(r), 2) + 0.002 * pow(atan(r), 4)) / r END AS k"
SQL["fisheye_project_points"] = f"SELECT set_id, CAST(pos AS BIGINT) AS pos, {r6('x * k * 6 + 3.5')} AS u, {r6('y * k * 5.5 + 3.25')} AS v FROM (SELECT *, {_FISH} FROM (SELECT *, sqrt(x * x + y * y) AS r FROM (SELECT set_id, pos, p0 / p2 AS x, p1 / p2 AS y FROM {_FRAME})))"
QUERIES["undistort"] = lambda spark, d: pixels(C.undistort(eight(spark, d), _CAMERA, _BEND))
_LENS = f"(SELECT j, i, round_even((bx * 6 + 3.5) * 32, 0) / 32 AS u, round_even((b_y * 5.5 + 3.25) * 32, 0) / 32 AS w FROM (SELECT j, i, {_BENT} FROM (SELECT *, 1 + {_BEND[0]!r} * r + {_BEND[1]!r} * r * r AS k FROM (SELECT *, x * x + y * y AS r FROM (SELECT j, i, (i - 3.5::DOUBLE) / 6 AS x, (j - 3.25::DOUBLE) / 5.5 AS y FROM range(0, 8) a(j) CROSS JOIN range(0, 8) b(i))))))"
_NEAR = f"(SELECT *, floor(w) + b AS sy, floor(u) + a AS sx, (CASE b WHEN 0 THEN 1 - (w - floor(w)) ELSE w - floor(w) END) * (CASE a WHEN 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END) AS share FROM {_LENS} CROSS JOIN range(0, 2) s(b) CROSS JOIN range(0, 2) t(a))"
SQL["undistort"] = pixels_sql(f"SELECT g.img, g.c, n.j AS y, n.i AS x, floor(sum(coalesce(s.v, 0) * share) + 0.5) AS v FROM (SELECT DISTINCT img, c FROM ({EIGHT})) g CROSS JOIN {_NEAR} n LEFT JOIN ({EIGHT}) s ON s.img = g.img AND s.c = g.c AND s.y = n.sy AND s.x = n.sx GROUP BY 1, 2, 3, 4")
QUERIES["estimate_affine_2d"] = lambda spark, d: C.estimate_affine_2d(_pairs(spark, d), "all").select("set_id", F.posexplode("matrix").alias("i", "v")).select("set_id", "i", (F.round("v", 4) + 0.0).alias("v"))
QUERIES["find_homography"] = lambda spark, d: C.find_homography(_pairs(spark, d)).select("set_id", F.posexplode("matrix").alias("i", "v")).select("set_id", "i", (F.round("v", 3) + 0.0).alias("v"))


def _pairs(spark, d):
    return polygons(spark, d).withColumns({"u": F.col("x") * 2 - F.col("y") + 3, "v": F.col("x") + F.col("y") * 0.5 - 1})


# all pairs lie on one map, which the estimates must find
_MAP = "(VALUES (0, 2.0), (1, -1.0), (2, 3.0), (3, 1.0), (4, 0.5), (5, -1.0), (6, 0.0), (7, 0.0), (8, 1.0)) t(i, v)"
SQL["find_homography"] = f"SELECT set_id, CAST(i AS INTEGER) AS i, CAST(v AS DOUBLE) AS v FROM (SELECT DISTINCT set_id FROM {_POLY}) CROSS JOIN {_MAP}"
SQL["estimate_affine_2d"] = SQL["find_homography"] + " WHERE i < 6"

QUERIES["project_points_jacobian"] = lambda spark, d: C.project_jacobian(_solid(spark, d), _R, _T, _CAMERA, _BEND).select("set_id", "pos", F.posexplode(F.arrays_zip("du", "dv")).alias("k", "p")).select("set_id", "pos", "k", (F.round("p.du", 6) + 0.0).alias("du"), (F.round("p.dv", 6) + 0.0).alias("dv"))
# the rotation's derivatives by complex steps; the rest by the chain rule, the lens in terms of its radius
_h = 1e-30


def _stepped(k: int) -> np.ndarray:
    r = np.array(_R, complex)
    r[k] += 1j * _h
    t = np.sqrt((r * r).sum())
    x = np.array([[0, -r[2], r[1]], [r[2], 0, -r[0]], [-r[1], r[0], 0]])
    return (np.eye(3) + np.sin(t) / t * x + (1 - np.cos(t)) / (t * t) * (x @ x)).imag / _h


_SPUN = ", ".join(f"x * {float(m[i][0])!r}::DOUBLE + y * {float(m[i][1])!r}::DOUBLE + {float(m[i][2])!r}::DOUBLE AS d{k}{i}" for k, m in enumerate(map(_stepped, range(3))) for i in range(3))
_K1, _K2, _P1, _P2 = (f"{float(v)!r}::DOUBLE" for v in _BEND[:4])
_POSED = [(f"(d{k}0 - a * d{k}2) / p2", f"(d{k}1 - b * d{k}2) / p2") for k in range(3)] + [("1 / p2", "0"), ("0", "1 / p2"), ("-a / p2", "-b / p2")]
_BY_R = f"({_K1} + 2 * {_K2} * r)"
_ROW_U = [f"6 * (({_RX}) * ({dx}) + ({_RY}) * ({dy}))" for _RX, _RY in [(f"1 + {_K1} * r + {_K2} * r * r + 2 * a * a * {_BY_R} + 2 * {_P1} * b + 6 * {_P2} * a", f"2 * a * b * {_BY_R} + 2 * {_P1} * a + 2 * {_P2} * b")] for dx, dy in _POSED]
_ROW_V = [f"5.5 * (({_RX}) * ({dx}) + ({_RY}) * ({dy}))" for _RX, _RY in [(f"2 * a * b * {_BY_R} + 2 * {_P1} * a + 2 * {_P2} * b", f"1 + {_K1} * r + {_K2} * r * r + 2 * b * b * {_BY_R} + 6 * {_P1} * b + 2 * {_P2} * a")] for dx, dy in _POSED]
_K = f"(1 + {_K1} * r + {_K2} * r * r)"
_ROW_U += [f"a * {_K} + 2 * {_P1} * a * b + {_P2} * (r + 2 * a * a)", "0", "1", "0", "6 * a * r", "6 * a * r * r", "12 * a * b", "6 * (r + 2 * a * a)", "6 * a * r * r * r"]
_ROW_V += ["0", f"b * {_K} + {_P1} * (r + 2 * b * b) + 2 * {_P2} * a * b", "0", "1", "5.5 * b * r", "5.5 * b * r * r", "5.5 * (r + 2 * b * b)", "11 * a * b", "5.5 * b * r * r * r"]
SQL["project_points_jacobian"] = f"SELECT set_id, CAST(pos AS BIGINT) AS pos, CAST(k AS INTEGER) AS k, {r6('du')} AS du, {r6('dv')} AS dv FROM (SELECT set_id, pos, unnest(range(0, 15)) AS k, unnest([{', '.join(_ROW_U)}]) AS du, unnest([{', '.join(_ROW_V)}]) AS dv FROM (SELECT *, a * a + b * b AS r FROM (SELECT *, p0 / p2 AS a, p1 / p2 AS b, {_SPUN} FROM (SELECT f.*, q.x / 100 AS x, q.y / 100 AS y FROM {_FRAME} f JOIN {_POLY} q USING (set_id, pos)))))"

# robust estimates: three pairs of ten are far off, the others a little
_OFF = "pos % 10 IN (1, 4, 8)"
_ROUNDS = 60


def _rough(spark, d):
    small = (F.col("pos") * 7 % 5 - 2) * 0.2, (F.col("pos") * 3 % 7 - 3) * 0.1
    far = F.expr(_OFF)
    return polygons(spark, d).withColumns({"u": F.col("x") * 2 - F.col("y") + 3 + small[0] + F.when(far, 25 + F.col("pos") % 13 * 3).otherwise(0), "v": F.col("x") + F.col("y") * 0.5 - 1 + small[1] - F.when(far, 30 + F.col("pos") % 7 * 5).otherwise(0)})


def _agreed(estimate):
    return lambda spark, d: estimate(_rough(spark, d), "ransac", 3.0, _ROUNDS)[1].select("set_id", "idx", "inlier")


QUERIES["estimate_affine_2d_inliers"] = _agreed(O.affine)
QUERIES["find_homography_inliers"] = _agreed(partial(O.homography, refine=False))
QUERIES["estimate_affine_2d_ransac"] = lambda spark, d: O.affine(_rough(spark, d), "ransac", 3.0, _ROUNDS)[0].select("set_id", F.posexplode("model").alias("i", "v")).select("set_id", "i", (F.round("v", 5) + 0.0).alias("v"))

_CASTS = {3: "CAST({} AS DOUBLE)", 4: "CAST(CAST({} AS FLOAT) AS DOUBLE)"}


def _drawn_sql(members: int) -> str:
    """Tables pr (the pairs), sb (draws of each set size, one number of the stream after another) and hy (their points)."""
    real = ", ".join(f"{_CASTS[members].format(e)} AS {n}" for n, e in (("x", "pos"), ("y", "y"), ("u", "pos * 2.0::DOUBLE - y + 3 + (pos * 7 % 5 - 2) * 0.2::DOUBLE + CASE WHEN " + _OFF + " THEN 25 + pos % 13 * 3 ELSE 0 END"), ("v", "pos + y * 0.5::DOUBLE - 1 + (pos * 3 % 7 - 3) * 0.1::DOUBLE - CASE WHEN " + _OFF + " THEN 30 + pos % 7 * 5 ELSE 0 END")))
    once = "WHERE step = (SELECT min(step) FROM g o WHERE o.n = g.n AND list_sort(o.sub) = list_sort(g.sub))" if members == 3 else "WHERE true"
    points = " ".join(f"JOIN pr p{k} ON p{k}.set_id = s.set_id AND p{k}.idx = sub[{k + 1}]" for k in range(members))
    columns = ", ".join(f"p{k}.{c} AS {c}{k}" for k in range(members) for c in "xyuv")
    return f"""WITH RECURSIVE pr AS MATERIALIZED (SELECT set_id, pos - 1 AS idx, count(*) OVER (PARTITION BY set_id) AS n, {real} FROM ({POLYGONS})),
steps AS (SELECT DISTINCT n, 0 AS step, 18446744073709551615::UHUGEINT AS s, CAST([] AS BIGINT[]) AS sub FROM pr WHERE n > {members}
    UNION ALL SELECT n, step + 1, s, CASE WHEN len(sub) = {members} THEN [k] WHEN list_contains(sub, k) THEN sub ELSE list_append(sub, k) END
    FROM (SELECT n, step, s, sub, CAST(s % 4294967296 % n AS BIGINT) AS k FROM (SELECT n, step, sub, s % 4294967296 * 4164903690::UHUGEINT + (s >> 32) AS s FROM steps WHERE step < {(_ROUNDS + 20) * members + 60}))),
g AS MATERIALIZED (SELECT * FROM steps WHERE len(sub) = {members}),
sb AS MATERIALIZED (SELECT n, sub, row_number() OVER (PARTITION BY n ORDER BY step) - 1 AS draw FROM g {once}),
hy AS (SELECT s.set_id, s.n, draw, {columns} FROM (SELECT DISTINCT set_id, n FROM pr) s JOIN sb USING (n) {points})"""


def _won_sql(members: int, error: str) -> str:
    """Tables sc (agreeing pairs of each draw) and wn (each set's winner), after a table md of models."""
    spent = "draw" if members == 3 else "coalesce(sum(1) OVER (PARTITION BY set_id ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""sc AS MATERIALIZED (SELECT md.set_id, md.n, draw, count(*) FILTER (WHERE {error} < 3) AS agreed FROM md JOIN pr USING (set_id) GROUP BY md.set_id, md.n, draw),
sq AS (SELECT *, {spent} AS spent, coalesce(max(agreed) OVER (PARTITION BY set_id ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM sc),
ok AS (SELECT *, spent < least({_ROUNDS}, CASE WHEN top = 0 THEN {_ROUNDS} WHEN top = n THEN 1 ELSE greatest(1, round(ln(1 - 0.99::DOUBLE) / ln(1 - pow(top / n, {members})))) END) AS live FROM sq),
wn AS (SELECT set_id, arg_min(draw, (-agreed, draw)) AS draw FROM ok WHERE live AND agreed > 0 GROUP BY set_id)"""


def _det(a: str, b: str, c: str, x: str = "x", y: str = "y") -> str:
    return f"(({x}{b} - {x}{a}) * ({y}{c} - {y}{a}) - ({y}{b} - {y}{a}) * ({x}{c} - {x}{a}))"


# an affine map through three pairs by ratios of areas; a homography through four by the two frames they span
_D = _det("0", "1", "2")
_PLANE = {c: (f"(({c}1 - {c}0) * (y2 - y0) - ({c}2 - {c}0) * (y1 - y0)) / {_D}", f"(({c}2 - {c}0) * (x1 - x0) - ({c}1 - {c}0) * (x2 - x0)) / {_D}") for c in "uv"}
_AFFINE_MD = "md AS (SELECT *, u0 - a * x0 - b * y0 AS c, v0 - d * x0 - e * y0 AS f FROM (SELECT *, {} AS a, {} AS b, {} AS d, {} AS e FROM hy WHERE {} <> 0))".format(*_PLANE["u"], *_PLANE["v"], _D)
_AFFINE_ERROR = "sqrt(pow(a * x + b * y + c - u, 2) + pow(d * x + e * y + f - v, 2))"
_AREAS = {k: (_det(*t), _det(*t, "u", "v")) for k, t in enumerate((("3", "1", "2"), ("0", "3", "2"), ("0", "1", "3")))}
_FRAMES = ", ".join(f"{_AREAS[k][0]} AS l{k}, {_AREAS[k][1]} AS m{k}" for k in range(3))


def _homography_cell(r: int, c: int) -> str:
    p, q = (lambda k: (f"x{k}", f"y{k}", "1")), (lambda k: (f"u{k}", f"v{k}", "1"))
    terms = []
    for k, (i, j) in enumerate(((1, 2), (2, 0), (0, 1))):
        a, b = p(i), p(j)
        e, f = (c + 1) % 3, (c + 2) % 3
        terms.append(f"m{k} * {q(k)[r]} * l{i} * l{j} * ({a[e]} * {b[f]} - {a[f]} * {b[e]})")
    return " + ".join(terms)


_HOMOGRAPHY_MD = f"md AS (SELECT *, {', '.join(f'{_homography_cell(r, c)} AS h{r}{c}' for r in range(3) for c in range(3))} FROM (SELECT *, {_FRAMES} FROM hy WHERE abs({_D}) > 2.3e-16 AND {' AND '.join(f'abs({_AREAS[k][0]}) > 2.3e-16' for k in range(3))}))"
_HOMOGRAPHY_ERROR = "sqrt(pow((h00 * x + h01 * y + h02) / nullif(h20 * x + h21 * y + h22, 0) - u, 2) + pow((h10 * x + h11 * y + h12) / nullif(h20 * x + h21 * y + h22, 0) - v, 2))"
for _name, _members, _md, _error in (("estimate_affine_2d", 3, _AFFINE_MD, _AFFINE_ERROR), ("find_homography", 4, _HOMOGRAPHY_MD, _HOMOGRAPHY_ERROR)):
    _body = f"{_drawn_sql(_members)},\n{_md},\n{_won_sql(_members, _error)},\nmk AS (SELECT pr.*, coalesce({_error} < 3, false) AS inlier FROM pr LEFT JOIN (SELECT md.* FROM md JOIN wn USING (set_id, draw)) w ON w.set_id = pr.set_id)"
    SQL[f"{_name}_inliers"] = f"{_body}\nSELECT set_id, idx, inlier FROM mk"
    if _members == 3:
        _fit = f"(SELECT set_id, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x) AS sx, sum(y) AS sy, count(*) AS k, {', '.join(f'sum({p}{q}) AS {n}{q}' for q in 'uv' for n, p in (('x', 'x * '), ('y', 'y * '), ('s', '')))} FROM mk WHERE inlier GROUP BY set_id HAVING count(*) >= 3)"
        # centred sums, so that the two slopes are a system of two
        _slopes = ", ".join(f"((x{q} - sx * s{q} / k) * (yy - sy * sy / k) - (y{q} - sy * s{q} / k) * (xy - sx * sy / k)) / z AS a{q}, ((y{q} - sy * s{q} / k) * (xx - sx * sx / k) - (x{q} - sx * s{q} / k) * (xy - sx * sy / k)) / z AS b{q}" for q in "uv")
        _wide = f"SELECT set_id, unnest(range(0, 6)) AS i, unnest([au, bu, (su - au * sx - bu * sy) / k, av, bv, (sv - av * sx - bv * sy) / k]) AS v FROM (SELECT *, {_slopes} FROM (SELECT *, (xx - sx * sx / k) * (yy - sy * sy / k) - pow(xy - sx * sy / k, 2) AS z FROM {_fit}))"
        SQL[f"{_name}_ransac"] = f"{_body}\nSELECT set_id, CAST(i AS INTEGER) AS i, round(v, 5) + 0.0 AS v FROM ({_wide})"

# colour
_BGR = f"(SELECT img, y, x, max(v) FILTER (WHERE c = 0) AS b, max(v) FILTER (WHERE c = 1) AS g, max(v) FILTER (WHERE c = 2) AS r FROM ({COLOR}) GROUP BY img, y, x)"


def _rows_sql(values: list[str]) -> str:
    return pixels_sql(" UNION ALL ".join(f"SELECT img, {k} AS c, y, x, greatest(0, least(255, {v})) AS v FROM {_BGR}" for k, v in enumerate(values)))


QUERIES["cvt_color_xyz"] = lambda spark, d: pixels(A.to_xyz(color(spark, d)))
SQL["cvt_color_xyz"] = _rows_sql([f"floor((b * {w[0]} + g * {w[1]} + r * {w[2]} + 2048) / 4096)" for w in ((739, 1465, 1689), (296, 2929, 871), (3892, 488, 79))])
_Y = "floor((b * 1868 + g * 9617 + r * 4899 + 8192) / 16384)"
for _kind, _parts in (("ycrcb", (("r", 11682), ("b", 9241))), ("yuv", (("b", 8061), ("r", 14369)))):
    QUERIES[f"cvt_color_{_kind}"] = lambda spark, d, k=_kind: pixels(A.to_luma_chroma(color(spark, d), k))
    SQL[f"cvt_color_{_kind}"] = _rows_sql([_Y, *[f"floor((({c} - {_Y}) * {w} + {128 * 2**14} + 8192) / 16384)" for c, w in _parts]])
#: Red, green and blue of each map as formulas of a sample's place x, and the number of samples.
_COLORS = {
    "autumn": ("1", "x", "0", 64),
    "bone": ("CASE WHEN x < 0.75 THEN 7 * x / 8 ELSE (11 * x - 3) / 8 END", "CASE WHEN x < 0.375 THEN 7 * x / 8 WHEN x < 0.75 THEN (29 * x - 3) / 24 ELSE (7 * x + 1) / 8 END", "CASE WHEN x < 0.375 THEN 29 * x / 24 ELSE (7 * x + 1) / 8 END", 64),
    "cool": ("x", "1 - x", "1", 64),
    "hot": ("least(1, x * 2.5)", "greatest(0, least(1, x * 2.5 - 1))", "greatest(0, x * 5 - 4)", 64),
    "hsv": ("greatest(0, least(1, abs(6 * x - 3) - 1))", "greatest(0, least(1, 2 - abs(6 * x - 2)))", "greatest(0, least(1, 2 - abs(6 * x - 4)))", 64),
    "ocean": ("greatest(0, 3 * x - 2)", "greatest(0, 1.5 * x - 0.5)", "x", 64),
    "pink": ("sqrt(CASE WHEN x < 0.375 THEN 14 * x / 9 ELSE (2 * x + 1) / 3 END)", "sqrt(CASE WHEN x < 0.375 THEN 2 * x / 3 WHEN x < 0.75 THEN (14 * x - 3) / 9 ELSE (2 * x + 1) / 3 END)", "sqrt(CASE WHEN x < 0.75 THEN 2 * x / 3 ELSE 2 * x - 1 END)", 64),
    "rainbow": ("CASE WHEN x < 0.8 THEN greatest(0, least(1, 3 - 5 * x)) ELSE (10 * x - 8) / 3 END", "greatest(0, least(1, 2.5 * x, 4 - 5 * x))", "greatest(0, least(1, 5 * x - 3))", 64),
    "spring": ("1", "x", "1 - x", 64),
    "summer": ("x", "(1 + x) / 2", "0.4", 64),
    "winter": ("0", "x", "1 - x / 2", 11),
}


def _color_map_sql(name: str) -> str:
    """(c, k, e): the entries, by formulas; in single precision between samples, halves to the even entry."""
    if name == "jet":
        blue, green, red = (
            "CASE WHEN k < 96 THEN least(255, 128 + 4 * k) WHEN k = 159 THEN 1 WHEN k < 159 THEN 638 - 4 * k ELSE 0 END",
            "CASE WHEN k < 128 THEN least(255, greatest(0, 4 * k - 128)) WHEN k < 160 THEN 255 ELSE greatest(0, 892 - 4 * k) END",
            "CASE WHEN k < 96 THEN 0 WHEN k < 160 THEN 4 * k - 382 ELSE least(255, 1148 - 4 * k) END",
        )
        return " UNION ALL ".join(f"SELECT {c} AS c, k, {e} AS e FROM range(0, 256) t(k)" for c, e in enumerate((blue, green, red)))
    *rules, n = _COLORS[name]
    samples = " UNION ALL ".join(f"SELECT {c} AS c, j, CAST({e} AS FLOAT) AS h, CAST(j AS FLOAT) * CAST(1 / {n - 1}::DOUBLE AS FLOAT) AS p FROM (SELECT j, j / {n - 1}::DOUBLE AS x FROM range(0, {n}) t(j))" for c, e in enumerate(reversed(rules)))
    spans = f"SELECT c, j, p, h, lead(p) OVER w AS q, lead(h) OVER w AS g FROM ({samples}) WINDOW w AS (PARTITION BY c ORDER BY j)"
    at = "CAST(k AS FLOAT) * CAST(1 / 255::DOUBLE AS FLOAT)"
    return f"SELECT c, k, greatest(0, least(255, round_even(CAST((h + (i - p) * (g - h) / (q - p)) * CAST(255 AS FLOAT) AS DOUBLE), 0))) AS e FROM (SELECT k, {at} AS i FROM range(0, 256) t(k)) JOIN ({spans}) s ON i >= p AND (i < q OR j = {n - 2}) AND q IS NOT NULL"


for _name in M.NAMES:
    QUERIES[f"color_map_{_name}"] = lambda spark, d, n=_name: pixels(M.apply_color_map(eight(spark, d), n))
    SQL[f"color_map_{_name}"] = pixels_sql(f"SELECT p.img, t.c, p.y, p.x, t.e AS v FROM ({EIGHT}) p JOIN ({_color_map_sql(_name)}) t ON p.v = t.k")
QUERIES["convert_maps"] = lambda spark, d: S.convert_maps(real(spark, d), shifted(real(spark, d))).select("img", "c", F.posexplode(F.arrays_zip("xi", "yi", "fraction")).alias("i", "t")).select("img", "c", "i", "t.xi", "t.yi", "t.fraction")
SQL["convert_maps"] = f"SELECT a.img, a.c, CAST(a.y * 8 + a.x AS INTEGER) AS i, CAST(floor(round_even(a.v * 32, 0) / 32) AS INTEGER) AS xi, CAST(floor(round_even(b.v * 32, 0) / 32) AS INTEGER) AS yi, CAST(round_even(a.v * 32, 0) - floor(round_even(a.v * 32, 0) / 32) * 32 + (round_even(b.v * 32, 0) - floor(round_even(b.v * 32, 0) / 32) * 32) * 32 AS INTEGER) AS fraction FROM ({REAL}) a JOIN ({shift_sql(REAL)}) b ON a.img = b.img AND a.y = b.y AND a.x = b.x"
of_planes("hough_segment", binary, lambda p: K.hough_segment(p, 1.0, math.pi / 18, 5, 1))
drawn("draw_frame_axes", lambda p: W.draw_frame_axes(p, _CAMERA, [], (0.1, 0.2, 0.0), (0, 0, 4.0), 2.0, 1))
drawn("fill_convex_poly", lambda p: W.fill_convex_poly(p, [(2, 1), (6, 1), (6, 6), (2, 6)], [99]), "x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 6")
