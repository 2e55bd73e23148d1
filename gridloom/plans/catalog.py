"""Registered queries of the array operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import planes as P
from gridloom.operators import arithmetic as A
from gridloom.operators import layout as L
from gridloom.operators import neighbourhood as W
from gridloom.operators import noise as Z
from gridloom.operators import reductions as R
from gridloom.operators import resampling as G
from gridloom.operators import selection as S
from gridloom.plans import fixtures as X
from gridloom.plans.fixtures import BINARY, COLOR, EIGHT, REAL, around_sql, binary, color, eight, pixels, pixels_sql, real, shift_sql, shifted, taps_sql
from gridloom.sources import images as I

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

_SRC = {"eight": (eight, EIGHT), "real": (real, REAL), "color": (color, COLOR), "binary": (binary, BINARY)}


def unary(name: str, source: str, op: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query on one set of planes; in the SQL, {p} stands for its pixels."""
    load, px = _SRC[source]
    QUERIES[name] = lambda spark, d: pixels(op(load(spark, d)))
    SQL[name] = pixels_sql(sql.replace("{p}", f"({px})"))


def each(name: str, source: str, op: Callable[[DataFrame], DataFrame], value: str) -> None:
    """A query that changes every value by an SQL expression of v."""
    unary(name, source, op, f"SELECT img, c, y, x, {value} AS v FROM {{p}}")


def both(name: str, source: str, op: Callable[[DataFrame, DataFrame], DataFrame], value: str) -> None:
    """A query on two sets of planes; the SQL expression is of a.v and b.v."""
    load, px = _SRC[source]
    QUERIES[name] = lambda spark, d: pixels(op(load(spark, d), shifted(load(spark, d))))
    SQL[name] = pixels_sql(f"SELECT a.img, a.c, a.y, a.x, {value} AS v FROM ({px}) a JOIN ({shift_sql(px)}) b ON a.img = b.img AND a.c = b.c AND a.y = b.y AND a.x = b.x")


def table(name: str, source: str, op: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query whose result is no image; every double is rounded to six places on both sides."""
    load, px = _SRC[source]

    def run(spark, d):
        out = op(load(spark, d))
        return out.select([(F.round(f.name, 6) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in out.schema.fields])

    QUERIES[name] = run
    SQL[name] = sql.replace("{p}", f"({px})")


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


def u8(x: str) -> str:
    return f"greatest(0.0, least(255.0, round_even({x}, 0)))"


# layout
unary("transpose", "eight", L.transpose, "SELECT img, c, x AS y, y AS x, v FROM {p}")
unary("flip_rows", "eight", lambda p: L.flip(p, 0), "SELECT img, c, 7 - y AS y, x, v FROM {p}")
unary("flip_columns", "eight", lambda p: L.flip(p, 1), "SELECT img, c, y, 7 - x AS x, v FROM {p}")
unary("flip_both", "eight", lambda p: L.flip(p, -1), "SELECT img, c, 7 - y AS y, 7 - x AS x, v FROM {p}")
unary("rotate_clockwise", "eight", lambda p: L.rotate(p, 0), "SELECT img, c, x AS y, 7 - y AS x, v FROM {p}")
unary("rotate_half", "eight", lambda p: L.rotate(p, 1), "SELECT img, c, 7 - y AS y, 7 - x AS x, v FROM {p}")
unary("rotate_anticlockwise", "eight", lambda p: L.rotate(p, 2), "SELECT img, c, 7 - x AS y, y AS x, v FROM {p}")
unary("repeat", "eight", lambda p: L.repeat(p, 2, 3), "SELECT img, c, y + 8 * j AS y, x + 8 * i AS x, v FROM {p} CROSS JOIN range(0, 2) a(j) CROSS JOIN range(0, 3) b(i)")
_PAIR = "SELECT img, c, y, x, v FROM {p} WHERE img IN (SELECT img - 1 FROM {p}) UNION ALL SELECT img - 1, c, %s, v FROM {p} WHERE img - 1 IN (SELECT img FROM {p})"
QUERIES["hconcat"] = lambda spark, d: pixels(_whole(L.hconcat, eight(spark, d)))
SQL["hconcat"] = pixels_sql((_PAIR % "y, x + 8").replace("{p}", f"({EIGHT})"))
QUERIES["vconcat"] = lambda spark, d: pixels(_whole(L.vconcat, eight(spark, d)))
SQL["vconcat"] = pixels_sql((_PAIR % "y + 8, x").replace("{p}", f"({EIGHT})"))


def _whole(op, planes: DataFrame) -> DataFrame:
    """An image and the next one, where both are there."""
    after = shifted(planes)
    return op([planes.join(after.select("img"), "img", "left_semi"), after.join(planes.select("img"), "img", "left_semi")])


QUERIES["split"] = lambda spark, d: X.to_pixels(L.split(color(spark, d)).withColumn("c", F.col("plane")))
SQL["split"] = f"SELECT CAST(img AS BIGINT) AS img, CAST(c AS INTEGER) AS c, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v FROM ({COLOR})"
unary("merge", "color", lambda p: L.merge([p.where("c = 2").withColumn("c", F.lit(0)), p.where("c < 2")]), "SELECT img, (c + 1) % 3 AS c, y, x, v FROM {p}")
unary("mix_channels", "color", lambda p: L.mix_channels(p, A.bitwise_not(p), [(0, 2), (1, 0)]), "SELECT a.img, a.c, a.y, a.x, CASE a.c WHEN 1 THEN 255 - a.v ELSE b.v END AS v FROM {p} a JOIN {p} b ON a.img = b.img AND a.y = b.y AND a.x = b.x AND b.c = CASE a.c WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 1 END")
for _name, _kind in (("constant", P.CONSTANT), ("replicate", P.REPLICATE), ("reflect", P.REFLECT), ("wrap", P.WRAP), ("reflect_101", P.REFLECT_101)):
    unary(f"copy_make_border_{_name}", "eight", lambda p, k=_kind: L.copy_make_border(p, 2, 3, 4, 1, k, 7.0), f"SELECT g.img, g.c, g.y, g.x, coalesce(s.v, 7.0) AS v FROM (SELECT DISTINCT img, c, j AS y, i AS x FROM {{p}} CROSS JOIN range(0, 13) a(j) CROSS JOIN range(0, 13) b(i)) g LEFT JOIN {{p}} s ON s.img = g.img AND s.c = g.c AND s.y = {X.border_sql('g.y - 2', 8, _kind)} AND s.x = {X.border_sql('g.x - 4', 8, _kind)}")
each("set_identity", "eight", lambda p: L.set_identity(p, (3.0,)), "CASE WHEN y = x THEN 3.0 ELSE 0.0 END")
unary("get_rect_sub_pix", "real", lambda p: L.get_rect_sub_pix(p, 4, 5, (1.25, 6.5)), "SELECT g.img, g.c, g.y, g.x, sum(coalesce(s.v, 0) * (CASE g.b WHEN 0 THEN 1 - g.fy ELSE g.fy END) * (CASE g.a WHEN 0 THEN 1 - g.fx ELSE g.fx END)) AS v FROM (SELECT *, floor(sy) AS y0, floor(sx) AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM (SELECT DISTINCT img, c, j AS y, i AS x, b, a, j + 5.0 AS sy, i - 0.75 AS sx FROM {p} CROSS JOIN range(0, 4) t(j) CROSS JOIN range(0, 5) u(i) CROSS JOIN range(0, 2) v1(b) CROSS JOIN range(0, 2) v2(a))) g LEFT JOIN {p} s ON s.img = g.img AND s.y = g.y0 + g.b AND s.x = g.x0 + g.a GROUP BY 1, 2, 3, 4")
unary("roi", "eight", lambda p: I.roi(p, 2, 1, 4, 5), "SELECT img, c, y - 2 AS y, x - 1 AS x, v FROM {p} WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 5")
unary("matrix_round_trip", "real", lambda p: I.from_matrices(I.to_matrices(p, N.F64)), "SELECT * FROM {p}")
unary("pixel_round_trip", "color", lambda p: I.from_pixels(I.to_pixels(p)), "SELECT * FROM {p}")

# predicates and look-ups
for _name, _op, _sql in (("eq", S.EQ, "="), ("gt", S.GT, ">"), ("ge", S.GE, ">="), ("lt", S.LT, "<"), ("le", S.LE, "<="), ("ne", S.NE, "<>")):
    both(f"compare_{_name}", "eight", lambda a, b, o=_op: S.compare(a, b, o), f"CASE WHEN a.v {_sql} b.v THEN 255.0 ELSE 0.0 END")
unary("in_range", "color", lambda p: S.in_range(p, A.convert_scale_abs(p, 0, 90), A.convert_scale_abs(p, 0, 170)), "SELECT img, 0 AS c, y, x, CASE WHEN bool_and(v BETWEEN 90 AND 170) THEN 255.0 ELSE 0.0 END AS v FROM {p} GROUP BY img, y, x")
for _name, _kind, _sql in (("binary", 0, "CASE WHEN v > 120 THEN 200.0 ELSE 0.0 END"), ("binary_inv", 1, "CASE WHEN v > 120 THEN 0.0 ELSE 200.0 END"), ("trunc", 2, "least(v, 120.0)"), ("tozero", 3, "CASE WHEN v > 120 THEN v ELSE 0.0 END"), ("tozero_inv", 4, "CASE WHEN v > 120 THEN 0.0 ELSE v END")):
    each(f"threshold_{_name}", "eight", lambda p, k=_kind: S.threshold(p, 120.7, 200.2, k), _sql)
unary("threshold_otsu", "eight", lambda p: S.threshold(p, 0, 255, S.BINARY | S.OTSU), """
SELECT p.img, p.c, p.y, p.x, CASE WHEN p.v > t.t THEN 255.0 ELSE 0.0 END AS v FROM {p} p JOIN (
    SELECT img, arg_min(k, (-sigma, k)) AS t FROM (
        SELECT img, k, CASE WHEN least(q, 1 - q) < 1.1920929e-07 THEN 0.0 ELSE round(q * (1 - q) * pow(m / nullif(q, 0) - (total - m) / nullif(1 - q, 0), 2), 9) END AS sigma FROM (
            SELECT h.img, g.k, sum(CASE WHEN h.v <= g.k THEN h.n ELSE 0 END) / 64.0 AS q, sum(CASE WHEN h.v <= g.k THEN h.n * h.v ELSE 0 END) / 64.0 AS m, sum(h.n * h.v) / 64.0 AS total
            FROM (SELECT img, v, count(*) AS n FROM {p} GROUP BY img, v) h CROSS JOIN range(0, 256) g(k) GROUP BY h.img, g.k)) GROUP BY img) t ON p.img = t.img""")
_R = [(dy, dx, 1 / 9) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
unary("adaptive_threshold", "eight", lambda p: S.adaptive_threshold(p, 255, False, False, 3, 2.3), f"SELECT a.img, a.c, a.y, a.x, CASE WHEN a.v > m.v - 2.3 THEN 255.0 ELSE 0.0 END AS v FROM {{p}} a JOIN ({taps_sql('{p}', _R, P.REPLICATE)}) m ON a.img = m.img AND a.y = m.y AND a.x = m.x")
each("lut", "eight", lambda p: S.lut(p, [(k * k) % 256 for k in range(256)]), "(CAST(v AS BIGINT) * CAST(v AS BIGINT)) % 256")
table("count_non_zero", "binary", S.count_non_zero, "SELECT img, CAST(c AS INTEGER) AS c, count(*) FILTER (WHERE v <> 0) AS n FROM {p} GROUP BY img, c")

# arithmetic
both("add", "eight", A.add, "least(255.0, a.v + b.v)")
both("subtract", "eight", A.subtract, "greatest(0.0, a.v - b.v)")
both("absdiff", "eight", A.absdiff, "abs(a.v - b.v)")
both("minimum", "real", A.minimum, "least(a.v, b.v)")
both("maximum", "real", A.maximum, "greatest(a.v, b.v)")
both("bitwise_and", "eight", A.bitwise_and, "CAST(a.v AS BIGINT) & CAST(b.v AS BIGINT)")
both("bitwise_or", "eight", A.bitwise_or, "CAST(a.v AS BIGINT) | CAST(b.v AS BIGINT)")
both("bitwise_xor", "eight", A.bitwise_xor, "xor(CAST(a.v AS BIGINT), CAST(b.v AS BIGINT))")
each("bitwise_not", "eight", A.bitwise_not, "255 - v")
unary("add_masked", "eight", lambda p: A.add(p, p, mask=S.threshold(p, 127, 255, 0), previous=A.bitwise_not(p)), "SELECT img, c, y, x, CASE WHEN v > 127 THEN least(255.0, 2 * v) ELSE 255 - v END AS v FROM {p}")
both("multiply", "eight", lambda a, b: A.multiply(a, b, 0.01), u8("a.v * b.v * 0.01"))
both("divide", "eight", lambda a, b: A.divide(a, b, 16.0), f"CASE WHEN b.v = 0 THEN 0.0 ELSE {u8('a.v * 16 / nullif(b.v, 0)')} END")
both("add_weighted", "eight", lambda a, b: A.add_weighted(a, 0.3, b, 0.6, 4.2), u8("a.v * 0.3 + b.v * 0.6 + 4.2").replace("0.3 ", "CAST(0.3 AS DOUBLE) "))
each("convert_scale_abs", "real", lambda p: A.convert_scale_abs(p, 300.0, -20.0), u8("abs(v * 300 - 20)"))
QUERIES["blend_linear"] = lambda spark, d: pixels(A.blend_linear(eight(spark, d), shifted(eight(spark, d)), real(spark, d), shifted(real(spark, d)), N.F64))
SQL["blend_linear"] = pixels_sql(f"SELECT a.img, a.c, a.y, a.x, a.v * wa.v + b.v * wb.v AS v FROM ({EIGHT}) a JOIN ({shift_sql(EIGHT)}) b USING (img, c, y, x) JOIN ({REAL}) wa USING (img, c, y, x) JOIN ({shift_sql(REAL)}) wb USING (img, c, y, x)".replace("a.img, a.c, a.y, a.x", "img, c, y, x"))
each("exp", "real", A.exp, "exp(v)")
each("log", "real", lambda p: A.log(A.maximum(p, p)), "CASE WHEN v > 0 THEN ln(CASE WHEN v > 0 THEN v ELSE 1 END) WHEN v = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END")
each("sqrt", "eight", A.sqrt, "sqrt(v)")
each("power", "eight", lambda p: A.power(p, 2, N.U8), "least(255.0, v * v)")
both("magnitude", "real", A.magnitude, "sqrt(a.v * a.v + b.v * b.v)")
both("cart_to_polar_angle", "real", lambda a, b: A.cart_to_polar(a, b, True)[1], "CASE WHEN atan2(b.v, a.v) < 0 THEN degrees(atan2(b.v, a.v) + 2 * pi()) ELSE degrees(atan2(b.v, a.v)) END")
both("polar_to_cart_x", "real", lambda a, b: A.polar_to_cart(a, b)[0], "a.v * cos(b.v)")
both("polar_to_cart_y", "real", lambda a, b: A.polar_to_cart(a, b)[1], "a.v * sin(b.v)")
unary("transform", "color", lambda p: A.transform(p, [[0.5, 0.25, 0.125, 3], [1, -1, 0.5, 0]]), "SELECT img, 0 AS c, y, x, 3 + sum(v * CASE c WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0.125 END) AS v FROM {p} GROUP BY img, y, x UNION ALL SELECT img, 1, y, x, sum(v * CASE c WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0.5 END) FROM {p} GROUP BY img, y, x")
QUERIES["perspective_transform"] = lambda spark, d: A.perspective_transform(X.polygons(spark, d), [[1, 0.5, 2], [0.25, 2, 1], [0.001, 0.002, 1]]).select("set_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
SQL["perspective_transform"] = f"SELECT set_id, CAST(pos AS BIGINT) AS pos, {r6('(pos + 0.5 * y + 2) / (0.001 * pos + 0.002 * y + 1)')} AS x, {r6('(0.25 * pos + 2 * y + 1) / (0.001 * pos + 0.002 * y + 1)')} AS y FROM ({X.POLYGONS})"
_QUAD = f"FROM ({REAL}) a JOIN ({shift_sql(REAL)}) b USING (img, c, y, x) JOIN ({shift_sql(REAL, 2)}) e USING (img, c, y, x) JOIN ({shift_sql(REAL, 3)}) f USING (img, c, y, x)"
QUERIES["div_spectrums"] = lambda spark, d: pixels(A.div_spectrums(*[shifted(real(spark, d), k) for k in range(4)])[0])
SQL["div_spectrums"] = pixels_sql(f"SELECT img, c, y, x, (a.v * e.v + b.v * f.v) / greatest(e.v * e.v + f.v * f.v, 2.2250738585072014e-308) AS v {_QUAD}")
unary("cvt_color_gray", "color", A.to_gray, "SELECT img, 0 AS c, y, x, (sum(CAST(v AS BIGINT) * CASE c WHEN 0 THEN 1868 WHEN 1 THEN 9617 ELSE 4899 END) + 8192) // 16384 AS v FROM {p} GROUP BY img, y, x")
unary("cvt_color_swap", "color", lambda p: A.reorder_channels(p, (2, 1, 0), 255.0), "SELECT img, 2 - c AS c, y, x, v FROM {p} UNION ALL SELECT DISTINCT img, 3, y, x, 255.0 FROM {p}")
unary("cvt_color_from_gray", "eight", lambda p: A.gray_to_color(p, 4), "SELECT img, k AS c, y, x, CASE k WHEN 3 THEN 255.0 ELSE v END AS v FROM {p} CROSS JOIN range(0, 4) t(k)")

# aggregates
table("mean", "real", R.mean, f"SELECT img, CAST(c AS INTEGER) AS c, {r6('avg(v)')} AS mean FROM {{p}} GROUP BY img, c")
table("mean_masked", "eight", lambda p: R.mean(p, S.threshold(p, 127, 255, 0)), f"SELECT img, CAST(c AS INTEGER) AS c, {r6('coalesce(avg(v) FILTER (WHERE v > 127), 0)')} AS mean FROM {{p}} GROUP BY img, c")
table("mean_std_dev", "eight", R.mean_std_dev, f"SELECT img, CAST(c AS INTEGER) AS c, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std_dev FROM {{p}} GROUP BY img, c")
table("min_max_loc", "eight", R.min_max_loc, "SELECT img, CAST(c AS INTEGER) AS c, min(v) AS min, CAST(arg_min(y, (v, y, x)) AS INTEGER) AS min_y, CAST(arg_min(x, (v, y, x)) AS INTEGER) AS min_x, max(v) AS max, CAST(arg_min(y, (-v, y, x)) AS INTEGER) AS max_y, CAST(arg_min(x, (-v, y, x)) AS INTEGER) AS max_x FROM {p} GROUP BY img, c")
table("trace", "real", R.trace, f"SELECT img, CAST(c AS INTEGER) AS c, {r6('sum(v)')} AS trace FROM {{p}} WHERE y = x GROUP BY img, c")
for _name, _kind, _sql in (("sum", R.SUM, "sum(v)"), ("avg", R.AVG, "avg(v)"), ("max", R.MAX, "max(v)"), ("min", R.MIN, "min(v)"), ("sum2", R.SUM2, "sum(v * v)")):
    unary(f"reduce_rows_{_name}", "real", lambda p, k=_kind: R.reduce(p, 0, k), f"SELECT img, c, 0 AS y, x, {_sql} AS v FROM {{p}} GROUP BY img, c, x")
    unary(f"reduce_columns_{_name}", "real", lambda p, k=_kind: R.reduce(p, 1, k), f"SELECT img, c, y, 0 AS x, {_sql} AS v FROM {{p}} GROUP BY img, c, y")
for _name, _kind, _sql in (("inf", R.NORM_INF, "max(abs(v))"), ("l1", R.NORM_L1, "sum(abs(v))"), ("l2", R.NORM_L2, "sqrt(sum(v * v))"), ("l2sqr", R.NORM_L2SQR, "sum(v * v)"), ("hamming", R.NORM_HAMMING, "sum(bit_count(CAST(v AS BIGINT)))"), ("hamming2", R.NORM_HAMMING2, "sum(bit_count((CAST(v AS BIGINT) | (CAST(v AS BIGINT) >> 1)) & 21845))")):
    table(f"norm_{_name}", "color", lambda p, k=_kind: R.norm(p, k), f"SELECT img, {r6(_sql)} AS norm FROM {{p}} GROUP BY img")
table("norm_diff", "real", lambda p: R.norm_diff(p, shifted(p)), f"SELECT img, {r6('sqrt(sum((a.v - b.v) * (a.v - b.v)))')} AS norm FROM {{p}} a JOIN ({shift_sql('{p}')}) b USING (img, c, y, x) GROUP BY img")
unary("normalize_minmax", "real", lambda p: R.normalize(p, 0, 255, R.NORM_MINMAX), "SELECT img, c, y, x, (v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w) AS v FROM {p} WINDOW w AS (PARTITION BY img)")
unary("normalize_l2", "real", lambda p: R.normalize(p, 2.0), "SELECT img, c, y, x, v * 2 / sqrt(sum(v * v) OVER (PARTITION BY img)) AS v FROM {p}")
_INTEGRAL = "SELECT g.img, g.c, g.y, g.x, coalesce(sum(s.v%s), 0) AS v FROM (SELECT DISTINCT img, c, j AS y, i AS x FROM {p} CROSS JOIN range(0, 9) a(j) CROSS JOIN range(0, 9) b(i)) g LEFT JOIN {p} s ON s.img = g.img AND s.y < g.y AND s.x < g.x GROUP BY 1, 2, 3, 4"
unary("integral", "eight", R.integral, _INTEGRAL % "")
unary("integral2", "eight", lambda p: R.integral(p, True), _INTEGRAL % " * s.v")
_ORDER3 = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]
_RAW = ", ".join(f"CAST(sum(v * pow(x, {p}) * pow(y, {q})) AS DOUBLE) AS m{p}{q}" for p, q in _ORDER3)
_MOMENTS = f"""SELECT *, mu20 * s2 AS nu20, mu11 * s2 AS nu11, mu02 * s2 AS nu02, mu30 * s3 AS nu30, mu21 * s3 AS nu21, mu12 * s3 AS nu12, mu03 * s3 AS nu03 FROM (
    SELECT *, m30 - cx * (3.0::DOUBLE * mu20 + cx * m10) AS mu30, m21 - cx * (2.0::DOUBLE * mu11 + cx * m01) - cy * mu20 AS mu21,
        m12 - cy * (2.0::DOUBLE * mu11 + cy * m10) - cx * mu02 AS mu12, m03 - cy * (3.0::DOUBLE * mu02 + cy * m01) AS mu03, inv * inv AS s2, inv * inv * sqrt(abs(inv)) AS s3 FROM (
        SELECT *, m20 - m10 * cx AS mu20, m11 - m10 * cy AS mu11, m02 - m01 * cy AS mu02 FROM (
            SELECT *, m10 * inv AS cx, m01 * inv AS cy FROM (SELECT *, CASE WHEN m00 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / m00 END AS inv FROM (SELECT img, c, {_RAW} FROM {{p}} GROUP BY img, c)))))""".replace("{p}", f"({EIGHT})")
_ALL = [f"m{p}{q}" for p, q in _ORDER3] + [f"{n}{k}" for n in ("mu", "nu") for k in ("20", "11", "02", "30", "21", "12", "03")]
# central moments are differences of large sums: what is left of those is rounded to where it is sure
QUERIES["moments"] = lambda spark, d: R.moments(eight(spark, d)).select("img", "c", *[F.round(n, 12 if n.startswith("nu") else 3).alias(n) for n in _ALL])
_ROUNDED = [f"round({n}, {12 if n.startswith('nu') else 3}) AS {n}" for n in _ALL]
SQL["moments"] = f"SELECT img, CAST(c AS INTEGER) AS c, {', '.join(_ROUNDED)} FROM ({_MOMENTS})"
_HU_SQL = """SELECT img, c, s AS hu1, d * d + 4 * nu11 * nu11 AS hu2, a * a + b * b AS hu3, t0 * t0 + t1 * t1 AS hu4, a * t0 * (t0 * t0 - 3 * t1 * t1) + b * t1 * (3 * t0 * t0 - t1 * t1) AS hu5,
    d * (t0 * t0 - t1 * t1) + 4 * nu11 * t0 * t1 AS hu6, b * t0 * (t0 * t0 - 3 * t1 * t1) - a * t1 * (3 * t0 * t0 - t1 * t1) AS hu7 FROM (
    SELECT img, c, nu11, nu20 + nu02 AS s, nu20 - nu02 AS d, nu30 - 3 * nu12 AS a, 3 * nu21 - nu03 AS b, nu30 + nu12 AS t0, nu21 + nu03 AS t1 FROM ({m}))""".replace("{m}", _MOMENTS)
_HU_DIGITS = (12, 15, 15, 15, 20, 20, 20)
QUERIES["hu_moments"] = lambda spark, d: R.hu_moments(R.moments(eight(spark, d))).select("img", "c", *[(F.round(F.col(f"hu{k}") * 10.0 ** (n - 9), 9) + 0.0).alias(f"hu{k}") for k, n in enumerate(_HU_DIGITS, 1)])
SQL["hu_moments"] = f"SELECT img, CAST(c AS INTEGER) AS c, {', '.join(f'round(hu{k} * 1e{n - 9}::DOUBLE, 9) + 0.0 AS hu{k}' for k, n in enumerate(_HU_DIGITS, 1))} FROM ({_HU_SQL})"
# the third method looks at the leading invariants' sizes in decades: only those that are well above rounding take part
_LEVEL = lambda h: f"sign({h}) * log10(abs({h}))"
_TERMS = {1: "abs(1 / {a} - 1 / {b})", 2: "abs({b} - {a})", 3: "abs(({a} - {b}) / {a})"}
for _m, _term in _TERMS.items():
    _name = "match_shapes" if _m == 2 else f"match_shapes_{_m}"
    _sum = " + ".join(f"CASE WHEN abs(a.hu{k}) > 0 AND abs(b.hu{k}) > 0 THEN {_term.format(a=f"({_LEVEL(f'a.hu{k}')})", b=f"({_LEVEL(f'b.hu{k}')})")} ELSE 0 END" for k in range(1, 4))
    QUERIES[_name] = lambda spark, d, m=_m: _compared_shapes(R.hu_moments(R.moments(eight(spark, d))), m)
    SQL[_name] = f"SELECT a.img, CAST(a.c AS INTEGER) AS c, round({_sum}, 5) + 0.0 AS distance FROM ({_HU_SQL}) a JOIN ({_HU_SQL}) b ON a.img = b.img - 1"


def _compared_shapes(hu: DataFrame, method: int) -> DataFrame:
    first = hu.select("img", "c", "hu1", "hu2", "hu3", *[F.lit(0.0).alias(f"hu{k}") for k in range(4, 8)])
    return R.match_shapes(first, first.withColumn("img", F.col("img") - 1), method).select("img", "c", (F.round("distance", 5) + 0.0).alias("distance"))


table("total", "real", R.total, f"SELECT img, CAST(c AS INTEGER) AS c, {r6('sum(v)')} AS sum FROM {{p}} GROUP BY img, c")
unary("extract_channel", "color", lambda p: L.extract_channel(p, 1), "SELECT img, 0 AS c, y, x, v FROM {p} WHERE c = 1")
unary("insert_channel", "color", lambda p: L.insert_channel(p, L.extract_channel(p, 2), 0), "SELECT img, c, y, x, v FROM {p} WHERE c > 0 UNION ALL SELECT img, 0, y, x, v FROM {p} WHERE c = 2")
for _name, _load, _px, _seed, _kind in (("randu", real, REAL, Z.SEED, "u"), ("randn", real, REAL, Z.SEED, "n"), ("set_rng_seed", color, COLOR, 12345, "u"), ("randn_color", color, COLOR, 7, "n")):
    QUERIES[_name] = lambda spark, d, a=_load, s=_seed, k=_kind: pixels(Z.randu(a(spark, d), [-2.0, 1.0, 0.0], [3.0, 2.0, 256.0], s) if k == "u" else Z.randn(a(spark, d), 5.0, 2.0, s))
    # the generator step by step, one number after another
    _two = "18446744073709551616::UHUGEINT"
    _mixed = f"SELECT k, xor(z, z >> 31) AS z FROM (SELECT k, xor(z, z >> 27) * 10723151780598845931::UHUGEINT % {_two} AS z FROM (SELECT k, xor(s, s >> 30) * 13787848793156543929::UHUGEINT % {_two} AS z FROM g WHERE k >= 0))"
    _value = "CASE c WHEN 0 THEN -2 * (1 - u) + 3 * u WHEN 1 THEN 1 - u + 2 * u ELSE 256 * u END" if _kind == "u" else "5 + 2 * r * CASE WHEN n % 2 = 0 THEN cos(w) ELSE sin(w) END"
    _numbers = "SELECT k, CAST(z >> 11 AS DOUBLE) / 9007199254740992 AS u FROM z" if _kind == "u" else "SELECT k, sqrt(-2 * ln((CAST(z >> 11 AS DOUBLE) + 0.5) / 9007199254740992)) AS r, 2 * pi() * lead(CAST(z >> 11 AS DOUBLE) / 9007199254740992) OVER (ORDER BY k) AS w FROM z"
    _at = "n" if _kind == "u" else "n - n % 2"
    SQL[_name] = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY img, y, x, c) - 1 AS n FROM ({_px})),
g AS (SELECT -1::BIGINT AS k, {_seed}::UHUGEINT AS s UNION ALL SELECT k + 1, (s + 11400714819323198485::UHUGEINT) % {_two} FROM g WHERE k <= (SELECT count(*) FROM p)),
z AS MATERIALIZED ({_mixed}), v AS MATERIALIZED ({_numbers})
{pixels_sql(f"SELECT img, c, y, x, {_value} AS v FROM p JOIN v ON v.k = {_at}")}"""
table("calc_hist", "real", lambda p: R.calc_hist(p, 16, -0.3, 0.3), "SELECT g.img, CAST(g.c AS INTEGER) AS c, CAST(g.b AS INTEGER) AS bin, CAST(count(s.v) AS INTEGER) AS n FROM (SELECT DISTINCT img, c, b FROM {p} CROSS JOIN range(0, 16) t(b)) g LEFT JOIN (SELECT img, v, floor((v - (-0.3)) * 16 / CAST(0.6 AS DOUBLE)) AS b FROM {p} WHERE v >= -0.3 AND v < 0.3) s ON s.img = g.img AND s.b = g.b GROUP BY 1, 2, 3")
_HIST = "(SELECT g.img, g.b, CAST(count(s.v) AS DOUBLE) AS n FROM (SELECT DISTINCT img, b FROM {p} CROSS JOIN range(0, 8) t(b)) g LEFT JOIN (SELECT img, v, floor(v / 32) AS b FROM {p}) s ON s.img = g.img AND s.b = g.b GROUP BY 1, 2)"
for _k, _sql in enumerate(("CASE WHEN var_pop(a.n) * var_pop(b.n) <= 0 THEN 1 ELSE corr(a.n, b.n) END", "coalesce(sum((a.n - b.n) * (a.n - b.n) / a.n) FILTER (WHERE a.n > 0), 0)", "sum(least(a.n, b.n))", "sqrt(greatest(0.0, round(1 - sum(sqrt(a.n * b.n)) / 64, 12)))")):
    table(f"compare_hist_{_k}", "eight", lambda p, k=_k: _hist_distance(p, k), f"SELECT a.img, 0 AS c, {r6(_sql)} AS distance FROM {_HIST} a JOIN (SELECT img - 1 AS img, b, n FROM {_HIST}) b ON a.img = b.img AND a.b = b.b GROUP BY a.img")


def _hist_distance(planes: DataFrame, method: int) -> DataFrame:
    h = R.calc_hist(planes, 8, 0, 256)
    out = R.compare_hist(h, h.withColumn("img", F.col("img") - 1), method)
    return out if method != 3 else out.withColumn("distance", F.when(F.col("distance") < 1e-6, 0.0).otherwise(F.col("distance")))


each("calc_back_project", "eight", lambda p: R.calc_back_project(p, [3, 9, 27, 81], 32, 224), "CASE WHEN v >= 32 AND v < 224 THEN CASE floor((v - 32) * 4 / 192) WHEN 0 THEN 3 WHEN 1 THEN 9 WHEN 2 THEN 27 ELSE 81 END ELSE 0 END")
unary("equalize_hist", "eight", R.equalize_hist, "SELECT img, c, y, x, CASE WHEN f = 64 THEN v ELSE round_even((n - f) * 255.0 / (64 - f), 0) END AS v FROM (SELECT *, first_value(n) OVER (PARTITION BY img ORDER BY v) AS f FROM (SELECT *, count(*) OVER (PARTITION BY img ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {p}))")

# windows
_K = [[1.0, 2.0, -1.0], [0.5, 3.0, -2.0], [0.25, -1.0, 1.5]]
_T = W._offsets(_K)
B101 = P.REFLECT_101


def window(name: str, source: str, op, weights: list[tuple[int, int, float]], border: int = B101, value: str = "sum(w * s)", finish: str = "v") -> None:
    unary(name, source, op, f"SELECT img, c, y, x, {finish} AS v FROM ({taps_sql('{p}', weights, border, value)})")


window("filter2d", "real", lambda p: W.filter2d(p, _K, delta=0.5), _T, finish="v + 0.5")
window("filter2d_u8", "eight", lambda p: W.filter2d(p, _K, N.U8, border=P.CONSTANT), _T, P.CONSTANT, finish=u8("v"))
window("sep_filter2d", "real", lambda p: W.sep_filter2d(p, [1, 2, 1], [1, 0, -1]), W._offsets(W._outer([1, 0, -1], [1, 2, 1])))
window("blur", "eight", lambda p: W.blur(p, 3, 3), W._offsets([[1.0] * 3] * 3), finish="least(255, (CAST(v AS BIGINT) * 7281 + 32768) // 65536)")
window("box_filter", "real", lambda p: W.box_filter(p, 3, 5, N.F64, False), W._offsets([[1.0] * 5] * 3))
window("sqr_box_filter", "real", lambda p: W.sqr_box_filter(p, 3, 3, depth=N.F64), W._offsets([[1.0] * 3] * 3), value="sum(s * s) / 9")
window("median_blur", "eight", lambda p: W.median_blur(p, 3), W._offsets([[1.0] * 3] * 3), P.REPLICATE, "median(s)")
_G3 = [math.exp(-(k * k) / (2 * 1.2 * 1.2)) / sum(math.exp(-(j * j) / (2 * 1.2 * 1.2)) for j in (-1, 0, 1)) for k in (-1, 0, 1)]
window("gaussian_blur", "eight", lambda p: W.gaussian_blur(p, 3, 3, 1.2), W._offsets(W._outer(_G3, _G3)), finish=u8("round(v, 9)"))
unary("stack_blur", "eight", lambda p: W.stack_blur(p, 3, 3), f"SELECT img, c, y, x, floor(v / 4) AS v FROM ({taps_sql('(SELECT img, c, y, x, floor(v / 4) AS v FROM (' + taps_sql('{p}', [(0, -1, 1.0), (0, 0, 2.0), (0, 1, 1.0)], P.REPLICATE) + '))', [(-1, 0, 1.0), (0, 0, 2.0), (1, 0, 1.0)], P.REPLICATE)})")
unary("bilateral_filter", "real", lambda p: W.bilateral_filter(p, 3, 0.2, 1.5, depth=N.F64), f"SELECT img, c, y, x, sum(s * k) / sum(k) AS v FROM (SELECT a.img, a.c, a.y, a.x, a.s, exp((a.s - q.v) * (a.s - q.v) * (-0.5 / (0.2 * 0.2)) + (a.dy * a.dy + a.dx * a.dx) * (-0.5 / (1.5 * 1.5))) AS k FROM ({around_sql('{p}', W._offsets([[1.0] * 3] * 3), B101)}) a JOIN {{p}} q ON a.img = q.img AND a.y = q.y AND a.x = q.x) GROUP BY img, c, y, x")
_CROSS = [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
_CROSS_T = [t for t in W._offsets(_CROSS) if t[2]]


def _order(px: str, fn: str) -> str:
    return f"SELECT a.img, a.c, a.y, a.x, {fn}(s.v) AS v FROM ({px}) a JOIN ({px}) s ON a.img = s.img AND a.c = s.c AND abs(a.y - s.y) + abs(a.x - s.x) <= 1 GROUP BY 1, 2, 3, 4"


unary("erode", "eight", lambda p: W.erode(p, _CROSS), _order("{p}", "min"))
unary("dilate", "eight", lambda p: W.dilate(p, _CROSS), _order("{p}", "max"))
unary("morphology_open", "eight", lambda p: W.morphology_ex(p, W.OPEN, _CROSS), _order(_order("{p}", "min"), "max"))
unary("morphology_close", "eight", lambda p: W.morphology_ex(p, W.CLOSE, _CROSS), _order(_order("{p}", "max"), "min"))
unary("morphology_gradient", "eight", lambda p: W.morphology_ex(p, W.GRADIENT, _CROSS), f"SELECT img, c, y, x, a.v - b.v AS v FROM ({_order('{p}', 'max')}) a JOIN ({_order('{p}', 'min')}) b USING (img, c, y, x)")
_SX, _SY = W._offsets(W._outer([1, 2, 1], [-1, 0, 1])), W._offsets(W._outer([-1, 0, 1], [1, 2, 1]))
window("sobel_x", "eight", lambda p: W.sobel(p, 1, 0), _SX)
window("sobel_y", "eight", lambda p: W.sobel(p, 0, 1), _SY)
window("scharr", "eight", lambda p: W.scharr(p, 1, 0), W._offsets(W._outer([3, 10, 3], [-1, 0, 1])))
window("laplacian", "eight", lambda p: W.laplacian(p, size=3), W._offsets([[2, 0, 2], [0, -8, 0], [2, 0, 2]]))
window("laplacian_5", "real", lambda p: W.laplacian(p, N.F64, 5), W._offsets([[a * p + b * q for p, q in zip([1, 4, 6, 4, 1], [1, 0, -2, 0, 1], strict=True)] for a, b in zip([1, 0, -2, 0, 1], [1, 4, 6, 4, 1], strict=True)]))
window("spatial_gradient_x", "eight", lambda p: W.spatial_gradient(p)[0], _SX)
window("spatial_gradient_y", "eight", lambda p: W.spatial_gradient(p)[1], _SY)
unary("pyr_down", "eight", W.pyr_down, f"SELECT img, c, y // 2 AS y, x // 2 AS x, floor((v + 128) / 256) AS v FROM ({taps_sql('{p}', W._offsets(W._outer(W._FIVE, W._FIVE)), B101)}) WHERE y % 2 = 0 AND x % 2 = 0")
unary("pyr_up", "eight", W.pyr_up, "SELECT img, c, y, x, floor((v + 32) / 64) AS v FROM (" + taps_sql("(SELECT g.img, g.c, g.y, g.x, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT img, c, j AS y, i AS x FROM {p} CROSS JOIN range(0, 16) a(j) CROSS JOIN range(0, 16) b(i)) g LEFT JOIN {p} s ON s.img = g.img AND 2 * s.y = g.y AND 2 * s.x = g.x)", W._offsets(W._outer(W._FIVE, W._FIVE)), B101, rows=16, cols=16) + ")")
_SC = 1 / (4 * 255.0 * 3)
_GRADS = f"(SELECT img, c, y, x, d.v AS dx, e.v AS dy FROM ({taps_sql('{p}', [(a, b, w * _SC) for a, b, w in _SX], B101)}) d JOIN ({taps_sql('{p}', [(a, b, w * _SC) for a, b, w in _SY], B101)}) e USING (img, c, y, x))"
_BOX3 = W._offsets([[1.0] * 3] * 3)
_TENSOR = f"(SELECT img, c, y, x, p.v AS xx, q.v AS xy, r.v AS yy FROM ({taps_sql(f'(SELECT img, c, y, x, dx * dx AS v FROM {_GRADS})', _BOX3, B101)}) p JOIN ({taps_sql(f'(SELECT img, c, y, x, dx * dy AS v FROM {_GRADS})', _BOX3, B101)}) q USING (img, c, y, x) JOIN ({taps_sql(f'(SELECT img, c, y, x, dy * dy AS v FROM {_GRADS})', _BOX3, B101)}) r USING (img, c, y, x))"
unary("corner_harris", "eight", lambda p: W.corner_harris(p, 3, 3, 0.04), f"SELECT img, c, y, x, xx * yy - xy * xy - 0.04 * (xx + yy) * (xx + yy) AS v FROM {_TENSOR}")
unary("corner_min_eigen_val", "eight", lambda p: W.corner_min_eigen_val(p, 3), f"SELECT img, c, y, x, (xx + yy) / 2 - sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS v FROM {_TENSOR}")
_PRE = {"dx": _SX, "dy": _SY, "dxx": W._offsets(W._outer([1, 2, 1], [1, -2, 1])), "dyy": W._offsets(W._outer([1, -2, 1], [1, 2, 1])), "dxy": W._offsets(W._outer([-1, 0, 1], [-1, 0, 1]))}
unary("pre_corner_detect", "eight", W.pre_corner_detect, "SELECT img, c, y, x, dx * dx * dyy + dy * dy * dxx - 2 * dx * dy * dxy AS v FROM (SELECT img, c, y, x, " + ", ".join(f"sum(s * w_{k}) / 1020 AS {k}" for k in _PRE) + " FROM (SELECT a.*, " + ", ".join("CASE " + " ".join(f"WHEN dy = {i} AND dx = {j} THEN {w}" for i, j, w in t) + f" END AS w_{k}" for k, t in _PRE.items()) + f" FROM ({around_sql('{p}', _BOX3, B101)}) a) GROUP BY img, c, y, x)")
_TPL = [[10.0, 200.0, 30.0], [90.0, 120.0, 5.0]]
_TN, _TM = 6, sum(map(sum, _TPL)) / 6
_TSQ, _TVAR = sum(v * v for r in _TPL for v in r), sum((v - _TM) ** 2 for r in _TPL for v in r)
_MATCH = "(SELECT img, c, y, x, sum(s) AS plain, sum(s * s) AS square, sum(w * s) AS crossed FROM (" + around_sql("{p}", [(i, j, w) for i, r in enumerate(_TPL) for j, w in enumerate(r)], P.CONSTANT) + ") WHERE y <= 6 AND x <= 5 GROUP BY img, c, y, x)"
for _k, _sql in enumerate(("square - 2 * crossed + {q}", "least(1.0, (square - 2 * crossed + {q}) / sqrt(square * {q}))", "crossed", "crossed / sqrt(square * {q})", "crossed - plain * {m}", "CASE WHEN square - plain * plain / 6 <= 0 THEN 0 ELSE (crossed - plain * {m}) / sqrt((square - plain * plain / 6) * {v}) END")):
    unary(f"match_template_{_k}", "eight", lambda p, k=_k: W.match_template(p, _TPL, k), "SELECT img, c, y, x, " + _sql.format(q=f"CAST({_TSQ} AS DOUBLE)", m=f"CAST({_TM!r} AS DOUBLE)", v=f"CAST({_TVAR!r} AS DOUBLE)") + f" AS v FROM {_MATCH}")
# masked: the differences from the weighted means, times the weights, window by window
_WHOLE = [[0, 1, 2], [3, 0, 255]]
_SHARES = [[0.5, 1.25, 0.0], [2.0, 0.75, 1.0]]
for _label, _given, _w, _depth in (("u8", _WHOLE, [[float(v != 0) for v in r] for r in _WHOLE], N.U8), ("f32", _SHARES, _SHARES, N.F32)):
    _listed = ", ".join(f"({i}, {j}, {float(_TPL[i][j])!r}::DOUBLE, {float(_w[i][j])!r}::DOUBLE)" for i in range(2) for j in range(3))
    _taken = f"SELECT q.img, q.c, q.y, q.x, s.v AS i, t, w, sum(t * w) OVER z / sum(w) OVER z AS tm, sum(s.v * w) OVER z / sum(w) OVER z AS im FROM {{p}} q CROSS JOIN (VALUES {_listed}) m(dy, dx, t, w) JOIN {{p}} s ON s.img = q.img AND s.c = q.c AND s.y = q.y + dy AND s.x = q.x + dx WHERE q.y <= 6 AND q.x <= 5 WINDOW z AS (PARTITION BY q.img, q.c, q.y, q.x)"
    for _k in range(6):
        _t, _i = ("(t - tm) * w", "(i - im) * w") if _k > 3 else ("t * w", "i * w")
        _top = f"sum(pow({_i} - {_t}, 2))" if _k < 2 else f"sum(({_i}) * ({_t}))"
        _score = f"{_top} / sqrt(sum(pow({_i}, 2)) * sum(pow({_t}, 2)))" if _k % 2 else _top
        unary(f"match_template_{_k}_masked_{_label}", "eight", lambda p, k=_k, g=_given, d=_depth: W.match_template(p, _TPL, k, g, d), f"SELECT img, c, y, x, {_score} AS v FROM ({_taken}) GROUP BY img, c, y, x")


# resampling
def resized(name: str, source: str, target: tuple[int, int], mode: int, depth: int, finish: str) -> None:
    def taps(n: int, m: int) -> str:
        """(k, i, w): the weight of source place i in target place k."""
        size = f"({n} / {m}::DOUBLE)"
        if mode == G.NEAREST:
            return f"(SELECT k, CAST(least({n - 1}, floor(k * {size})) AS BIGINT) AS i, 1.0::DOUBLE AS w FROM range(0, {m}) r(k))"
        if mode == G.AREA or target == (4, 4):
            return f"(SELECT k, i, (least(i + 1, (k + 1) * {size}) - greatest(i, k * {size})) / {size} AS w FROM range(0, {m}) r(k) JOIN range(0, {n}) q(i) ON i + 1 > k * {size} AND i < (k + 1) * {size})"
        reach, weight = {
            G.LINEAR: (1, "1 - t"),
            G.CUBIC: (2, "CASE WHEN t <= 1 THEN 1.25::DOUBLE * t * t * t - 2.25::DOUBLE * t * t + 1 ELSE -0.75::DOUBLE * (t * t * t - 5 * t * t + 8 * t - 4) END"),
            G.LANCZOS4: (4, "CASE WHEN t = 0 THEN 1 WHEN t < 4 THEN 4 * sin(pi() * t) * sin(pi() * t / 4) / (pi() * pi() * t * t) ELSE 0 END"),
        }[mode]
        near = f"SELECT k, i, CAST({weight} AS DOUBLE) AS w FROM (SELECT k, b + o AS i, abs(p - b - o) AS t FROM (SELECT k, p, floor(p) AS b FROM (SELECT k, (k + 0.5::DOUBLE) * {size} - 0.5::DOUBLE AS p FROM range(0, {m}) r(k))) JOIN range({1 - reach}, {reach + 1}) q(o) ON true)"
        whole = "sum(w) OVER (PARTITION BY k)" if mode == G.LANCZOS4 else "1"
        return f"(SELECT k, CAST(greatest(0, least({n - 1}, i)) AS BIGINT) AS i, w / {whole} AS w FROM ({near}))"

    unary(name, source, lambda p: G.resize(p, (8, 8), target, mode, depth), f"SELECT img, c, y, x, {finish} AS v FROM (SELECT s.img, s.c, a.k AS y, b.k AS x, sum(a.w * b.w * s.v) AS v FROM {{p}} s JOIN {taps(8, target[0])} a(k, i, w) ON s.y = a.i JOIN {taps(8, target[1])} b(k, i, w) ON s.x = b.i GROUP BY 1, 2, 3, 4)")


resized("resize_nearest", "eight", (5, 11), G.NEAREST, N.U8, "v")
resized("resize_linear", "real", (5, 11), G.LINEAR, N.F64, "v")
resized("resize_half", "eight", (4, 4), G.LINEAR, N.U8, "floor(v + 0.5)")
resized("resize_area", "real", (3, 5), G.AREA, N.F64, "v")
resized("resize_cubic", "real", (12, 5), G.CUBIC, N.F64, "v")
resized("resize_lanczos", "real", (12, 13), G.LANCZOS4, N.F64, "v")


def gathered(name: str, source: str, op, sy: str, sx: str, rows: int, cols: int) -> None:
    """Bilinear values at places given in SQL; 0 outside."""
    grid = f"(SELECT DISTINCT img, c, j AS y, i AS x FROM {{p}} CROSS JOIN range(0, {rows}) a(j) CROSS JOIN range(0, {cols}) b(i))"
    at = f"(SELECT *, floor(sy) AS y0, floor(sx) AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM (SELECT g.*, {sy} AS sy, {sx} AS sx FROM {grid} g))"
    unary(name, source, op, f"SELECT g.img, g.c, g.y, g.x, sum(coalesce(s.v, 0) * (CASE b WHEN 0 THEN 1 - fy ELSE fy END) * (CASE a WHEN 0 THEN 1 - fx ELSE fx END)) AS v FROM {at} g CROSS JOIN range(0, 2) t(b) CROSS JOIN range(0, 2) u(a) LEFT JOIN {{p}} s ON s.img = g.img AND s.c = g.c AND s.y = g.y0 + b AND s.x = g.x0 + a GROUP BY 1, 2, 3, 4")


gathered("warp_affine", "real", lambda p: G.warp_affine(p, [[0.75, 0.25, 0.5], [-0.25, 1.0, 1.25]], 6, 9, inverse=True, depth=N.F64), "g.x * -0.25 + g.y * 1.0 + 1.25", "g.x * 0.75 + g.y * 0.25 + 0.5", 6, 9)
gathered("warp_perspective", "real", lambda p: G.warp_perspective(p, [[0.75, 0.25, 0.5], [-0.25, 1.0, 1.25], [0.0625, 0.03125, 1.0]], 6, 9, inverse=True, depth=N.F64), "round_even((g.x * -0.25 + g.y * 1.0 + 1.25) * (1 / (g.x * 0.0625 + g.y * 0.03125 + 1.0)) * 32, 0) / 32", "round_even((g.x * 0.75 + g.y * 0.25 + 0.5) * (1 / (g.x * 0.0625 + g.y * 0.03125 + 1.0)) * 32, 0) / 32", 6, 9)
gathered("warp_polar", "real", lambda p: G.warp_polar(p, 10, 6, (3.5, 3.25), 4.5, depth=N.F64), f"g.x * CAST(0.75 AS DOUBLE) * sin(g.y * {2 * math.pi / 10!r}) + 3.25", f"g.x * CAST(0.75 AS DOUBLE) * cos(g.y * {2 * math.pi / 10!r}) + 3.5", 10, 6)
_MX, _MY = (lambda p: P.grid(5, 6, lambda y, x: x * 1.25 - 0.5)), (lambda p: P.grid(5, 6, lambda y, x: y * 1.5 + x * 0.125))
gathered("remap", "real", lambda p: G.remap(p, L.changed(p, _MX(p), 5, 6), L.changed(p, _MY(p), 5, 6), depth=N.F64), "g.y * 1.5 + g.x * 0.125", "g.x * 1.25 - 0.5", 5, 6)
unary("demosaic", "eight", lambda p: G.demosaic(p, (0, 0)), f"""SELECT img, k AS c, y, x, {u8('''CASE
    WHEN k = 1 THEN CASE WHEN y % 2 = x % 2 THEN cross4 ELSE v END
    WHEN (k = 2 AND y % 2 = 0 AND x % 2 = 0) OR (k = 0 AND y % 2 = 1 AND x % 2 = 1) THEN v
    WHEN (k = 2 AND y % 2 = 0) OR (k = 0 AND y % 2 = 1) THEN across
    WHEN (k = 2 AND x % 2 = 0) OR (k = 0 AND x % 2 = 1) THEN down ELSE corners END''')} AS v FROM (
    SELECT img, c, y, x, sum(s) FILTER (WHERE dy = 0 AND dx = 0) AS v, sum(s) FILTER (WHERE abs(dy) + abs(dx) = 1) / 4 AS cross4, sum(s) FILTER (WHERE abs(dy) + abs(dx) = 2) / 4 AS corners,
        sum(s) FILTER (WHERE dy = 0 AND dx <> 0) / 2 AS across, sum(s) FILTER (WHERE dx = 0 AND dy <> 0) / 2 AS down
    FROM ({around_sql('{p}', _BOX3, P.CONSTANT)}) GROUP BY img, c, y, x) CROSS JOIN range(0, 3) t(k)""")
