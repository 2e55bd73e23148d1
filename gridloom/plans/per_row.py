"""Registered queries of what is made row by row: matrices, shapes, maps and settings, each from its row's own numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import kernels as K
from gridloom.operators import neighbourhood as W
from gridloom.operators import transforms as T
from gridloom.plans import settings as P
from gridloom.plans.fixtures import EIGHT, eight, pixels, pixels_sql

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Each event's numbers: a with fractions, the others whole.
_ROWS = {"id": "event_id", "a": "CAST(value AS DOUBLE)", "b": "CAST(user_id % 97 AS DOUBLE)", "e": "CAST(event_id % 13 AS DOUBLE)", "z": "CAST(event_id % 10 = 0 AS INT)"}
_FROM = f"(SELECT {', '.join(f'{v} AS {k}' for k, v in _ROWS.items())} FROM events)"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{v} AS {k}" for k, v in _ROWS.items()])


def listed(name: str, values: Callable[..., Column], *cells: str, inner: str = "") -> None:
    """A query of (id, i, v): the entries of the array made of a row's a, b, e and z, to six places. `cells` says them in SQL, over `inner` if that is given."""
    QUERIES[name] = lambda spark, d: numbers(spark, d).select("id", values(*map(F.col, "abez")).alias("_v")).select("id", F.posexplode("_v").alias("i", "v")).select("id", "i", (F.round("v", 6) + 0.0).alias("v"))
    SQL[name] = f"SELECT id, CAST(i AS INTEGER) AS i, round(CAST(v AS DOUBLE), 6) + 0.0 AS v FROM (SELECT id, unnest(range(0, {len(cells)})) AS i, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in cells)}]) AS v FROM {inner or _FROM})"


# a turn of e degrees and half b's scale about (b, e)
listed("rotation_matrix", lambda a, b, e, z: T.rotation_matrix((b, e), e, b / 2), "k", "s", "(1 - k) * b - s * e", "-s", "k", "s * b + (1 - k) * e", inner=f"(SELECT *, b / 2 * cos(radians(e)) AS k, b / 2 * sin(radians(e)) AS s FROM {_FROM})")
# three points and where a known map takes them; in every tenth row they lie on a line


def _affine(a: Column, b: Column, e: Column, z: Column) -> Column:
    three = [(a, b), (a + 4, b + 1), (a + F.when(z == 1, 8).otherwise(2), b + F.when(z == 1, 2).otherwise(5))]
    return T.affine_from_points(three, [((e + 1) * x + 2 * y + a, 0.5 * x + (b - 3) * y + 7) for x, y in three])


listed("affine_from_points", _affine, *[f"CASE WHEN z = 1 THEN 0 ELSE {v} END" for v in ("e + 1", "2", "a", "0.5", "b - 3", "7")])
# the determinant is (e + sqrt(2)) (b + 1) - 1, or 0 in every tenth row; no value is a tie of the rounding
_INV = lambda v: f"CASE WHEN z = 1 THEN 0 ELSE ({v}) / ((e + sqrt(2)) * (b + 1) - 1) END"
listed("invert_affine", lambda a, b, e, z: T.invert_affine(F.array(e + F.sqrt(F.lit(2.0)), F.when(z == 1, (e + F.sqrt(F.lit(2.0))) * (b + 1)).otherwise(1.0), a, F.lit(1.0), b + 1, e)), _INV("b + 1"), _INV("-1"), _INV("e - a * (b + 1)"), _INV("-1"), _INV("e + sqrt(2)"), _INV("a - e * (e + sqrt(2))"))

def _perspective(a: Column, b: Column, e: Column, z: Column) -> Column:
    four = [(F.lit(0.0), F.lit(0.0)), (e + 1, F.lit(0.0)), (F.lit(1.0), b + 2), (e + 3, b + 5)]
    h = [e + 1, F.lit(2.0), a, F.lit(0.5), b + 3, F.lit(7.0), F.lit(0.01), F.lit(0.02)]
    at = lambda x, y: h[6] * x + h[7] * y + 1
    return T.perspective_from_points(four, [((h[0] * x + h[1] * y + h[2]) / at(x, y), (h[3] * x + h[4] * y + h[5]) / at(x, y)) for x, y in four])


# zeros where the four target points lie on a line: the map's determinant is 0, else 0.0001 or more for a with two decimals
_LINE = "abs((e + 1) * (b + 2.86) - 0.86 - 0.01 * a * (b + 2)) < 1e-9"
listed("perspective_from_points", _perspective, *[f"CASE WHEN {_LINE} THEN 0 ELSE {v} END" for v in ("e + 1", "2", "a", "0.5", "b + 3", "7", "0.01", "0.02", "1")])
_VECTOR = lambda b, e: F.array(e / 13, b / 97 - 0.5, F.lit(0.25))
_TURN = f"(SELECT *, cos(t) AS c, sin(t) AS s, p / t AS x, q / t AS y, 0.25 / t AS w FROM (SELECT *, sqrt(p * p + q * q + 0.0625) AS t FROM (SELECT *, e / 13 AS p, b / 97 - 0.5 AS q FROM {_FROM})))"
listed("rodrigues", lambda a, b, e, z: T.rodrigues(_VECTOR(b, e)), "c + (1 - c) * x * x", "(1 - c) * x * y - s * w", "(1 - c) * x * w + s * y", "(1 - c) * x * y + s * w", "c + (1 - c) * y * y", "(1 - c) * y * w - s * x", "(1 - c) * x * w - s * y", "(1 - c) * y * w + s * x", "c + (1 - c) * w * w", inner=_TURN)
# the vector of its own matrix, which a scale doesn't change
listed("rotation_vector", lambda a, b, e, z: T.rotation_vector(F.transform(T.rodrigues(_VECTOR(b, e)), lambda v: v * 3)), "e / 13", "b / 97 - 0.5", "0.25")
listed("default_new_camera_matrix", lambda a, b, e, z: T.default_new_camera_matrix(F.array(a, F.lit(0.0), b, F.lit(0.0), a + 1, e, F.lit(0.0), F.lit(0.0), F.lit(1.0)), b + 2, e + 2, z == 0), "a", "0", "CASE WHEN z = 0 THEN (b + 1) / 2 ELSE b END", "0", "a + 1", "CASE WHEN z = 0 THEN (e + 1) / 2 ELSE e END", "0", "0", "1")
listed("font_scale", lambda a, b, e, z: F.array(*[T.font_scale(F.lit(k), b + 1, e) for k in range(8)]), *[f"(b + 1 - (e + 1) / 2) / { {1: 9, 5: 13}.get(k, 21)}" for k in range(8)])
# (x - e - 1)(x - b)(x + a + 3), or x^2 + (e + 1)^2 in every tenth row
listed(
    "solve_poly",
    lambda a, b, e, z: F.flatten(F.transform(T.solve_poly(F.when(z == 1, F.array((e + 1) * (e + 1), F.lit(0.0), F.lit(1.0))).otherwise(F.array((e + 1) * (b + 20) * (a + 3), (e + 1) * (b + 20) - (a + 3) * (e + 1 + b + 20), a + 3 - (e + 1) - (b + 20), F.lit(1.0)))), lambda r: F.array(F.round(r["re"], 4), F.round(r["im"], 4)))),
    "1",
)
SQL["solve_poly"] = f"SELECT id, CAST(unnest(range(0, len(v))) AS INTEGER) AS i, round(unnest(v), 4) + 0.0 AS v FROM (SELECT id, CASE WHEN z = 1 THEN [0, -(e + 1), 0, e + 1] ELSE [-(a + 3), 0, e + 1, 0, b + 20, 0] END AS v FROM {_FROM})"
_OVERLAP = "greatest(0, least(10, {x} + 8) - {x}) * greatest(0, least(10, {y} + 5) - {y})"
_box = lambda x, y, w, h: F.array(*[F.struct(p.cast("double").alias("x"), q.cast("double").alias("y")) for p, q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
listed("intersect_convex", lambda a, b, e, z: F.array(T.intersect_convex(_box(F.lit(0), F.lit(0), 10, 10), _box(F.pmod(b, F.lit(12)), e, 8, 5))["area"]), _OVERLAP.format(x="(b % 12)", y="e"))
_TURNED = "greatest(0, least(7, k + 1) - greatest(3, k - 1)) * greatest(0, least(7, l + 2) - greatest(3, l - 2))"


def _rectangles(a: Column, b: Column, e: Column, z: Column) -> Column:
    common = T.intersect_convex(T.corners((F.lit(5.0), F.lit(5.0)), (F.lit(4.0), F.lit(4.0)), F.lit(0.0)), T.corners((F.pmod(b, F.lit(11)), e), (F.lit(4.0), F.lit(2.0)), F.lit(90.0)))
    return F.transform(F.array(common), lambda r: F.round(r["area"], 6))


listed("rotated_rectangle_intersection", _rectangles, _TURNED, inner=f"(SELECT *, b % 11 AS k, e AS l FROM {_FROM})")

def _ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e = F.col("b"), F.col("e")
    points = T.ellipse_points((b, e), (e + 4, b + 20), e * 7, F.lit(0), F.lit(360), F.lit(37))
    return numbers(spark, sf_dir).select("id", F.posexplode(points).alias("i", "p")).select("id", "i", "p.x", "p.y")


QUERIES["ellipse_points"] = _ellipses
_SPOT = "(SELECT id, k, CAST(round_even(b + (e + 4) * cos(t) * cos(w) - (b + 20) * sin(t) * sin(w), 0) AS BIGINT) AS x, CAST(round_even(e + (e + 4) * cos(t) * sin(w) + (b + 20) * sin(t) * cos(w), 0) AS BIGINT) AS y FROM (SELECT *, radians(least(360, k * 37)) AS t, radians(e * 7) AS w FROM (SELECT *, unnest(range(0, 11)) AS k FROM " + _FROM + ")))"
SQL["ellipse_points"] = f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS i, x, y FROM (SELECT *, lag((x, y)) OVER (PARTITION BY id ORDER BY k) AS before FROM {_SPOT}) WHERE before IS NULL OR before <> (x, y)"



def _finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's account as two finds of a picture of 20 customers: one at a place of its own, one beside it by the balance."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    near = F.floor(F.abs("c_acctbal")) % 6
    both = F.posexplode(F.array(F.lit(0).cast("long"), near)).alias("second", "off")
    return rows.select("c_custkey", both).select(
        F.floor(F.col("c_custkey") / 20).alias("set_id"), (F.col("c_custkey") * 2 + F.col("second")).alias("pos"),
        (F.col("c_custkey") % 20 * 100 + F.col("off")).cast("double").alias("x"), F.col("off").cast("double").alias("y"), F.lit(10.0).alias("width"), (F.lit(10.0) + F.col("off")).alias("height"),
    )


QUERIES["group_rectangles"] = lambda spark, d: T.group_rectangles(_finds(spark, d), 0.3).select("set_id", "x", "y", "width", "height")
# similar up to 0.3 (10 + 10) / 2 = 3, for the far ends too, where the offset counts twice
_SIMILAR = "off * 2 <= 0.3 * (10 + 10) / 2"
SQL["group_rectangles"] = f"""WITH f AS (SELECT c_custkey // 20 AS set_id, c_custkey % 20 * 100 AS x, CAST(floor(abs(c_acctbal)) AS BIGINT) % 6 AS off FROM customer)
SELECT CAST(set_id AS BIGINT) AS set_id, CAST(round_even(x + off / 2, 0) AS BIGINT) AS x, CAST(round_even(off / 2, 0) AS BIGINT) AS y, CAST(10 AS BIGINT) AS width, CAST(round_even(10 + off / 2, 0) AS BIGINT) AS height FROM f WHERE {_SIMILAR}
UNION ALL SELECT set_id, x + k * off, k * off, 10, 10 + k * off FROM f CROSS JOIN range(0, 2) t(k) WHERE NOT {_SIMILAR}"""

# windows of each part's size, maps of each supplier's camera
QUERIES["hanning_window"] = lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.posexplode(T.hanning_window(F.col("p_size") % 5 + 2, F.col("p_size") % 7 + 2)).alias("i", "v")).select("p_partkey", "i", (F.round("v", 6) + 0.0).alias("v"))
SQL["hanning_window"] = "SELECT p_partkey, CAST(i AS INTEGER) AS i, round(sqrt(sin(pi() * (i // c) / (r - 1)) * sin(pi() * (i // c) / (r - 1)) * sin(pi() * (i % c) / (c - 1)) * sin(pi() * (i % c) / (c - 1))), 6) + 0.0 AS v FROM (SELECT *, unnest(range(0, r * c)) AS i FROM (SELECT p_partkey, p_size % 5 + 2 AS r, p_size % 7 + 2 AS c FROM part))"
_LENS = {"id": "s_suppkey", "fx": "6.0D + s_nationkey % 5", "fy": "5.5D + s_nationkey % 3", "cx": "3.5D", "cy": "3.25D", "k": "sqrt(abs(CAST(s_acctbal AS DOUBLE)) + 0.123457) / 1000"}


def _cameras(spark: SparkSession, sf_dir: str, lens: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*[f"{v} AS {k}" for k, v in _LENS.items()]).withColumn("d", F.expr(lens))


def _mapped(df: DataFrame) -> DataFrame:
    return df.select("id", "y", "x", *[(F.round(c, 6) + 0.0).alias(c) for c in ("map_x", "map_y")])


QUERIES["undistort_map"] = lambda spark, d: _mapped(T.undistort_maps(_cameras(spark, d, "array(k, -0.01D, 0.002D, -0.001D)"), 8, 8))
QUERIES["fisheye_undistort_map"] = lambda spark, d: _mapped(T.undistort_maps(_cameras(spark, d, "array(0.01D, k)"), 8, 8, fisheye=True))
_RAYS = f"(SELECT *, (i - cx) / fx AS x, (j - cy) / fy AS y FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _LENS.items())} FROM supplier) CROSS JOIN range(0, 8) s(j) CROSS JOIN range(0, 8) t(i))".replace("0D", "0::DOUBLE").replace("5D", "5::DOUBLE")
_BENT = "SELECT id, CAST(j AS INTEGER) AS y, CAST(i AS INTEGER) AS x, round(({u}) * fx + cx, 6) + 0.0 AS map_x, round(({v}) * fy + cy, 6) + 0.0 AS map_y FROM (SELECT *, {s} AS s FROM (SELECT *, x * x + y * y AS r FROM " + _RAYS + "))"
SQL["undistort_map"] = _BENT.format(s="1 + r * (k - 0.01::DOUBLE * r)", u="x * s + 0.004::DOUBLE * x * y - 0.001::DOUBLE * (r + 2 * x * x)", v="y * s + 0.002::DOUBLE * (r + 2 * y * y) - 0.002::DOUBLE * x * y")
SQL["fisheye_undistort_map"] = _BENT.format(s="atan(sqrt(r)) / sqrt(r) * (1 + 0.01::DOUBLE * pow(atan(sqrt(r)), 2) + k * pow(atan(sqrt(r)), 4))", u="x * s", v="y * s")

# elements at work on every plane
_SHAPES = {"rect": "true", "cross": "j = 2 OR i = 2", "ellipse": "abs(i - 2) <= round_even(2 * sqrt(1 - (j - 2) * (j - 2) / 4.0), 0)", "diamond": "abs(i - 2) + abs(j - 2) <= 2"}
for _kind, _where in _SHAPES.items():
    QUERIES[f"structuring_element_{_kind}"] = lambda spark, d, k=_kind: pixels(W.dilate(eight(spark, d), K.structuring_element(k, 5, 5).tolist()))
    SQL[f"structuring_element_{_kind}"] = pixels_sql(f"SELECT q.img, q.c, q.y, q.x, max(s.v) AS v FROM ({EIGHT}) q JOIN (SELECT j - 2 AS dy, i - 2 AS dx FROM range(0, 5) a(j) CROSS JOIN range(0, 5) b(i) WHERE {_where}) t ON true JOIN ({EIGHT}) s ON s.img = q.img AND s.y = q.y + dy AND s.x = q.x + dx GROUP BY 1, 2, 3, 4")

#: Every setting with its default; typed here, not taken from the classes.
_SETTINGS = {
    "akaze": (P.AKAZE, "AKAZE", "descriptor_type 5, descriptor_size 0, descriptor_channels 3, threshold 0.001, octaves 4, octave_layers 4, diffusivity 1"),
    "kaze": (P.KAZE, "KAZE", "extended False, upright False, threshold 0.001, octaves 4, octave_layers 4, diffusivity 1"),
    "mser": (P.MSER, "MSER", "delta 5, min_area 60, max_area 14400, pass_2_only False"),
    "orb": (P.ORB, "ORB", "max_features 500, scale_factor 1.2, levels 8, edge_threshold 31, first_level 0, wta_k 2, score_type 0, patch_size 31, fast_threshold 20"),
    "agast": (P.Agast, "AgastFeatureDetector", "threshold 10, nonmax_suppression True, kind 3"),
    "fast": (P.Fast, "FastFeatureDetector", "threshold 10, nonmax_suppression True, kind 2"),
    "good_features": (P.GoodFeatures, "GFTTDetector", "max_features 1000, quality_level 0.01, min_distance 1.0, block_size 3, harris_detector False, k 0.04"),
    "clahe": (P.Clahe, None, "clip_limit 40.0"),
    "tonemap": (P.Tonemap, None, "gamma 1.0"),
    "tonemap_drago": (P.TonemapDrago, None, "gamma 1.0, saturation 1.0, bias 0.85"),
    "tonemap_mantiuk": (P.TonemapMantiuk, None, "gamma 1.0, scale 0.7, saturation 1.0"),
    "tonemap_reinhard": (P.TonemapReinhard, None, "gamma 1.0, intensity 0.0, light_adaptation 1.0, color_adaptation 0.0"),
}
#: What a part asks for, by kind of setting: nothing in every fourth, counted from another part for each setting.
_ASKED = {"int": "CAST(p_size + {n} AS INT)", "float": "CAST(p_retailprice AS DOUBLE) / 1024 + {n}", "bool": "p_size % 2 = {n} % 2"}


def _asked(fields: str) -> dict[str, tuple[str, str]]:
    """For each setting what is asked, and its default in SQL."""
    out = {}
    for n, (field, first) in enumerate(f.split() for f in fields.split(", ")):
        kind = "bool" if first in ("True", "False") else "float" if "." in first else "int"
        default = first.lower() if kind == "bool" else f"CAST({first} AS {'DOUBLE' if kind == 'float' else 'INT'})"
        out[field] = f"CASE WHEN (p_partkey + {n}) % 4 > 0 THEN {_ASKED[kind].format(n=n)} END", default
    return out


def _settings(spark: SparkSession, sf_dir: str, made: type, named: str | None, fields: str) -> DataFrame:
    asked = _asked(fields)
    rows = P.configured(spark.read.parquet(f"{sf_dir}/part.parquet"), made, **{f: F.expr(v) for f, (v, _) in asked.items()})
    name = [F.lit(made().default_name).alias("default_name")] if named else []
    return rows.select("p_partkey", *name, *[F.col(f"settings.{f}") for f in asked])


for _name, (_made, _default, _fields) in _SETTINGS.items():
    QUERIES[f"settings_{_name}"] = lambda spark, d, m=_made, n=_default, f=_fields: _settings(spark, d, m, n, f)
    _own = f"'Feature2D.{_default}' AS default_name, " if _default else ""
    SQL[f"settings_{_name}"] = f"SELECT p_partkey, {_own}{', '.join(f'coalesce({v}, {w}) AS {f}' for f, (v, w) in _asked(_fields).items())} FROM part"
