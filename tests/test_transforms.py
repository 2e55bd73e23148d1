"""What is made row by row, against the functions of single values; degenerate, null and missing rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import calibration as C
from gridloom.operators import drawing as W
from gridloom.operators import geometry as G
from gridloom.operators import linear as N
from gridloom.operators import resampling as S
from gridloom.operators import transforms as T
from gridloom.plans import settings as P


def spots(names):
    return [(F.col(f"{n}x"), F.col(f"{n}y")) for n in names]


def of(spark, values, make):
    """make's array for each list of numbers, whose columns are v0, v1 ..."""
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(values)], "k int, v array<double>")
    wide = df.select("k", *[F.get("v", F.lit(n)).alias(f"v{n}") for n in range(len(values[0]))])
    return [r["m"] for r in wide.select("k", make(*[F.col(f"v{n}") for n in range(len(values[0]))]).alias("m")).orderBy("k").collect()]


def test_rotation_and_affine_matrices(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 12)) * 5
    for got, r in zip(of(spark, v[:, :4], lambda x, y, t, s: T.rotation_matrix((x, y), t, s)), v, strict=True):
        assert np.allclose(got, S.rotation_matrix((r[0], r[1]), r[2], r[3]).ravel())
    v[3, 4:6] = 2 * v[3, 2:4] - v[3, :2]
    v[4, 0], v[5, 11] = math.inf, math.nan
    made = of(spark, v, lambda *c: T.affine_from_points([(c[0], c[1]), (c[2], c[3]), (c[4], c[5])], [(c[6], c[7]), (c[8], c[9]), (c[10], c[11])]))
    for got, r in zip(made, v, strict=True):
        assert np.allclose(got, S.affine_from_points(r[:6].reshape(3, 2), r[6:].reshape(3, 2)).ravel(), equal_nan=True)
    assert made[3] == [0.0] * 6 and all(map(math.isnan, made[4] + made[5]))
    m = np.vstack([v[6:, :6], [[2, 1, 5, 4, 2, 7]]])
    for got, r in zip(of(spark, m, lambda *c: T.invert_affine(F.array(*c))), m, strict=True):
        assert np.allclose(got, S.invert_affine(r.reshape(2, 3)).ravel())


def test_perspective_matrices(spark):
    v = np.random.default_rng(2).normal(size=(12, 16)) * 5
    v[3, 2:8] = [v[3, 0], v[3, 1]] * 3
    v[4, 7] = math.inf
    pair = lambda c, k: [(c[k + 2 * n], c[k + 2 * n + 1]) for n in range(4)]
    made = of(spark, v, lambda *c: T.perspective_from_points(pair(c, 0), pair(c, 8)))
    for k, (got, r) in enumerate(zip(made, v, strict=True)):
        want = S.perspective_from_points(r[:8].reshape(4, 2), r[8:].reshape(4, 2)).ravel()
        assert len(got) == 9
        if k != 3:
            assert np.allclose(got, want, rtol=1e-6, equal_nan=True)
    assert all(map(math.isnan, made[4])) and np.isfinite(made[3]).all()


def test_points_that_do_not_determine_a_perspective_matrix_give_zeros(spark):
    square, odd = [0, 0, 4, 0, 0, 3, 5, 7], [1, 2, 6, 1, 2, 9, 8, 7]
    line, three = [1, 2, 3, 3, 5, 4, 9, 6], [0, 0, 1, 0, 3, 0, 2, 5]
    twice = [0, 0, 0, 0, 1, 5, 6, 2]
    rows = [square + line, line + odd, [2, 2] * 4 + odd, square + [2, 2] * 4, three + three, twice + odd]
    rows += [square + odd, three + odd, square + three]  # these have one matrix, up to its size
    pair = lambda c, k: [(c[k + 2 * n], c[k + 2 * n + 1]) for n in range(4)]
    made = of(spark, rows, lambda *c: T.perspective_from_points(pair(c, 0), pair(c, 8)))
    assert made[:6] == [[0.0] * 9] * 6 and all(any(m) for m in made[6:])
    for got, r in zip(made, rows, strict=True):
        assert np.allclose(got, S.perspective_from_points(np.reshape(r[:8], (4, 2)), np.reshape(r[8:], (4, 2))).ravel())


def test_perspective_query_on_target_points_on_a_line(spark, tmp_path):
    import duckdb

    from gridloom.plans.per_row import QUERIES, SQL

    # (event_id, user_id, value): the map's determinant is 0 in the first five rows, 0.0001 or more in size in the others
    rows = [(13, 0, 100.0), (26, 41, 100.0), (14, 41, 202.0), (27, 84, 201.0), (40, 0, 243.0), (53, 41, 202.01), (65, 5, 99.99), (66, 5, 17.25), (15, 47, 303.51)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["perspective_from_points"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(base.execute(SQL["perspective_from_points"]).fetchall())
    assert {r[0] for r in got if r[2] == 0} == {13, 26, 14, 27, 40}


def test_rotations(spark):
    v = [*np.random.default_rng(3).normal(size=(15, 3)), np.zeros(3), np.array([1e-15, 0, 0])]
    for got, r in zip(of(spark, v, lambda *c: T.rodrigues(F.array(*c))), v, strict=True):
        assert np.allclose(got, C.rodrigues(r).ravel())
    for got, r in zip(of(spark, v, lambda *c: T.rotation_vector(T.rodrigues(F.array(*c)))), v, strict=True):
        assert np.allclose(got, C.rotation_vector(C.rodrigues(r)), atol=1e-9)


def test_maps_are_those_of_one_camera(spark):
    camera, d = np.array([[6.0, 0, 3.5], [0, 5.5, 3.0], [0, 0, 1]]), [0.05, -0.01, 0.002, -0.001]
    cameras = spark.createDataFrame([(7, 6.0, 5.5, 3.5, 3.0, d), (8, 6.0, 5.5, 3.5, 3.0, d[:1]), (9, 6.0, 5.5, 3.5, 3.0, None)], "id int, fx double, fy double, cx double, cy double, d array<double>")
    for fisheye in (False, True):
        got = {(r.id, r.y, r.x): (r.map_x, r.map_y) for r in T.undistort_maps(cameras, 5, 6, fisheye).collect()}
        assert len(got) == 90
        for k, bend in ((7, d), (8, [d[0], 0, 0, 0]), (9, [0, 0, 0, 0])):
            for r in C.undistort_map(spark, camera, bend, 5, 6, new_camera=camera, fisheye=fisheye).collect():
                assert got[k, r.y, r.x] == pytest.approx((r.map_x, r.map_y))


def test_shapes(spark):
    rows = [(10, 10, 5, 3, 0, 0, 360, 90), (3, 4, 6, 2, 30, 10, 200, 7), (0, 0, 0, 0, 0, 0, 10, 5), (1, 2, 4, 4, 0, 0, 100, 300)]
    for got, r in zip(of(spark, rows, lambda x, y, a, b, *t: T.ellipse_points((x, y), (a, b), *t)), rows, strict=True):
        assert [(p.x, p.y) for p in got] == W.ellipse_points(r[:2], r[2:4], *r[4:])
    box = lambda c: T.corners((c[0], c[1]), (c[2], c[3]), c[4])
    rows = np.random.default_rng(4).uniform(1, 6, size=(20, 10)) * ([1] * 4 + [30] + [1] * 4 + [30])
    for got, r in zip(of(spark, rows, lambda *c: T.intersect_convex(box(c[:5]), box(c[5:]))), rows, strict=True):
        area, corners = G.intersect_convex(G.rectangle_corners(*r[:5]), G.rectangle_corners(*r[5:]))
        assert got.area == pytest.approx(area) and len(got.corners) == len(corners)
    none = spark.range(1).select(T.intersect_convex(F.lit(None).cast("array<struct<x:double,y:double>>"), T.corners((F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(1.0)), F.lit(0.0))).alias("m")).first()["m"]
    assert (none.area, none.corners) == (0.0, [])


def test_windows_roots_and_fonts(spark):
    assert of(spark, [(1, 4), (3, 3)], lambda r, c: T.hanning_window(r.cast("int"), c.cast("int")))[0] is None
    assert of(spark, [(3, 3)], lambda r, c: T.hanning_window(r.cast("int"), c.cast("int")))[0] == pytest.approx([0, 0, 0, 0, 1, 0, 0, 0, 0], abs=1e-12)
    roots = of(spark, [(-6, 11, -6, 1), (1, 0, 1, 0)], lambda *c: T.solve_poly(F.array(*c)))
    assert [[(round(z.re, 6) + 0.0, round(z.im, 6)) for z in r] for r in roots] == [[(1, 0), (2, 0), (3, 0)], [(0, -1), (0, 1)]]
    assert of(spark, [(0, 30, 3), (17, 11, 1), (5, 14, -9), (8, 9, 1), (-1, 9, 1)], lambda f, p, t: T.font_scale(f.cast("int"), p, t)) == [28 / 21, 10 / 9, 14 / 13, None, None]
    assert N.font_scale(21, 14, -9) == 14 / 13
    assert spark.range(1).select(T.solve_poly(F.lit(None).cast("array<double>")).alias("m"), T.rotation_vector(F.lit(None).cast("array<double>")).alias("n")).first() == (None, None)


def test_groups(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 1, 1, 10, 10), (1, 2, 50, 50, 8, 8), (2, 0, 5, 5, 5, 5)], "set_id int, pos int, x double, y double, width double, height double".replace("double", "int"))
    got = T.group_rectangles(rows, 0.3)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 0, 10, 10), (1, 1, 50, 50, 8, 8), (2, 0, 5, 5, 5, 5)]
    assert T.group_rectangles(rows.where("set_id > 2")).count() == 0


def test_settings_by_row(spark):
    rows = spark.createDataFrame([(0, 3, None, 0.5), (1, None, True, None)], "k int, layers int, upright boolean, level double")
    got = P.configured(rows, P.KAZE, octave_layers=F.col("layers"), upright=F.col("upright"), threshold=F.col("level")).orderBy("k")
    want = [P.KAZE(octave_layers=3, threshold=0.5).options(), P.KAZE(upright=True).options()]
    assert [r["settings"].asDict() for r in got.collect()] == want
    assert P.configured(rows, P.Clahe).first()["settings"].tiles == [8, 8]
    with pytest.raises(ValueError):
        P.configured(rows, P.KAZE, colour=F.col("k"))
    with pytest.raises(ValueError):
        P.KAZE(octaves=0)
    with pytest.raises(Exception, match="KAZE.octaves is at least 1"):
        P.configured(rows, P.KAZE, octaves=F.col("k")).collect()
