"""Values worked out by hand, depths and edges that the registered queries don't reach."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import planes as P
from gridloom.operators import arithmetic as A
from gridloom.operators import calibration as C
from gridloom.operators import geometry as G
from gridloom.operators import kernels as K
from gridloom.operators import linear as L
from gridloom.operators import neighbourhood as W
from gridloom.operators import noise as Z
from gridloom.operators import reductions as R
from gridloom.operators import resampling as S
from gridloom.operators import selection as E
from gridloom.plans import settings as O
from gridloom.sources import images as I
from gridloom.streaming import tracking as T


def plane(spark, rows, img=0, c=0):
    a = np.array(rows, float)
    return spark.createDataFrame([(img, c, a.shape[0], a.shape[1], a.ravel().tolist())], I.PLANE)


def values(df):
    r = df.first()
    return np.array(r["data"]).reshape(r["rows"], r["cols"])


@pytest.mark.parametrize(
    ("v", "depth", "rule", "want"),
    [(float("inf"), N.U8, "generic", 0), (float("inf"), N.U8, "numeric", 255), (float("nan"), N.U8, "numeric", 0), (2.5, N.U8, "generic", 2), (3.5, N.U8, "generic", 4), (-3.0, N.U8, "generic", 0), (300.0, N.I16, "generic", 300), (40000.0, N.I16, "numeric", 32767), (2.0**31, N.I32, "wrap", -(2**31)), (2.0**32 + 5, N.I32, "wrap", 5), (2.0**31, N.I32, "sentinel", -(2**31)), (2.5, N.U8, "away", 3)],
)
def test_saturation(spark, v, depth, rule, want):
    assert spark.range(1).select(N.saturate(F.lit(v), depth, rule)).first()[0] == want


def test_numeric_goldens(spark):
    assert values(A.multiply(plane(spark, [[200, 4]]), plane(spark, [[2, 3]]))).tolist() == [[255, 12]]
    assert values(A.divide(plane(spark, [[1, 3, -3, 8]]), plane(spark, [[2, 2, 2, 0]]), depth=N.I16)).tolist() == [[0, 2, -2, 0]]
    assert values(A.add_weighted(plane(spark, [[-30, 30]]), 0.5, plane(spark, [[10, 10]]), 2, 1, N.I16)).tolist() == [[6, 36]]
    assert values(A.multiply(plane(spark, [[2147483647, 50000]]), plane(spark, [[2, 50000]]), depth=N.I32)).tolist() == [[-2, -1794967296]]
    assert values(A.convert_scale_abs(plane(spark, [[-10]]), 2, 5)).tolist() == [[15]]


def test_ieee_edges(spark):
    inf, nan = float("inf"), float("nan")
    assert values(A.divide(plane(spark, [[1.0, -1.0]]), plane(spark, [[0.0, 0.0]]), depth=N.F64)).tolist() == [[inf, -inf]]
    assert np.isnan(values(A.log(plane(spark, [[-1.0]])))).all()
    assert values(A.maximum(plane(spark, [[nan, 1]]), plane(spark, [[2, nan]]))).tolist() == [[2, 1]]
    assert values(E.compare(plane(spark, [[nan]]), plane(spark, [[nan]]), E.EQ)).tolist() == [[0]]
    assert values(E.compare(plane(spark, [[nan]]), plane(spark, [[nan]]), E.NE)).tolist() == [[255]]


def test_bits_of_floats(spark):
    a = plane(spark, [[1.5, -2.0]])
    assert values(A.bitwise_xor(a, a, N.F64)).tolist() == [[0, 0]]
    assert values(A.bitwise_not(A.bitwise_not(a, N.F64), N.F64)).tolist() == [[1.5, -2.0]]


@settings(max_examples=60, deadline=None)
@given(st.integers(-40, 40), st.integers(1, 9), st.sampled_from([P.REPLICATE, P.REFLECT, P.WRAP, P.REFLECT_101]))
def test_border_places(p, n, border):
    mode = {P.REPLICATE: "edge", P.REFLECT: "symmetric", P.WRAP: "wrap", P.REFLECT_101: "reflect"}[border]
    padded = np.pad(np.arange(n), 40, mode=mode) if n > 1 or border != P.REFLECT_101 else np.zeros(81, int)
    assert P.border_place(p, n, border) == padded[p + 40] or p >= n + 40


def test_gaussian_matches_numpy(spark):
    a = np.arange(35.0).reshape(5, 7) ** 1.5
    k = np.outer(W.gaussian_kernel(3, 0.9), W.gaussian_kernel(5, 0.9))
    p = np.pad(a, ((1, 1), (2, 2)), mode="reflect")
    want = sum(k[i, j] * p[i : i + 5, j : j + 7] for i in range(3) for j in range(5))
    assert np.allclose(values(W.gaussian_blur(plane(spark, a), 3, 5, 0.9, depth=N.F64)), want)


def brute_stream(seed):
    """The generator one number after another."""
    mask = (1 << 64) - 1
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        yield z ^ (z >> 31)


def test_random_stream(spark):
    assert [hex(int(v)) for v in Z.drawn(0, np.arange(2))] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4"]
    sizes = {5: (2, 3, 2), -1: (1, 1, 1), 9: (4, 2, 3), 6: (3, 3, 1)}
    rows = [(img, c, h, w, [0.0] * (h * w)) for img, (h, w, n) in sizes.items() for c in range(n)]
    planes = spark.createDataFrame(rows, "img long, c int, rows int, cols int, data array<double>").repartition(5)
    for seed, skip in ((7, 0), (2**64 - 1, 3)):
        stream = brute_stream(seed)
        numbers = [next(stream) for _ in range(skip + 100)]
        got = {(r.img, r.c): r.data for r in Z.randu(planes, [2, 200, 0], [7, 205, 1], seed, N.U8, skip).collect()}
        at = skip
        for img in sorted(sizes):
            h, w, n = sizes[img]
            for p in range(h * w):
                for c in range(n):
                    low, high = ((2, 7), (200, 205), (0, 1))[c]
                    u = (numbers[at] >> 11) / 2**53
                    assert got[img, c][p] == math.floor(low * (1 - u) + high * u)
                    at += 1
    pairs, stream = [], brute_stream(9)
    for _ in range(40):
        a, b = next(stream), next(stream)
        radius, angle = math.sqrt(-2 * math.log(((a >> 11) + 0.5) / 2**53)), 2 * math.pi * ((b >> 11) / 2**53)
        pairs += [radius * math.cos(angle), radius * math.sin(angle)]
    got = {(r.img, r.c): r.data for r in Z.randn(planes, 3, 2, 9, skip=1).collect()}
    assert got[-1, 0] == pytest.approx([3 + 2 * pairs[1]]) and got[5, 1] == pytest.approx([3 + 2 * pairs[3 + 2 * p] for p in range(6)])
    assert Z.randu(planes.where("false"), 0, 1).count() == 0
    assert all(r.data == [float(v)] * len(r.data) for r in Z.randn(planes, [2, 200, 9], 0, 7, N.U8).collect() for v in [(2, 200, 9)[r.c]])
    with pytest.raises(ValueError):
        Z.randu(planes, 1, 1)


def test_empty_selection(spark):
    p, none = plane(spark, [[1, 2]]), plane(spark, [[0, 0]])
    assert R.mean(p, none).first()["mean"] == 0
    assert R.min_max_loc(p, none).first()["min_y"] == -1


def test_contour_hierarchy(spark):
    ring = np.zeros((11, 11))
    ring[1:10, 1:10], ring[3:8, 3:8], ring[5, 5] = 255, 0, 255
    rows = K.find_contours(plane(spark, ring), K.TREE).orderBy("contour").collect()
    assert [(r["child"], r["parent"]) for r in rows] == [(1, -1), (2, 0), (-1, 1)]
    assert K.find_contours(plane(spark, ring), K.EXTERNAL).count() == 1
    assert len(rows[0]["points"]) == 4


def test_labels(spark):
    a = [[1, 0, 1], [0, 1, 0], [0, 0, 1]]
    assert values(K.connected_components(plane(spark, a), 8)).max() == 1
    assert values(K.connected_components(plane(spark, a), 4)).max() == 4


def test_chamfer_and_exact(spark):
    a = np.ones((5, 5))
    a[2, 2] = 0
    assert values(K.distance_transform(plane(spark, a)))[0, 0] == pytest.approx(2 * 1.3693)
    assert values(K.distance_transform_with_labels(plane(spark, a)))[0, 0] == pytest.approx(math.sqrt(8))


def test_linear_algebra(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((3, 4)), rng.standard_normal((4, 2))
    assert np.allclose(values(L.gemm(plane(spark, a), plane(spark, b))), a @ b)
    s = a @ a.T
    assert K.determinant(plane(spark, s)).first()["determinant"] == pytest.approx(np.linalg.det(s))
    v, e = K.jacobi(s)
    assert np.allclose(v, np.linalg.eigvalsh(s)[::-1]) and np.allclose(e @ s @ e.T, np.diag(v))
    assert np.allclose(values(L.dft(plane(spark, a))), np.fft.fft2(a).real)
    assert K.optimal_dft_size(7) == 8 and K.optimal_dft_size(-1) == -1
    assert K.structuring_element("cross", 3, 3).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]]


def points(spark, xy, s=0):
    return spark.createDataFrame([(s, k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "set_id long, pos int, x double, y double")


def test_shapes(spark):
    square = points(spark, [(0, 0), (4, 0), (4, 3), (0, 3)])
    assert G.contour_area(square).first()["area"] == 12
    assert G.arc_length(square, True).first()["length"] == 14
    assert G.is_contour_convex(square).first()["convex"]
    assert G.point_polygon_test(square, (1.0, 1.0), True).first()["result"] == 1
    assert G.point_polygon_test(square, (4.0, 1.0)).first()["result"] == 0
    r = G.min_area_rect(square).first()
    assert sorted((r["width"], r["height"])) == pytest.approx([3, 4])
    assert G.min_enclosing_circle(square).first()["radius"] == pytest.approx(2.5)
    assert G.convex_hull(points(spark, [(0, 0), (4, 0), (2, 1), (4, 3), (0, 3)])).count() == 4
    assert G.intersect_convex([(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)])[0] == 1
    assert G.rotated_rectangle_intersection((0, 0, 2, 2, 0), (9, 9, 1, 1, 45)) == (0, [])
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    e = points(spark, [(5 + 4 * math.cos(a), 3 + 2 * math.sin(a)) for a in t])
    for direct in (False, True):
        f = G.fit_ellipse(e, direct).first()
        assert (f["x"], f["y"], f["width"], f["height"]) == pytest.approx((5, 3, 4, 8), abs=1e-6)


def test_cameras(spark):
    r = np.array([0.3, -0.2, 0.5])
    assert np.allclose(C.rotation_vector(C.rodrigues(r)), r)
    h = np.array([[1.1, 0.1, 3], [-0.05, 0.9, 2], [0.001, 0.002, 1]])
    xy = np.random.default_rng(2).uniform(0, 50, (12, 2))
    q = np.column_stack([xy, np.ones(12)]) @ h.T
    q = q[:, :2] / q[:, 2:]
    q[0] += 40
    rows = spark.createDataFrame([(0, k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(xy, q, strict=True))], "set_id long, pos int, x double, y double, u double, v double")
    found = C.find_homography(rows, "ransac").first()
    assert np.allclose(np.array(found["matrix"]).reshape(3, 3), h, atol=1e-6) and found["inliers"].count(False) == 1
    assert S.perspective_from_points([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0), (2, 2), (0, 2)]) == pytest.approx(np.diag([2, 2, 1]))


def test_resize_keeps_constants(spark):
    p = plane(spark, np.full((5, 6), 7.0))
    for mode in range(5):
        assert np.allclose(values(S.resize(p, (5, 6), (3, 11), mode, N.F64)), 7)


def test_roi_outside_raises(spark):
    with pytest.raises(Exception, match="leaves the image"):
        I.roi(plane(spark, [[1, 2]]), 0, 1, 1, 2).collect()


def test_mean_shift_finds_the_mass():
    a = np.zeros((20, 20))
    a[12:16, 11:15] = 1
    x, y, w, h = T.mean_shift(a, (7, 8, 6, 6))[1]
    assert a[y : y + h, x : x + w].sum() == 16 and T.mean_shift(a, (x, y, w, h))[1] == (x, y, w, h)
    assert T.mean_shift(np.zeros((9, 9)), (2, 2, 3, 3)) == (0, (2, 2, 3, 3))


def test_tracking_stream(spark, tmp_path):
    frames, want, rect = [], [], (3, 1, 4, 6)
    for k in range(4):
        a = np.zeros((24, 16))
        a[2 + 3 * k : 6 + 3 * k, 3:7] = 1
        frames.append((1, k, 24, 16, a.ravel().tolist()))
        rect = T.mean_shift(a, rect)[1]
        want.append(rect[1])
    schema = "track long, frame long, rows int, cols int, data array<double>"
    spark.createDataFrame(frames, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), (3, 1, 4, 6))
    q = stream.writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("SELECT frame, y FROM tracks ORDER BY frame").collect()
    assert [r["y"] for r in rows] == want and want[-1] > want[0]


def test_settings():
    assert O.ORB().with_(levels=4).levels == 4
    assert O.AKAZE().default_name == "Feature2D.AKAZE"
    with pytest.raises(ValueError, match="octaves"):
        O.KAZE(octaves=0)


def _frame(shape, *pixels):
    out = np.zeros(shape)
    for x, y in pixels:
        out[y, x] = 255
    return out


@pytest.mark.parametrize(
    ("shape", "pixels", "rect", "want"),
    [
        ((20, 20), [], (5, 5, 10, 10), ((0, 0, 0, 0, 0), (0, 0, 20, 20))),
        ((20, 20), [(10, 12)], (5, 5, 10, 10), ((10, 12, 0, 0, 90), (9, 11, 2, 2))),
        ((40, 40), [(20, 18), (20, 22)], (15, 15, 10, 10), ((20, 20, 0, 8, 90), (19, 15, 2, 10))),
        ((20, 20), [(2, 2), (10, 10)], (5, 5, 10, 10), ((9, 9, 0, 22.6274, 135), (0, 0, 18, 18))),
        ((40, 40), [(20, 20), (20, 24), (22, 20)], (18, 18, 4, 4), ((21.5, 21.5, 3.1489808559, 7.8227252960, 16.8450336456), (19, 17, 5, 9))),
        ((40, 40), [], (15, 15, 10, 10), ((0, 0, 0, 0, 0), (5, 5, 30, 30))),
    ],
)
def test_adaptive_window(shape, pixels, rect, want):
    ellipse, window = T.cam_shift(_frame(shape, *pixels), rect)
    keep = [k for k in range(5) if not (k == 4 and len(pixels) == 2 and pixels[0][0] == pixels[1][0])]
    assert np.allclose([ellipse[k] for k in keep], [want[0][k] for k in keep], atol=1e-3) and window == want[1]


def test_mean_shift_counts_passes():
    one = _frame((20, 20), (10, 12))
    assert T.mean_shift(one, (5, 5, 10, 10), 10, 1.0, T.COUNT) == (1, (5, 7, 10, 10))
    assert T.mean_shift(one, (5, 5, 10, 10), 10, 1.0, T.COUNT | T.EPS) == (10, (5, 7, 10, 10))
    assert T.mean_shift(one, (5, 5, 10, 10), 10, 1.0, T.EPS) == (100, (5, 7, 10, 10))
    assert T.mean_shift(one, (5, 5, 10, 10), 10, 3.0) == (0, (5, 5, 10, 10))
    assert T.mean_shift(np.zeros((20, 20)), (15, 15, 10, 10)) == (0, (15, 15, 5, 5))
    assert T.mean_shift(_frame((20, 20), (19, 5)), (12, 0, 10, 10), 10, 0.0, T.COUNT) == (0, (12, 0, 8, 10))


def brute_labels(a, connectivity):
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0) and (connectivity == 8 or 0 in (dy, dx))]
    out, n = np.zeros(a.shape, int), 0
    for at in zip(*np.nonzero(a), strict=True):
        if not out[at]:
            n, todo = n + 1, [at]
            out[at] = n
            while todo:
                y, x = todo.pop()
                for dy, dx in near:
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and a[q] and not out[q]:
                        out[q] = n
                        todo.append(q)
    return out


def test_regions_and_distances_against_brute_force():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (1, 9), (9, 1), (13, 17), (40, 30)):
        for density in (0.0, 0.2, 0.5, 0.8, 1.0):
            a = (rng.random(shape) < density).astype(float)
            for connectivity in (4, 8):
                assert np.array_equal(K.label(a, connectivity), brute_labels(a, connectivity))
            zeros = np.argwhere(a == 0)
            if not len(zeros):
                assert (K.chamfer(a) == 1e30).all()
                continue
            gap = np.abs(np.argwhere(np.ones(shape))[:, None] - zeros[None])
            low, high = gap.min(axis=2), gap.max(axis=2)
            for kind, mask, d in (("l1", 3, low + high), ("c", 3, high), ("l2", 3, 1.3693 * low + 0.955 * (high - low))):
                assert np.allclose(K.chamfer(a, kind, mask).ravel(), d.min(axis=1))
            knight = np.where(high - low >= low, 2.0 * low + high - 2 * low, np.where(2 * low >= high, 0, 0) + (high - low) * 2.0 + (2 * low - high) * 1.4)
            assert np.allclose(K.chamfer(a, "l2", 5).ravel(), np.where(2 * low <= high, low * 2.0 + (high - 2 * low), knight).min(axis=1))


def test_pictures_are_written_and_read(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(7, c, 3, 5, rng.integers(0, 256, 15).astype(float).tolist()) for c in range(3)]
    planes = spark.createDataFrame(rows, I.PLANE)
    (tmp_path / "a.bmp").write_bytes(I.encode_bmp(planes).first().content)
    got = sorted((r.c, r["rows"], r.cols, list(r["data"])) for r in I.read_images(spark, str(tmp_path)).collect())
    assert got == [(c, 3, 5, data) for _, c, _, _, data in rows]


def test_masked_templates(spark):
    rng = np.random.default_rng(8)
    a, t, w = rng.integers(0, 256, (7, 9)).astype(float), rng.integers(0, 256, (3, 2)).astype(float), rng.random((3, 2))
    a[:4, :4] = 9.0
    for mask, weights, depth in ((w, w, N.F32), (np.array([[0, 3], [255, 0], [1, 1]]), np.array([[0, 1], [1, 0], [1, 1.0]]), N.U8)):
        for method in range(6):
            want = np.zeros((5, 8))
            for y, x in np.ndindex(5, 8):
                i, own = a[y : y + 3, x : x + 2], t
                if method > 3:
                    i, own = i - (i * weights).sum() / weights.sum(), own - (own * weights).sum() / weights.sum()
                i, own = i * weights, own * weights
                top = ((i - own) ** 2).sum() if method < 2 else (i * own).sum()
                with np.errstate(invalid="ignore", divide="ignore"):
                    want[y, x] = top / np.sqrt((i**2).sum() * (own**2).sum()) if method % 2 else top
            got = values(W.match_template(plane(spark, a), t.tolist(), method, mask.tolist(), depth))
            level = np.zeros((5, 8), bool)
            level[:2, :3] = method == 5  # windows of one value: no number, or one that is rounding alone
            assert np.isnan(got[level]).all() and np.allclose(got[~level], want[~level], atol=1e-6)
    with pytest.raises(ValueError):
        W.match_template(plane(spark, a), [[1.0]], 0, [[1.0, 1.0]])


@pytest.mark.parametrize("bend", [(), (0.05, -0.01, 0.002, -0.001), (0.05, -0.01, 0.002, -0.001, 0.003), (0.05, -0.01, 0.002, -0.001, 0.003, 0.02, 0.01, -0.004), (0.05, -0.01, 0.002, -0.001, 0.003, 0.02, 0.01, -0.004, 0.01, 0.002, -0.01, 0.003), (0.05, -0.01, 0.002, -0.001, 0.003, 0.02, 0.01, -0.004, 0.01, 0.002, -0.01, 0.003, 0.2, -0.1)])
@pytest.mark.parametrize("r", [(0.1, -0.4, 0.3), (0.0, 0.0, 0.0)])
def test_jacobians_are_central_differences(spark, bend, r):
    camera, t, points = np.array([[600.0, 0, 320], [0, 500, 240], [0, 0, 1]]), (0.1, -0.2, 4.0), np.random.default_rng(0).uniform(-1, 1, (5, 3))

    def places(q):
        m = C.rodrigues(q[:3])
        out = []
        for p in points:
            a, b, z = m @ p + q[3:6]
            x, y = a / z, b / z
            d = [*q[10:15], *bend[5:], *[0] * 14][:14] if bend else [0] * 14
            k1, k2, p1, p2, k3, k4, k5, k6, s1, s2, s3, s4, tx, ty = d
            s = x * x + y * y
            ratio = (1 + k1 * s + k2 * s**2 + k3 * s**3) / (1 + k4 * s + k5 * s**2 + k6 * s**3)
            x, y = x * ratio + 2 * p1 * x * y + p2 * (s + 2 * x * x) + s1 * s + s2 * s * s, y * ratio + p1 * (s + 2 * y * y) + 2 * p2 * x * y + s3 * s + s4 * s * s
            if tx or ty:
                turn = math.atan2(ty, tx)
                rz = lambda v: np.array([[math.cos(v), -math.sin(v), 0], [math.sin(v), math.cos(v), 0], [0, 0, 1]])
                rx = np.array([[1, 0, 0], [0, math.cos(tx), -math.sin(tx)], [0, math.sin(tx), math.cos(tx)]])
                ry = np.array([[math.cos(ty), 0, math.sin(ty)], [0, 1, 0], [-math.sin(ty), 0, math.cos(ty)]])
                v = np.linalg.solve(rz(turn) @ rx @ ry @ rz(-turn), [x, y, 1])
                x, y = v[0] / v[2], v[1] / v[2]
            out.append((q[6] * x + q[8], q[7] * y + q[9]))
        return np.array(out)

    q = np.array([*r, *t, 600, 500, 320, 240, *(list(bend[:5]) + [0.0] * 5)[:5]])
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "pos int, x double, y double, z double")
    got = C.project_jacobian(rows, r, t, camera, bend).orderBy("pos").collect()
    assert np.allclose([(g.u, g.v) for g in got], places(q))
    plain = C.project_points(rows, r, t, camera, bend).orderBy("pos").collect()
    assert np.allclose([(g.u, g.v) for g in plain], places(q))
    for k in range(15 if bend else 10):
        h = np.zeros(15)
        h[k] = 1e-5
        assert np.allclose([(g.du[k], g.dv[k]) for g in got], (places(q + h) - places(q - h)) / 2e-5, rtol=1e-5, atol=1e-5), C.PARAMETERS[k]
