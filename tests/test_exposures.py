"""Exposures against plain loops: odd and mixed sizes, one and three channels, a response, and what is not a scene."""

import math

import numpy as np
import pytest

from gridloom.operators import exposures as E
from gridloom.operators.neighbourhood import pyr_down, pyr_up

SCHEMA = "img long, c int, rows int, cols int, data array<double>"
SHOTS = "img long, scene long, seconds double"
FIVE = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])


def table(spark, images):
    return spark.createDataFrame([(i, c, *p.shape, p.ravel().tolist()) for i, image in images.items() for c, p in enumerate(image)], SCHEMA)


def place(k, n):
    k = abs(k) % (2 * n - 2) if n > 1 else 0
    return k if k < n else 2 * n - 2 - k


def blur(a):
    h, w = a.shape
    return np.array([[sum(FIVE[i, j] * a[place(y + i - 2, h), place(x + j - 2, w)] for i in range(5) for j in range(5)) for x in range(w)] for y in range(h)])


def down(a):
    return blur(a)[::2, ::2] / 256


def up(a, shape):
    spread = np.zeros((2 * a.shape[0], 2 * a.shape[1]))
    spread[::2, ::2] = a
    return (blur(spread) / 64)[: shape[0], : shape[1]]


def fused(images, powers):
    images = [np.array(i) / 255 for i in images]
    worth = []
    for i in images:
        gray = 0.299 * i[0] + 0.587 * i[1] + 0.114 * i[2] if len(i) == 3 else i[0]
        h, w = gray.shape
        edge = np.array([[gray[place(y - 1, h), x] + gray[place(y + 1, h), x] + gray[y, place(x - 1, w)] + gray[y, place(x + 1, w)] - 4 * gray[y, x] for x in range(w)] for y in range(h)])
        spread = np.sqrt(((i - i.mean(0)) ** 2).sum(0)) if len(i) == 3 else np.ones_like(gray)
        worth.append(np.abs(edge) ** powers[0] * spread ** powers[1] * np.exp(-((i - 0.5) ** 2).sum(0) / 0.08) ** powers[2] + 1e-12)
    total = sum(worth)
    levels = int(math.log2(min(total.shape)))
    out = []
    for c in range(len(images[0])):
        bands = [0] * (levels + 1)
        for i, w in zip(images, worth, strict=True):
            p, q = [i[c]], [w / total]
            for _ in range(levels):
                p.append(down(p[-1]))
                q.append(down(q[-1]))
            for k in range(levels + 1):
                bands[k] = bands[k] + (p[k] - up(p[k + 1], p[k].shape) if k < levels else p[k]) * q[k]
        done = bands[-1]
        for k in range(levels - 1, -1, -1):
            done = bands[k] + up(done, bands[k].shape)
        out.append(done)
    return out


@pytest.fixture(scope="module")
def shots():
    r = np.random.default_rng(3)
    size = {0: (3, 5, 7), 1: (3, 5, 7), 2: (3, 5, 7), 3: (1, 6, 3), 4: (1, 6, 3), 5: (1, 1, 4), 6: (1, 8, 8)}
    images = {i: [r.integers(0, 256, s[1:]).astype(float) for _ in range(s[0])] for i, s in size.items()}
    return images, [(0, 10, 0.25), (1, 10, 1.0), (2, 10, 4.0), (3, 11, 0.5), (4, 11, 2.0), (5, 12, 1.0), (6, None, 1.0), (99, 13, 1.0)]


def planes_of(df):
    return {(r.img, r.c): np.array(r.data).reshape(r.rows, r.cols) for r in df.collect()}


@pytest.mark.parametrize("powers", [(1.0, 1.0, 1.0), (0.5, 2.0, 0.0)])
def test_fusion(spark, shots, powers):
    images, listed = shots
    got = planes_of(E.merge_mertens(table(spark, images), spark.createDataFrame(listed, SHOTS), *powers))
    wanted = {(s, c): p for s in (10, 11, 12) for c, p in enumerate(fused([images[i] for i, t, _ in listed if t == s], powers))}
    assert got.keys() == wanted.keys()
    for k in got:
        np.testing.assert_allclose(got[k], wanted[k], rtol=1e-9, atol=1e-12)


def test_raised_is_pyr_up(spark, shots):
    df = table(spark, {6: shots[0][6]})
    small = pyr_down(df, depth=6)
    np.testing.assert_allclose(planes_of(E._raised(small, df))[6, 0], planes_of(pyr_up(small, depth=6))[6, 0], rtol=1e-12)


def test_radiance(spark, shots):
    images, listed = shots
    curve = np.array([[0.3 + (k + 1 + c) ** 1.5 for k in range(256)] for c in range(3)])
    response = spark.createDataFrame([(c, k, float(curve[c][k])) for c in range(3) for k in range(256)], "c int, level int, response double")
    times = spark.createDataFrame(listed, SHOTS)
    for given, of in ((None, lambda c, z: np.maximum(z, 1)), (response, lambda c, z: curve[c][z.astype(int)])):
        got = planes_of(E.merge_debevec(table(spark, images), times, given))
        for (scene, c), p in got.items():
            top = bottom = 0
            for i, s, t in listed:
                if s == scene and i in images:
                    w = np.mean([np.where(z < 128, z + 1, 256 - z) for z in images[i]], axis=0)
                    top, bottom = top + w * (np.log(of(c, images[i][c])) - math.log(t)), bottom + w
            np.testing.assert_allclose(p, np.exp(top / bottom), rtol=1e-9)
        assert {k for k in got} == {(10, 0), (10, 1), (10, 2), (11, 0), (12, 0)}
    with pytest.raises(ValueError):
        E.merge_debevec(table(spark, images), spark.createDataFrame([(0, 1, 0.0)], SHOTS))


def test_response_by_the_whole_system(spark, shots):
    images, listed = shots
    got = {(r.c, r.level): r.response for r in E.calibrate_debevec(table(spark, images), spark.createDataFrame(listed, SHOTS), 20, 3.0).collect()}
    trust = lambda z: z + 1 if z < 128 else 256 - z
    for c in range(3):
        scenes = {s: [(images[i][c].ravel(), t) for i, u, t in listed if u == s and i in images and c < len(images[i])] for s in (10, 11, 12)}
        points = [(s, k) for s, v in scenes.items() if v for k in range(v[0][0].size)]
        lines, right = [], []
        for n, (s, k) in enumerate(points):
            for p, t in scenes[s]:
                line, w = np.zeros(256 + len(points)), trust(p[k]) * math.sqrt(20 / len(points))
                line[int(p[k])], line[256 + n] = w, -w
                lines.append(line)
                right.append(w * math.log(t))
        for k in range(254):
            line = np.zeros(256 + len(points))
            line[k : k + 3] = 3.0 * trust(k + 1) * np.array([1, -2, 1])
            lines.append(line)
            right.append(0.0)
        line = np.zeros(256 + len(points))
        line[128] = 1
        curve = np.exp(np.linalg.lstsq(np.array([*lines, line]), np.array([*right, 0.0]), rcond=None)[0][:256])
        np.testing.assert_allclose([got[c, k] for k in range(256)], curve, rtol=1e-5)


def test_a_known_response_comes_back(spark):
    """Levels that are the square root of the light, seen for many lights and times."""
    light = np.linspace(0.01, 1, 96).reshape(8, 12)
    times = {i: 0.25 * 1.6**i for i in range(6)}
    images = {i: [np.clip(np.rint(255 * np.sqrt(light * t)), 0, 255)] for i, t in times.items()}
    # clipped pixels say nothing, so they are no part of this scene
    images = {i: v for i, v in images.items() if v[0].max() < 255}
    got = {r.level: r.response for r in E.calibrate_debevec(table(spark, images), spark.createDataFrame([(i, 0, times[i]) for i in images], SHOTS), 1000, 1.0).collect()}
    for level in range(40, 200, 20):
        assert got[level] == pytest.approx((level / 128) ** 2, rel=0.05)


def test_nothing_and_sizes(spark, shots):
    none, times = table(spark, shots[0]).where("false"), spark.createDataFrame([], SHOTS)
    assert E.merge_mertens(none, times).count() == 0 and E.merge_debevec(none, times).count() == 0 and E.calibrate_debevec(none, times).count() == 0
    with pytest.raises(Exception, match="differ in size"):
        E.merge_debevec(table(spark, shots[0]), spark.createDataFrame([(0, 1, 1.0), (6, 1, 2.0)], SHOTS)).collect()
