"""Shifts that are put in and found again, against loops over all pixels, and what can't be aligned."""

import numpy as np
import pytest

from gridloom.operators import alignment as A

SCHEMA = "img long, c int, rows int, cols int, data array<double>"
SCENES = "img long, scene long"


def table(spark, images):
    return spark.createDataFrame([(i, c, *p.shape, p.ravel().tolist()) for i, image in images.items() for c, p in enumerate(image)], SCHEMA)


def move(a, dx, dy):
    out = np.zeros_like(a)
    for y, x in np.ndindex(a.shape):
        if 0 <= y - dy < a.shape[0] and 0 <= x - dx < a.shape[1]:
            out[y, x] = a[y - dy, x - dx]
    return out


def bits(a):
    m = np.sort(a.ravel())[a.size // 2 - 1] + 1 if a.size > 1 else 0
    return (a > m).astype(float), (np.abs(a - m) > 4).astype(float)


def searched(a, b, bits_most):
    dx = dy = err = 0
    for level in range(min(max(max(a.shape).bit_length() - 2, 0), bits_most - 1), -1, -1):
        dx, dy, k = 2 * dx, 2 * dy, 1 << level
        p, q = (x[: x.shape[0] // k * k : k, : x.shape[1] // k * k : k] for x in (a, b))
        best, err = (dx, dy), p.size
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                (t, e), (u, f) = bits(p), [move(x, dx + i, dy + j) for x in bits(q)]
                n = int(((t != u) * e * f).sum())
                if n < err:
                    best, err = (dx + i, dy + j), n
        dx, dy = best
    return dx, dy, err


def test_shifts(spark):
    r = np.random.default_rng(8)
    big = np.cumsum(np.cumsum(r.normal(0, 9, (40, 50)), 0), 1)
    big = np.rint(255 * (big - big.min()) / np.ptp(big))
    moved = {0: (0, 0), 1: (3, -2), 2: (0, 0), 3: (-5, 4)}
    images = {i: [move(big, *d)[8:32, 8:40]] for i, d in moved.items()}
    images |= {10 + i: [r.integers(0, 256, (5, 7)).astype(float) for _ in range(3)] for i in range(2)}
    images |= {20: [np.full((3, 3), 7.0)], 21: [np.full((3, 3), 9.0)], 30: [np.ones((1, 1))]}
    scenes = [(0, 1), (1, 1), (2, 1), (3, 1), (10, 2), (11, 2), (20, 3), (21, 3), (30, 4), (77, 5)]
    planes, listed = table(spark, images), spark.createDataFrame([*scenes, (0, None), (3, 1)], SCENES)
    gray = {i: np.floor((4899 * p[0] + 9617 * p[1] + 1868 * p[2] + 8192) / 16384) if len(p) == 3 else p[0] for i, p in images.items()}
    for most in (6, 3):
        got = {r.img: (r.pivot, r.dx, r.dy, r.differing) for r in A.shifts(planes, listed, most).collect()}
        pivot = {1: 2, 2: 11, 3: 21, 4: 30}
        assert got == {i: (pivot[s], *searched(gray[pivot[s]], gray[i], most)) for i, s in scenes if i in images}
        if most == 3:
            assert got[1][1:3] == (-3, 2) and got[3][1:3] == (5, -4) and got[0][1:3] == (0, 0)
    out = {(r.img, r.c): np.array(r.data).reshape(r.rows, r.cols) for r in A.align_mtb(planes, listed, 3).collect()}
    for (i, c), p in out.items():
        assert (p == move(images[i][c], *got[i][1:3])).all()
    assert len(out) == sum(len(images[i]) for i, _ in scenes if i in images)


def test_nothing_and_sizes(spark):
    planes = table(spark, {0: [np.ones((2, 2))], 1: [np.ones((2, 3))]})
    listed = spark.createDataFrame([(0, 1), (1, 1)], SCENES)
    assert A.align_mtb(planes.where("false"), listed).count() == 0 and A.shifts(planes, listed.where("false")).count() == 0
    with pytest.raises(Exception, match="differ in size"):
        A.shifts(planes, listed)
    with pytest.raises(ValueError):
        A.shifts(planes, listed, 0)
