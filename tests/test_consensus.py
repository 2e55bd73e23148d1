"""Robust estimates: known outcomes, the draws one by one, and the refinement against a plain loop."""

import math

import numpy as np
import pytest

from gridloom.operators import calibration as C
from gridloom.operators import consensus as O

SCHEMA = "set_id long, pos int, x double, y double, u double, v double"
FROM = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [2.0, 0.5], [5.0, 3.0], [3.0, 2.0], [4.0, 1.0]]
TO = [[2.0, 3.0], [4.0, 3.0], [2.0, 5.0], [4.0, 5.0], [6.0, 4.0], [12.0, 9.0], [8.9, 9.9], [10.0, 7.0]]


def frame(spark, *sets):
    return spark.createDataFrame([(s, 3 * k, *map(float, a), *map(float, b)) for s, (f, t) in enumerate(sets) for k, (a, b) in enumerate(zip(f, t, strict=True))], SCHEMA)


def found(df):
    return {r.set_id: (r.matrix, [int(x) for x in r.inliers]) for r in df.collect()}


def test_known_homographies(spark, monkeypatch):
    monkeypatch.setattr(O, "PART", 3)
    df = frame(spark, (FROM, TO), (FROM[:6], TO[:6]), (FROM[:3], TO[:3]))
    masks = {m: {r.set_id: r.inliers for r in C._gathered(*O.homography(df, m, refine=False)).collect()} for m in ("ransac", "lmeds")}
    assert masks["ransac"][0] == [1, 1, 1, 1, 1, 0, 1, 1] and masks["lmeds"][0] == [1, 1, 1, 1, 1, 1, 0, 1]
    exact = [2, 0, 2, 0, 2, 3, 0, 0, 1]
    got = found(C.find_homography(df.where("set_id > 0"), "ransac"))
    assert got == {1: (pytest.approx(exact, abs=1e-9), [1] * 6), 2: ([], [0, 0, 0])} and masks["lmeds"][2] == [0, 0, 0]
    with pytest.raises(ValueError):
        C.find_homography(df, "other")
    assert C.find_homography(df.where("false"), "ransac").count() == 0


def test_known_affine_maps(spark, monkeypatch):
    monkeypatch.setattr(O, "PART", 2)
    square, moved = FROM[:4], [[3, 1], [5, 1], [3, 3], [5, 3]]
    line = [[0, 0], [1, 3], [2, 6], [3, 9]], [[0, 0], [5, 1], [10, 2], [15, 3]]
    rough = [[20 + k, 30 + k] for k in range(4)], [[k * 7.0 % 23, k * 11.0 % 29] for k in range(4)]
    five = [*square, [2, 0]], [*moved, [7, 1]]
    df = frame(spark, (square, moved), ([*square, [9, 9]], [*moved, [100, 100]]), line, (square[:2], moved[:2]), (five[0] + rough[0], five[1] + rough[1]))
    exact = pytest.approx([2, 0, 3, 0, 2, 1], abs=1e-12)
    for method in ("ransac", "lmeds"):
        got = found(C.estimate_affine_2d(df, method))
        assert got[0] == (exact, [1] * 4) and got[1] == (exact, [1] * 4 + [0])
        assert got[2][0] == [] and got[3] == ([], [0, 0])
        assert method == "ransac" or got[4] == (exact, [1] * 5 + [0] * 4)


def test_draws_are_the_streams(spark):
    state = (1 << 64) - 1

    def step():
        nonlocal state
        state = (state % 2**32) * 4164903690 + state // 2**32
        return state % 2**32

    wanted = []
    while len(wanted) < 50:
        subset = []
        while len(subset) < 4:
            if (k := step() % 9) not in subset:
                subset.append(k)
        wanted.append(subset)
    sizes = spark.createDataFrame([(9,), (4,)], "n long")
    rows = O._drawn(sizes, O.HOMOGRAPHY, 10, 50).collect()
    got = {}
    for r in rows:
        got.setdefault((r.n, r.draw), {})[r.k] = r.idx
    assert [[got[9, d][k] for k in range(4)] for d in range(10, 50)] == wanted[10:] and (4, 10) not in got
    triples = list(O.subsets(5, 3, True))
    assert len(triples) == math.comb(5, 3) == len({frozenset(t) for t in triples})


def plain_refinement(h, p):
    """Levenberg-Marquardt for one set, pair by pair."""
    h, damping = np.array(h[:8]) / h[8], 1e-8

    def residuals(h):
        w = h[6] * p[:, 0] + h[7] * p[:, 1] + 1
        a, b = (h[0] * p[:, 0] + h[1] * p[:, 1] + h[2]) / w, (h[3] * p[:, 0] + h[4] * p[:, 1] + h[5]) / w
        z, x, y = np.zeros(len(p)), p[:, 0] / w, p[:, 1] / w
        j = np.concatenate([np.stack([x, y, 1 / w, z, z, z, -a * x, -a * y], axis=1), np.stack([z, z, z, x, y, 1 / w, -b * x, -b * y], axis=1)])
        return np.concatenate([a - p[:, 2], b - p[:, 3]]), j

    for _ in range(200):
        r, j = residuals(h)
        for _ in range(80):
            new = h - np.linalg.solve(j.T @ j + damping * np.eye(8), j.T @ r)
            if (residuals(new)[0] ** 2).sum() < (r**2).sum():
                h, damping = new, damping * 0.3
                break
            damping *= 10
        else:
            break
    return np.append(h, 1.0), (residuals(h)[0] ** 2).sum()


def test_refinement(spark, monkeypatch):
    monkeypatch.setattr(O, "PART", 7)
    rng, sets = np.random.default_rng(4), []
    for _ in range(3):
        h = np.array([[1.1, 0.1, 3], [-0.05, 0.9, 2], [0.002, 0.004, 1]]) + rng.normal(0, 1e-3, (3, 3)) * [[10, 10, 100], [10, 10, 100], [1, 1, 0]]
        xy = rng.uniform(0, 40, (25, 2))
        q = np.column_stack([xy, np.ones(25)]) @ h.T
        sets.append((xy, q[:, :2] / q[:, 2:] + rng.normal(0, 0.4, (25, 2))))
    df = frame(spark, *sets)
    linear = {r.set_id: r.model for r in O.homography(df, "all", refine=False)[0].collect()}
    moved = {r.set_id: r.model for r in O.homography(df, "all")[0].collect()}
    for k, (f, t) in enumerate(sets):
        p = np.column_stack([f, t]).astype(np.float32).astype(float)
        want, least = plain_refinement(linear[k], p)
        assert np.allclose(moved[k], want, rtol=1e-6, atol=1e-8)
        q = np.column_stack([p[:, :2], np.ones(25)]) @ np.array(moved[k]).reshape(3, 3).T
        start = np.column_stack([p[:, :2], np.ones(25)]) @ np.array(linear[k]).reshape(3, 3).T
        error = lambda z: ((z[:, :2] / z[:, 2:] - p[:, 2:]) ** 2).sum()  # noqa: B023, E731
        assert error(q) == pytest.approx(least, rel=1e-9) and error(q) < error(start)


def test_many_systems_at_once():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 5, 5)), rng.normal(size=(50, 5, 2))
    a[7, 3] = a[7, 1] = 0
    got = O.solved(a, b)
    assert np.isnan(got[7]).all() and np.allclose(np.delete(got, 7, 0), np.linalg.solve(np.delete(a, 7, 0), np.delete(b, 7, 0)))
