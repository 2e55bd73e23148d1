"""Systems of equations by three decompositions: answers, failures, planes of many sizes in one batch, link runs."""

import numpy as np
import pytest

from gridloom.operators import kernels as K
from gridloom.operators import systems as Y
from gridloom.sources.images import PLANE


def planes(spark, matrices):
    return spark.createDataFrame([(k, 0, *np.shape(m), np.ravel(np.array(m, float)).tolist()) for k, m in enumerate(matrices)], PLANE).coalesce(1)


def answers(df):
    return [np.array(r["data"]).reshape(r["rows"], r["cols"]) if r["ok"] else None for r in df.orderBy("img").collect()]


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(5)
    made = [rng.normal(size=(n, n)) for n in (1, 2, 3, 5, 3, 2, 5)]
    return [m @ m.T + np.eye(len(m)) for m in made]


@pytest.mark.parametrize("method", [Y.LU, Y.CHOLESKY, Y.QR])
def test_inverses_and_solutions(spark, mixed, method):
    for m, got in zip(mixed, answers(Y.invert(planes(spark, mixed), method)), strict=True):
        assert np.allclose(got @ m, np.eye(len(m)))
    rights = [np.random.default_rng(k).normal(size=(len(m), 1 + k % 3)) for k, m in enumerate(mixed)]
    for m, b, got in zip(mixed, rights, answers(Y.solve(planes(spark, mixed), planes(spark, rights), method)), strict=True):
        assert got.shape == b.shape and np.allclose(m @ got, b)


def test_failures(spark):
    eye = np.eye(3)
    cases = {
        "sound": eye, "zero": np.zeros((3, 3)), "rank": [[1, 2], [2, 4]], "skew": [[2, 1], [0, 2]], "negative": -eye, "nan": [[np.nan, 0], [0, 1]],
        "infinite": [[np.inf, 0], [0, 1]], "flat": np.ones((2, 3)), "small": eye * 1e-200, "spread": np.diag([1, 1e-17]), "just": np.diag([1, 1e-15]),
    }
    fine = {Y.LU: {"sound", "skew", "negative", "small", "just"}, Y.CHOLESKY: {"sound", "small", "just"}, Y.QR: {"sound", "skew", "negative", "small", "just"}}
    for method, want in fine.items():
        got = answers(Y.invert(planes(spark, list(cases.values())), method))
        assert {n for n, x in zip(cases, got, strict=True) if x is not None} == want
    empty = Y.invert(planes(spark, list(cases.values())).where("img < 0"))
    assert empty.count() == 0
    with pytest.raises(ValueError):
        Y.invert(empty, 1)


def test_least_squares(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(7, 2))
    lost = a.copy()
    lost[:, 2] = 0
    got = answers(Y.solve(planes(spark, [a, lost, a.T]), planes(spark, [b, b, b[:3]])))
    assert np.allclose(got[0], np.linalg.lstsq(a, b, rcond=None)[0]) and got[1] is None and got[2] is None
    assert answers(Y.solve(planes(spark, [a]), planes(spark, [b]), Y.LU)) == [None]


def test_link_runs_are_two_levels_of_whole_contours(spark):
    ring = np.zeros((7, 7))
    ring[1:6, 1:6], ring[2:5, 2:5], ring[3, 3] = 255, 0, 255
    rows = K.find_contours_link_runs(planes(spark, [ring])).orderBy("contour").collect()
    assert [len(r["points"]) for r in rows] == [len(r["points"]) for r in K.find_contours(planes(spark, [ring]), K.CCOMP, simple=False).orderBy("contour").collect()]
    assert len(rows) == 3 and {r["parent"] for r in rows} >= {-1} and max(len(r["points"]) for r in rows) == 16
