"""Roots and clipped polygons of whole batches against one at a time; a turn names its root, sine and cosine once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import geometry as G
from gridloom.operators import transforms as T


def test_roots_of_mixed_degrees(spark, monkeypatch):
    polynomials = [[6, -5, 1], None, [], [0, 0, 0], [0, 0, 2, 3], [5], [1, 0, 1, 0, 0], [-6, 11, -6, 1], [0, 1], [2.5, 1, 4, 1, 5, 9]]
    df = spark.createDataFrame([(k, c and list(map(float, c))) for k, c in enumerate(polynomials)], "k int, c array<double>").coalesce(1)
    for (k, found), c in zip(df.select("k", T.solve_poly("c")).orderBy("k").collect(), polynomials, strict=True):
        want = None if c is None else sorted((z.real, z.imag) for z in map(complex, np.roots(np.array(c, float)[::-1])))
        assert found is None if c is None else np.allclose([tuple(r) for r in found], want)
    monkeypatch.setattr(np, "roots", None)
    assert len(T.solve_poly.func(__import__("pyarrow").array([[6.0, -5, 1]]))[0]) == 2


def test_clipping_of_mixed_polygons(spark):
    r = np.random.default_rng(4)

    def shape(n):
        p = r.normal(size=(n, 2)) * 4
        return [(float(x), float(y)) for x, y in p[G.hull_indices(p)]]

    pairs = [(shape(int(r.integers(3, 12))), shape(int(r.integers(3, 12)))[:: 1 if k % 2 else -1]) for k in range(60)]
    pairs += [(None, shape(4)), (shape(4), None), ([], shape(4)), (shape(4), []), (shape(2), shape(5)), ([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0)])]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>").coalesce(1)
    for (k, got), (a, b) in zip(df.select("k", T.intersect_convex("a", "b")).orderBy("k").collect(), pairs, strict=True):
        area, corners = G.intersect_convex(a, b) if a and b else (0.0, [])
        assert got["area"] == pytest.approx(area) and np.allclose([tuple(c) for c in got["corners"]], corners)


def test_a_turn_is_worked_out_once(spark):
    plan = spark.range(1).select(T.rodrigues(F.array(F.col("id") / 3, F.lit(0.5), F.lit(0.25))).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("sqrt(") == 1
