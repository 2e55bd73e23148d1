"""Circles that are drawn and found again, near centres one by one, and nothing to find."""

import math
import random

import numpy as np
import pytest

from gridloom.operators import circles as R

SCHEMA = "img long, c int, rows int, cols int, data array<double>"


def disc(rows, cols, *rings):
    y, x = np.mgrid[:rows, :cols]
    # edges three pixels wide, whose gradients point to the middle
    return sum(200.0 * np.clip((r + 1.5 - np.hypot(y - b, x - a)) / 3, 0, 1) for a, b, r in rings)


def test_drawn_circles(spark):
    shapes = {0: [(15, 20, 9)], 1: [(14, 14, 8), (40, 30, 11)], 2: []}
    planes = spark.createDataFrame([(i, 0, 48, 60, disc(48, 60, *s).ravel().tolist() if s else [7.0] * 2880) for i, s in shapes.items()], SCHEMA)
    got = R.hough_circles(planes, 1.0, 10.0, 100.0, 25, 5, 15).collect()
    for i, rings in shapes.items():
        mine = [r for r in got if r.img == i]
        assert len(mine) == len(rings)
        for a, b, r in rings:
            assert any(math.hypot(m.x - a, m.y - b) <= 1.5 and abs(m.radius - r) <= 1 for m in mine)
    assert R.hough_circles(planes.where("img = 2"), 1.0, 10.0, 100.0, 25, 5).count() == 0
    assert R.hough_circles(planes.where("false"), 1.0, 10.0).count() == 0
    coarse = R.hough_circles(planes.where("img = 0"), 2.0, 10.0, 100.0, 25, 5, 15).collect()
    assert len(coarse) == 1 and math.hypot(coarse[0].x - 15, coarse[0].y - 20) <= 3
    with pytest.raises(ValueError):
        R.hough_circles(planes, 0)


def test_choice_among_near_centres(spark):
    r = random.Random(2)
    rows = [(i, 0, y, x, r.randrange(1, 6), y + 0.5, x + 0.5) for i in range(2) for y in range(12) for x in range(12) if r.random() < 0.5]
    df = spark.createDataFrame(rows, "img long, c int, cy int, cx int, votes long, y double, x double")
    for far in (0.0, 1.0, 3.3, 30.0):
        wanted = []
        for row in sorted(rows, key=lambda q: (q[0], -q[4], q[2], q[3])):
            if all(w[0] != row[0] or math.hypot(w[5] - row[5], w[6] - row[6]) >= far for w in wanted):
                wanted.append(row)
        assert sorted(tuple(x) for x in R.apart(df, far).collect()) == sorted(wanted)
