"""Hulls, defects and least rectangles where decimals lie on lines or tie, against their SQL."""

import duckdb
import pytest

from gridloom.operators import geometry as G
from gridloom.plans import QUERIES, SQL

TENTHS = [k / 10 for k in range(1, 40)]
VALUES = {
    1: TENTHS,  # a line
    2: [5.0, *TENTHS, 9.3],
    3: [9.9, *TENTHS[::-1], 7.0, *TENTHS],
    4: [0.3, 2.3, 0.3, 2.3, 0.3],  # equally far
    5: [100.7, 0.1, 0.2, 0.3, 0.4, 100.7],
    6: [0.7, 560.21, 33.3],  # a triangle: three equal rectangles
    7: [12.1, 3.3],
    8: [4.4],
    9: [6.8, 1.7, 0.9, 2.9, 1.6, 2.2, 4.9, 2.5, 7.6, 1.0],
    **{k: [round((k * j * j * 7919 % 101) / 10, 1) for j in range(30)] for k in range(10, 60)},
    **{k: [round((k * 7919 % 997) / 7, 2), round(k * 31.07 % 400, 2), round(k * 77.77 % 560, 2)] for k in range(60, 160)},
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("straight")
    rows = [(k * 1000 + n, n, k, v) for k, values in VALUES.items() for n, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, value double").write.parquet(f"{folder}/events.parquet")

    def both(name):
        got = {tuple(r) for r in QUERIES[name](spark, str(folder)).collect()}
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
        return got, set(con.sql(SQL[name]).fetchall())

    return both


def test_corners_on_a_line(found):
    got, wanted = found("convex_hull")
    assert got == wanted and [r[2] for r in sorted(r for r in got if r[0] == 1)] == [0, len(TENTHS) - 1]


def test_far_points_on_a_line(found):
    got, wanted = found("convexity_defects")
    assert got == wanted and not [r for r in got if r[0] == 1] and not [r for r in got if r[0] == 5]


def test_rectangles_of_equal_areas(found):
    got, wanted = found("min_area_rect")
    assert got == wanted and len(got) == len(VALUES)


def test_offsets_and_small_shapes_keep_their_corners():
    import numpy as np

    for square in (np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]) + 1e6, np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]) * 1e-9):
        assert G.hull_indices(square) == [0, 1, 2, 3]
