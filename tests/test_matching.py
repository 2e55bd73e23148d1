"""Matching of descriptors against all pairs, at every width of block and with salts."""

import random

import pytest

from gridloom.operators import matching as H


def rows(spark, words, first=0):
    wrap = lambda w: w - (1 << 64) if w >> 63 else w
    return spark.createDataFrame([(first + k, None if w is None else [wrap(x) for x in w]) for k, w in enumerate(words)], "key long, words array<long>")


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def nearest(q, t, k):
    return {(i, j, d, r) for i, a in enumerate(q) for r, (d, j) in enumerate(sorted((apart(a, b), j) for j, b in enumerate(t))[:k], 1)}


@pytest.fixture(scope="module")
def words():
    """Random ones, copies, near copies, and many with one equal block."""
    r = random.Random(5)
    near = lambda w, n: [x ^ sum(1 << b for b in r.sample(range(64), n)) for x in w]
    base = [[r.getrandbits(64), r.getrandbits(64)] for _ in range(12)]
    train = base + base[:4] * 3 + [near(b, n) for b in base for n in (1, 4)] + [[0xFFFF, r.getrandbits(64)] for _ in range(20)] + [[0, 0], [(1 << 64) - 1] * 2]
    return [near(b, n) for b in base for n in (0, 2, 5)] + [[0, 0], [0, 0], [1 << 63, 7], [r.getrandbits(64), 0]], train


@pytest.mark.parametrize("width", [8, 32])
def test_nearest(spark, words, monkeypatch, width):
    q, t = words
    monkeypatch.setattr(H, "_width", lambda n: width)
    monkeypatch.setattr(H, "CELL", 6)
    monkeypatch.setattr(H, "SALTED", 1 << 10)
    got = H.knn_match(rows(spark, q), rows(spark, t), 3).collect()
    assert len(got) == 3 * len(q) and {tuple(x) for x in got} == nearest(q, t, 3)


@pytest.mark.parametrize("width", [8, 16, 32])
def test_nearest_by_rings_and_a_scan_of_the_rest(spark, words, monkeypatch, width):
    q, t = words
    monkeypatch.setattr(H, "_width", lambda n: width)
    monkeypatch.setattr(H, "SCANNED", 0)
    monkeypatch.setattr(H, "CELL", 6)
    monkeypatch.setattr(H, "CHUNK", 9)
    monkeypatch.setattr(H, "HELD", 40)
    got = H.knn_match(rows(spark, q), rows(spark, t), 3).collect()
    assert len(got) == 3 * len(q) and {tuple(x) for x in got} == nearest(q, t, 3)


def test_far_descriptors_take_few_jobs(spark):
    """Random descriptors differ in most blocks; rings after rings filled the driver with plans."""
    r = random.Random(7)
    far = [[r.getrandbits(64)] for _ in range(300)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("knn", "far descriptors")
    got = {tuple(x) for x in H.knn_match(rows(spark, far), rows(spark, far), 4).collect()}
    count = len(jobs.getJobIdsForGroup("knn"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == nearest(far, far, 4) and count < 60


def test_within_a_radius_by_look_ups_and_by_scans(spark, words, monkeypatch):
    q, t = words
    monkeypatch.setattr(H, "CHUNK", 9)
    for faster in (0, 1e9):
        monkeypatch.setattr(H, "FASTER", faster)
        for far in (0, 9, 40):
            wanted = {(i, j, apart(a, b)) for i, a in enumerate(q) for j, b in enumerate(t) if apart(a, b) <= far}
            got = H.radius_match(rows(spark, q), rows(spark, t), far).collect()
            assert {tuple(x) for x in got} == wanted and len(got) == len(wanted)


def test_within_a_radius(spark, words, monkeypatch):
    q, t = words
    wanted = lambda far: {(i, j, apart(a, b)) for i, a in enumerate(q) for j, b in enumerate(t) if apart(a, b) <= far}
    for width, far in ((32, 0), (16, 9), (8, 40)):
        monkeypatch.setattr(H, "_width", lambda n, w=width: w)
        got = H.radius_match(rows(spark, q), rows(spark, t), far).collect()
        assert {tuple(x) for x in got} == wanted(far) and len(got) == len(wanted(far))
    with pytest.raises(ValueError):
        H.radius_match(rows(spark, q), rows(spark, t), -1)


def test_mutual_and_allowed(spark, words):
    q, t = words
    there, back = nearest(q, t, 1), {(i, j) for j, i, _, _ in nearest(t, q, 1)}
    assert {tuple(x) for x in H.match(rows(spark, q), rows(spark, t), True).collect()} == {(i, j, d) for i, j, d, _ in there if (i, j) in back}
    pairs = [(i, j) for i in range(len(q)) for j in range(len(t)) if (i + j) % 5 == 0]
    wanted = {(i, j, d, r) for i in range(len(q)) for r, (d, j) in enumerate(sorted((apart(q[i], t[j]), j) for a, j in pairs if a == i)[:2], 1)}
    got = H.knn_match(rows(spark, q), rows(spark, t), 2, spark.createDataFrame(pairs + pairs[:3], "query long, train long")).collect()
    assert len(got) == len(wanted) and {tuple(x) for x in got} == wanted


def test_nothing_and_nulls(spark):
    some, none = rows(spark, [[1, 2], None, [3, 2], []]), rows(spark, [])
    assert {tuple(x) for x in H.knn_match(some, some, 5).collect()} == {(0, 0, 0, 1), (0, 2, 1, 2), (2, 2, 0, 1), (2, 0, 1, 2)}
    for a, b in ((some, none), (none, some), (none, none)):
        assert H.knn_match(a, b, 2).count() == 0 and H.radius_match(a, b, 3).count() == 0 and H.match(a, b, True).count() == 0
    with pytest.raises(ValueError):
        H.knn_match(some, rows(spark, [[1]]), 1)
