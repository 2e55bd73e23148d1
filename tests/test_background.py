"""Mixtures of pixels against a loop over pixels, in a table and in a stream that stops and goes on."""

import math
import time

import numpy as np
import pytest

from gridloom.streaming import background as B

SCHEMA = "stream long, frame long, rows int, cols int, data array<double>"


def by_pixel(frames, s):
    """Masks and background of one pixel's values over time, each a list of channels."""
    modes, masks = [], []
    for t, x in enumerate(frames, 1):
        a = s.rate if s.rate >= 0 and t > 1 else 1 / min(2 * t, s.history)
        lost, hit, back, total, k, alive = a * s.prune, False, False, 0.0, 0, len(modes)
        while k < alive:
            w, var, mean = modes[k]
            w, up = (1 - a) * w - lost, 0
            if not hit:
                off = [m - v for m, v in zip(mean, x, strict=True)]
                d = sum(o * o for o in off)
                back = back or (total < s.share and d < s.near * var)
                if d < s.fits * var:
                    hit, w = True, w + a
                    modes[k] = [modes[k][0], min(max(var + a / w * (d - var), s.least_variance), s.most_variance), [m - a / w * o for m, o in zip(mean, off, strict=True)]]
                    while k - up > 0 and w >= modes[k - up - 1][0]:
                        modes[k - up], modes[k - up - 1] = modes[k - up - 1], modes[k - up]
                        up += 1
            if w < lost:
                w, alive = 0.0, alive - 1
            modes[k - up][0] = w
            total, k = total + w, k + 1
        modes = modes[:alive]
        for m in modes:
            m[0] *= 1 / total if abs(total) > np.finfo(np.float32).eps else 0
        if not hit and a > 0:
            modes = modes[: s.modes - 1]
            for m in modes:
                m[0] *= 1 - a
            modes.append([a if modes else 1.0, s.first_variance, list(x)])
            k = len(modes) - 1
            while k > 0 and a >= modes[k - 1][0]:
                modes[k], modes[k - 1], k = modes[k - 1], modes[k], k - 1
        masks.append(0.0 if back else s.shadow_value if s.shadows and shadow(modes, x, s) else 255.0)
    top, total = [0.0] * len(x), 0.0
    for w, _, mean in modes:
        top, total = [p + w * m for p, m in zip(top, mean, strict=True)], total + w
        if total > s.share:
            break
    return masks, [p / total for p in top]


def shadow(modes, x, s):
    total = 0.0
    for w, var, mean in modes:
        low, high = sum(m * m for m in mean), sum(m * v for m, v in zip(mean, x, strict=True))
        if low == 0:
            return False
        if s.darkest_shadow * low <= high <= low and sum((high / low * m - v) ** 2 for m, v in zip(mean, x, strict=True)) < s.near * var * (high / low) ** 2:
            return True
        total += w
        if total > s.share:
            return False
    return False


def scene(seed, frames, channels, rows, cols):
    """Two grounds that alternate, noise, and a spot that wanders, with a shade behind it."""
    r = np.random.default_rng(seed)
    out = []
    for t in range(frames):
        a = (np.full((channels, rows, cols), 120.0) if t % 7 else np.full((channels, rows, cols), 60.0)) + r.normal(0, 3, (channels, rows, cols))
        a[:, t % rows, (2 * t) % cols] = 230
        a[:, (t + 1) % rows, (2 * t) % cols] *= 0.7
        out.append(np.rint(a.clip(0, 255)))
    return out


def wanted(frames, s):
    masks = [np.zeros(f.shape[1:]) for f in frames]
    for y, x in np.ndindex(frames[0].shape[1:]):
        for t, m in enumerate(by_pixel([f[:, y, x] for f in frames], s)[0]):
            masks[t][y, x] = m
    return masks


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.y):
        out.setdefault((r.stream, r.frame), []).append(np.array(r.data).reshape(r.rows, r.cols))
    return {k: np.vstack(v) for k, v in out.items()}


def rows_of(scenes):
    return [(s, t, *f.shape[1:], f.ravel().tolist()) for s, frames in scenes.items() for t, f in enumerate(frames)]


@pytest.mark.parametrize("s", [B.Mixture(), B.Mixture(modes=2, rate=0.2, shadows=False), B.Mixture(modes=3, rate=0.05, share=0.6, prune=0.5, history=5), B.Mixture(rate=0.0)])
def test_band_is_a_loop_over_pixels(s):
    for channels in (1, 3):
        frames = scene(channels, 40, channels, 4, 5)
        band = B.Band(s, 20, channels)
        got = [band.apply(f.reshape(channels, -1)).reshape(4, 5) for f in frames]
        assert all((a == b).all() for a, b in zip(got, wanted(frames, s), strict=True))
        for k, (y, x) in enumerate(np.ndindex(4, 5)):
            assert band.background()[:, k] == pytest.approx(by_pixel([f[:, y, x] for f in frames], s)[1])


def test_tables_in_bands(spark):
    scenes = {1: scene(1, 12, 1, 5, 4), 2: scene(2, 9, 3, 3, 3)}
    rows = rows_of(scenes)
    df = spark.createDataFrame(rows + rows[3:5] + [(None, 1, 1, 1, [1.0]), (3, None, 1, 1, [1.0]), (4, 1, 0, 0, [])], SCHEMA)
    for band in (0, 2):
        got = whole(B.foreground(df, band=band).collect())
        assert got.keys() == {(s, t) for s, _, *_ in rows for t in range(len(scenes[s]))}
        for s, frames in scenes.items():
            for t, m in enumerate(wanted(frames, B.Mixture())):
                assert (got[s, t] == m).all()
    assert B.foreground(df.where("false")).count() == 0


def test_a_stream_that_stops_and_goes_on(spark, tmp_path):
    scenes = {1: scene(1, 12, 1, 4, 4), 2: scene(2, 12, 1, 4, 4)}
    rows, source = rows_of(scenes), str(tmp_path / "in")
    out = []

    def pass_through(low, high):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = B.foreground_stream(spark.readStream.schema(SCHEMA).parquet(source), band=3)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    pass_through(0, 7)
    pass_through(5, 12)  # frames 5 and 6 are late
    assert len(out) == 2 * 2 * 12
    table = whole(B.foreground(spark.createDataFrame(rows, SCHEMA), band=3).collect())
    got = whole(out)
    assert got.keys() == table.keys() and all((got[k] == table[k]).all() for k in got)


def test_settings():
    with pytest.raises(ValueError):
        B.Mixture(modes=0)
    assert math.isclose(B.Band(B.Mixture(), 1, 1).background().sum(), 0)


def test_a_stream_that_ends_gives_its_background(spark, tmp_path):
    frames, source, out = scene(4, 9, 1, 2, 3), str(tmp_path / "in"), []
    spark.createDataFrame(rows_of({1: frames}), SCHEMA).coalesce(1).write.parquet(source)
    stream = B.foreground_stream(spark.readStream.schema(SCHEMA).parquet(source), idle_ms=1)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    try:
        limit = time.monotonic() + 60
        while not any(r.frame == -1 for r in out) and time.monotonic() < limit:
            time.sleep(0.2)
    finally:
        query.stop()
    ended = [r for r in out if r.frame == -1]
    assert len(ended) == 1 and len(out) == 10
    assert ended[0].data == pytest.approx([by_pixel([f[:, y, x] for f in frames], B.Mixture())[1][0] for y, x in np.ndindex(2, 3)])
