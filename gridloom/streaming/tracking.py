"""Window tracking: the mean-shift steps on one frame, and a structured stream that carries each track's window along."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.operators.kernels import per_plane

Rect = tuple[int, int, int, int]


#: Flags of the stopping rule: after so many passes, and by a distance.
COUNT, EPS = 1, 2
#: Pixels by which the adaptive form looks beyond its window on every side.
REACH = 10


def _common(rect: Rect, shape: tuple[int, int]) -> Rect:
    """The part of the window that lies in the image."""
    x, y, w, h = rect
    (x0, x1), (y0, y1) = np.clip((x, x + w), 0, shape[1]).tolist(), np.clip((y, y + h), 0, shape[0]).tolist()
    return x0, y0, max(0, x1 - x0), max(0, y1 - y0)


def _centroid(part: np.ndarray) -> tuple[float, float, float]:
    """Mass and centre (x, y) of an array's values."""
    mass = float(part.sum())
    if mass == 0:
        return 0.0, 0.0, 0.0
    return mass, float(part.sum(axis=0) @ np.arange(part.shape[1])) / mass, float(part.sum(axis=1) @ np.arange(part.shape[0])) / mass


def mean_shift(a: np.ndarray, rect: Rect, iterations: int = 100, epsilon: float = 1.0, stop: int = COUNT | EPS) -> tuple[int, Rect]:
    """(passes that count, window): the window (x, y, width, height), cut to the image, moved to the centre of its mass.

    With EPS a first step of epsilon or less ends it at once, and after that every pass counts, also one that rests;
    without EPS a pass that rests ends it and doesn't count. A window without mass ends it. There are `iterations`
    passes with COUNT, else 100.
    """
    x, y, w, h = _common(rect, a.shape)
    passes = iterations if stop & COUNT else 100
    for k in range(passes):
        mass, cx, cy = _centroid(a[y : y + h, x : x + w])
        if mass == 0:
            return k, (x, y, w, h)
        step = cx - w / 2, cy - h / 2
        if stop & EPS and k == 0 and math.hypot(*step) <= epsilon:
            return 0, (x, y, w, h)
        p, q = min(max(x + round(step[0]), 0), a.shape[1] - w), min(max(y + round(step[1]), 0), a.shape[0] - h)
        if (p, q) == (x, y):
            return (passes if stop & EPS else k), (x, y, w, h)  # all passes to come rest too
        x, y = p, q
    return passes, (x, y, w, h)


def _reached(low: int, high: int, n: int) -> tuple[int, int]:
    """low .. high grown by REACH at both ends and moved back into 0 .. n, cut only if it is longer than that."""
    length = min(n, high - low + 2 * REACH)
    start = min(max(low - REACH, 0), n - length)
    return start, start + length


def cam_shift(a: np.ndarray, rect: Rect) -> tuple[tuple[float, float, float, float, float], Rect]:
    """(ellipse's centre, width, height and angle; window), from the mass within REACH pixels around the window.

    Without mass the ellipse is all zeros and the window is the one given, grown and cut to the image.
    """
    x, y, w, h = _common(rect, a.shape)
    (x0, x1), (y0, y1) = _reached(x, x + w, a.shape[1]), _reached(y, y + h, a.shape[0])
    part = a[y0:y1, x0:x1]
    mass, cx, cy = _centroid(part)
    if mass == 0:
        return (0.0,) * 5, _common((x - REACH, y - REACH, w + 2 * REACH, h + 2 * REACH), a.shape)
    u, v = np.arange(part.shape[1]) - cx, np.arange(part.shape[0]) - cy
    xx, yy, xy = (max(0.0, float(part.sum(axis=0) @ (u * u)) / mass), max(0.0, float(part.sum(axis=1) @ (v * v)) / mass), float(v @ part @ u) / mass)
    middle, half = (xx + yy) / 2, math.hypot(xx - yy, 2 * xy) / 2
    minor, major = (np.float32(4 * math.sqrt(max(0.0, m))) for m in (middle - half, middle + half))
    angle = np.float32(90.0) if half == 0 else np.float32((90 + math.degrees(math.atan2(2 * xy, xx - yy)) / 2) % 180)
    c, s = abs(np.cos(np.radians(angle))), abs(np.sin(np.radians(angle)))
    wide, high = (math.floor(float(e) + 0.5) + 2 for e in (max(minor * c, major * s), max(minor * s, major * c)))
    left, top = min(max(math.floor(cx + x0 + 0.5) - wide // 2, 0), a.shape[1]), min(max(math.floor(cy + y0 + 0.5) - high // 2, 0), a.shape[0])
    wide, high = min(wide, a.shape[1] - left), min(high, a.shape[0] - top)
    return (left + wide / 2, top + high / 2, float(minor), float(major), float(angle)), (left, top, wide, high)


def mean_shift_planes(planes: DataFrame, rect: Rect) -> DataFrame:
    """(img, c, iterations, x, y, width, height) of every plane, from one starting window."""

    def run(a: np.ndarray) -> list[tuple]:
        n, r = mean_shift(a, rect)
        return [(n, *map(int, r))]

    return per_plane(planes, run, "iterations int, x int, y int, width int, height int")


def cam_shift_planes(planes: DataFrame, rect: Rect) -> DataFrame:
    def run(a: np.ndarray) -> list[tuple]:
        e, r = cam_shift(a, rect)
        return [(*e, *map(int, r))]

    return per_plane(planes, run, "center_x double, center_y double, ellipse_width double, ellipse_height double, angle double, x int, y int, width int, height int")


def track(frames: DataFrame, start: Rect) -> DataFrame:
    """(track, frame, x, y, width, height) of a stream of frames (track, frame, rows, cols, data): each track's window is
    state, starts at `start` and follows the mass from frame to frame. Frames of a batch are taken in order; one at or
    before the last that was seen is late and gives nothing."""
    out = "track long, frame long, x int, y int, width int, height int"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, *rect = state.get if state.exists else (-1, *start)
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        found = []
        for frame, h, w, data in zip(rows["frame"], rows["rows"], rows["cols"], rows["data"], strict=True):
            if frame <= last:
                continue
            _, rect = mean_shift(np.array(data, float).reshape(h, w), tuple(rect), stop=COUNT)
            last = int(frame)
            found.append((key[0], last, *map(int, rect)))
        state.update((last, *map(int, rect)))
        yield pd.DataFrame(found, columns=["track", "frame", "x", "y", "width", "height"])

    return frames.groupBy("track").applyInPandasWithState(run, out, "last long, x int, y int, width int, height int", "append", "NoTimeout")
