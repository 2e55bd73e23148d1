"""Colour maps made from rules: 256 blue, green and red values each, from samples of a rule in single precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import planes as P
from gridloom.operators.common import D


def _bent(*corners: tuple[float, float]):
    """A rule that is linear between its corners (place, height)."""
    x, y = zip(*corners, strict=True)
    return lambda t: np.interp(t, x, y)


_UP, _DOWN, _NONE, _FULL = _bent((0, 0), (1, 1)), _bent((0, 1), (1, 0)), _bent((0, 0), (1, 0)), _bent((0, 1), (1, 1))


def _hot(first: float, second: float):
    return _bent((0, 0), (first, 1), (1, 1)), _bent((0, 0), (first, 0), (second, 1), (1, 1)), _bent((0, 0), (second, 0), (1, 1))



#: Red, green and blue of each map as heights over places from 0 to 1, and the number of samples.
_RULES = {
    "autumn": ((_FULL, _UP, _NONE), 64),
    "bone": ((_bent((0, 0), (0.75, 0.65625), (1, 1)), _bent((0, 0), (0.375, 0.328125), (0.75, 0.78125), (1, 1)), _bent((0, 0), (0.375, 0.453125), (1, 1))), 64),
    "cool": ((_UP, _DOWN, _FULL), 64),
    "hot": (_hot(0.4, 0.8), 64),
    "hsv": ((_bent((0, 1), (1 / 6, 1), (2 / 6, 0), (4 / 6, 0), (5 / 6, 1), (1, 1)), _bent((0, 0), (1 / 6, 1), (3 / 6, 1), (4 / 6, 0), (1, 0)), _bent((0, 0), (2 / 6, 0), (3 / 6, 1), (5 / 6, 1), (1, 0))), 64),
    "ocean": ((_bent((0, 0), (2 / 3, 0), (1, 1)), _bent((0, 0), (1 / 3, 0), (1, 1)), _UP), 64),
    "pink": (tuple(lambda t, h=h: np.sqrt((2 * t + h(t)) / 3) for h in _hot(0.375, 0.75)), 64),
    "rainbow": ((_bent((0, 1), (0.4, 1), (0.6, 0), (0.8, 0), (1, 2 / 3)), _bent((0, 0), (0.4, 1), (0.6, 1), (0.8, 0), (1, 0)), _bent((0, 0), (0.6, 0), (0.8, 1), (1, 1))), 64),
    "spring": ((_FULL, _UP, _DOWN), 64),
    "summer": ((_UP, _bent((0, 0.5), (1, 1)), _bent((0, 0.4), (1, 0.4))), 64),
    "winter": ((_NONE, _UP, _bent((0, 1), (1, 0.5))), 11),
}
NAMES = sorted([*_RULES, "jet"])


def _jet() -> list[list[int]]:
    """Steps of 4 between 32-entry corners; the last step of blue is 5."""
    k = np.arange(256)
    blue = np.where(k < 96, np.minimum(255, 128 + 4 * k), np.where(k < 160, 254 - 4 * (k - 96) - (k == 159), 0))
    green = np.where(k < 96, np.clip(4 * (k - 32), 0, 255), np.where(k < 160, 255, np.maximum(0, 252 - 4 * (k - 160))))
    red = np.where(k < 96, 0, np.where(k < 160, 2 + 4 * (k - 96), np.minimum(255, 252 - 4 * (k - 224))))
    return [v.tolist() for v in (blue, green, red)]


def table(name: str) -> list[list[int]]:
    """256 entries for blue, green and red: between samples in single precision, halves to the even entry."""
    if name == "jet":
        return _jet()
    rules, n = _RULES[name]
    one = np.float32
    # places are multiples of a rounded step
    at, x = (np.arange(m, dtype=one) * one(1 / (m - 1)) for m in (n, 256))
    low = np.clip(np.searchsorted(at, x, "right") - 1, 0, n - 2)
    out = []
    for rule in reversed(rules):
        y = rule(np.arange(n) / (n - 1)).astype(one)
        v = y[low] + (x - at[low]) * (y[low + 1] - y[low]) / (at[low + 1] - at[low])
        out.append(np.clip(np.rint(v * one(255)), 0, 255).astype(int).tolist())
    return out


def apply_color_map(planes: DataFrame, name: str) -> DataFrame:
    """8-bit single-channel planes in colour: three planes each, blue first."""
    entries = [F.array(*[F.lit(float(v)) for v in channel]) for channel in table(name)]
    made = P.let(D(), lambda d: F.array(*[F.struct(F.lit(k).alias("c"), _looked_up(d, e).alias("data")) for k, e in enumerate(entries)]))
    return planes.where("c = 0").select("img", "rows", "cols", F.explode(made).alias("_o")).select("img", "_o.c", "rows", "cols", "_o.data")


def _looked_up(d, entries):
    return F.transform(d, lambda v: F.get(entries, v.cast("int")))
