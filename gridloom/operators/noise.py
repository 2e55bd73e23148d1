"""Random planes from one stream of numbers: a counter goes through a mixing function, so any place is reached at once.

Images take their numbers in order of img, each its pixels row by row and a pixel's channels in turn, as if one process
filled them all after another; every plane works its own places out and no task waits for another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions.tables import with_sum_before

#: The seed of a stream that nobody has seeded.
SEED = (1 << 64) - 1
#: The counter's step and the factors and shifts of the mixing function (SplitMix64).
_STEP = 0x9E3779B97F4A7C15
_FACTORS, _SHIFTS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)


def drawn(seed: int, places: np.ndarray) -> np.ndarray:
    """The stream's 64-bit numbers at these places, from 0."""
    z = np.uint64(seed) + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
    for factor, shift in zip(_FACTORS, _SHIFTS, strict=False):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(_SHIFTS[-1]))


def _uniform(seed: int, places: np.ndarray, middle: float = 0.0) -> np.ndarray:
    return ((drawn(seed, places) >> np.uint64(11)).astype(float) + middle) / 2.0**53


def _normal(seed: int, places: np.ndarray) -> np.ndarray:
    """Two numbers of the stream give two normal ones, by their radius and angle; the even place has the cosine."""
    first = places // 2 * 2
    radius, angle = np.sqrt(-2 * np.log(_uniform(seed, first, 0.5))), 2 * np.pi * _uniform(seed, first + 1)
    return radius * np.where(places % 2, np.sin(angle), np.cos(angle))


def _filled(planes: DataFrame, seed: int, skip: int, value, depth: int) -> DataFrame:
    images = planes.groupBy("img").agg(F.max(F.col("rows").cast("long") * F.col("cols")).alias("size"), (F.max("c") + 1).alias("channels"))
    begins = with_sum_before(images, "img", F.col("size") * F.col("channels"), "begin").select("img", "channels", "begin")
    rows = planes.select("img", "c", "rows", "cols").join(begins, "img")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            img, c, height, width, channels, begin = (x.to_numpy() for x in b.columns)
            for k in range(b.num_rows):  # one plane at a time, whatever its size
                places = skip + begin[k] + np.arange(int(height[k]) * int(width[k])) * int(channels[k]) + c[k]
                v = value(places, int(c[k]))
                if depth in N.RANGE:
                    v = np.clip(np.rint(v), *N.RANGE[depth]) + 0.0
                elif depth == N.F32:
                    v = v.astype(np.float32).astype(float)
                yield pa.RecordBatch.from_arrays([*(x.slice(k, 1) for x in b.columns[:4]), pa.array([v], pa.list_(pa.float64()))], ["img", "c", "rows", "cols", "data"])

    return rows.mapInArrow(scan, "img long, c int, rows int, cols int, data array<double>")


def _lane(values: float | Sequence[float], c: int) -> float:
    if isinstance(values, (int, float)):
        return float(values)
    return float(values[0 if len(values) == 1 else c])


def _seeded(seed: int) -> int:
    return seed & SEED


def randu(planes: DataFrame, low: float | Sequence[float], high: float | Sequence[float], seed: int = SEED, depth: int = N.F64, skip: int = 0) -> DataFrame:
    """Uniform values of the half-open range, for all channels or each; integer depths take the whole number below.

    skip numbers of the stream have been drawn before. Sizes are those of the planes, whose values aren't read.
    """
    for a, b in zip(np.atleast_1d(low), np.atleast_1d(high), strict=False):
        if not (np.isfinite(a) and np.isfinite(b) and a < b):
            raise ValueError("a range needs finite ends, the lower one first")
    whole = np.floor if depth in N.RANGE else (lambda v: v)

    def value(places: np.ndarray, c: int) -> np.ndarray:
        u = _uniform(_seeded(seed), places)
        return whole(_lane(low, c) * (1.0 - u) + _lane(high, c) * u)

    return _filled(planes, seed, skip, value, depth)


def randn(planes: DataFrame, mean: float | Sequence[float], deviation: float | Sequence[float], seed: int = SEED, depth: int = N.F64, skip: int = 0) -> DataFrame:
    """Normal values, for all channels or each; integer depths round to the nearest, ties to the even one. skip normal
    numbers have been drawn before."""
    if not np.isfinite(np.append(mean, deviation)).all() or np.min(deviation) < 0:
        raise ValueError("a normal distribution needs a finite mean and a deviation of at least 0")
    return _filled(planes, seed, skip, lambda places, c: _lane(mean, c) + _lane(deviation, c) * _normal(_seeded(seed), places), depth)
