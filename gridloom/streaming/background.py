"""Foreground of streams of frames by adaptive mixtures of Gaussians, one mixture a pixel.

Frames are rows (stream, frame, rows, cols, data); data holds the channels one after the other. What is known of a pixel
depends on that pixel only, so a stream is cut into bands of rows that are worked on apart: the state of a band is what a
task holds, and bands are spread over tasks. Frames of a band are taken in rising order; one at or before the last that
was seen is late and gives nothing, and of rows with one number the first by data counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "stream long, frame long, y int, rows int, cols int, data array<double>"
_STATE = "last long, seen long, pixels int, channels int, used binary, modes binary"


@dataclass(frozen=True)
class Mixture:
    """Settings. near: variances from a mode within which a pixel is of the background; fits: within which it belongs to
    the mode at all; share: the weight of modes that make the background; prune: what a mode loses that isn't seen;
    rate: of learning, negative for one that falls with the number of frames until `history`."""

    history: int = 500
    modes: int = 5
    near: float = 16.0
    fits: float = 9.0
    share: float = 0.9
    prune: float = 0.05
    first_variance: float = 15.0
    least_variance: float = 4.0
    most_variance: float = 75.0
    shadows: bool = True
    shadow_value: float = 127.0
    darkest_shadow: float = 0.5
    rate: float = -1.0

    def __post_init__(self):
        if self.modes < 1 or self.history < 1:
            raise ValueError("at least one mode and one frame of history")


class Band:
    """The mixtures of a band's pixels: weights and variances (modes, pixels), means (modes, channels, pixels)."""

    def __init__(self, settings: Mixture, pixels: int, channels: int):
        self.s, self.seen, self.shape = settings, 0, (pixels, channels)
        self.used = np.zeros(pixels, np.int64)
        self.all = np.zeros((settings.modes, channels + 2, pixels))

    @property
    def weight(self) -> np.ndarray:
        return self.all[:, 0]

    @property
    def variance(self) -> np.ndarray:
        return self.all[:, 1]

    @property
    def mean(self) -> np.ndarray:
        return self.all[:, 2:]

    def _rise(self, at: int, weight: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Modes `at` of the pixels `who` go before all modes that don't weigh more; how many places each went."""
        places = np.zeros(len(who), np.int64)
        for k in range(at, 0, -1):
            who = who & (weight >= self.weight[k - 1])
            if not who.any():
                break
            self.all[k - 1 : k + 1, :, who] = self.all[k - 1 : k + 1, :, who][::-1]
            places += who
        return places

    def apply(self, frame: np.ndarray) -> np.ndarray:
        """The mask of a frame (channels, pixels), by which the mixtures then are changed."""
        s, every = self.s, np.arange(self.shape[0])
        self.seen += 1
        rate = s.rate if s.rate >= 0 and self.seen > 1 else 1.0 / min(2 * self.seen, s.history)
        lost = rate * s.prune
        total, back, fitted = np.zeros(len(every)), np.zeros(len(every), bool), np.zeros(len(every), bool)
        for k in range(s.modes):
            there = k < self.used
            if not there.any():
                break
            weight = (1.0 - rate) * self.weight[k] - lost
            away = self.mean[k] - frame
            far, var = (away * away).sum(axis=0), self.variance[k].copy()
            open_ = there & ~fitted
            back |= open_ & (total < s.share) & (far < s.near * var)
            fit = open_ & (far < s.fits * var)
            weight[fit] += rate
            step = np.divide(rate, weight, out=np.zeros_like(weight), where=fit)
            self.all[k, 2:] -= step * away
            self.all[k, 1] = np.where(fit, np.clip(var + step * (far - var), s.least_variance, s.most_variance), var)
            place = k - self._rise(k, weight, fit)
            fitted |= fit
            gone = there & (weight < lost)
            weight[gone] = 0.0
            self.used -= gone
            self.all[place[there], 0, every[there]] = weight[there]
            total[there] += weight[there]
        live = np.arange(s.modes)[:, None] < self.used
        inverse = np.divide(1.0, total, out=np.zeros_like(total), where=np.abs(total) > np.finfo(np.float32).eps)
        self.all[:, 0] = np.where(live, self.weight * inverse, self.weight)
        if rate > 0:
            self._add(frame, ~fitted, rate)
        mask = np.where(back, 0.0, 255.0)
        if s.shadows:
            mask[~back & self._shadow(frame)] = s.shadow_value
        return mask

    def _add(self, frame: np.ndarray, new: np.ndarray, rate: float) -> None:
        """A mode of its own for each of the new pixels, the last one's place if all are taken."""
        s = self.s
        place = np.minimum(self.used, s.modes - 1)
        self.used = np.where(new, place + 1, self.used)
        older = new & (np.arange(s.modes)[:, None] < place)
        self.all[:, 0] = np.where(older, self.weight * (1.0 - rate), self.weight)
        for k in range(s.modes):
            who = new & (place == k)
            if who.any():
                self.all[k, 0, who] = 1.0 if k == 0 else rate
                self.all[k, 1, who] = s.first_variance
                self.all[k, 2:, who] = frame[:, who].T
                self._rise(k, np.full(len(who), rate), who)

    def _shadow(self, frame: np.ndarray) -> np.ndarray:
        """Pixels that are a darker copy of a mode of the background."""
        s = self.s
        open_, found, total = np.ones(len(self.used), bool), np.zeros(len(self.used), bool), np.zeros(len(self.used))
        for k in range(s.modes):
            mean = self.mean[k]
            below, above = (mean * mean).sum(axis=0), (frame * mean).sum(axis=0)
            open_ &= (k < self.used) & (below != 0)
            part = np.divide(above, below, out=np.zeros_like(above), where=open_)
            off = ((part * mean - frame) ** 2).sum(axis=0)
            dark = open_ & (above <= below) & (above >= s.darkest_shadow * below) & (off < s.near * self.variance[k] * part * part)
            found |= dark
            total += self.weight[k]
            open_ &= ~dark & (total <= s.share)
        return found

    def background(self) -> np.ndarray:
        """The mean of the modes that make the background, (channels, pixels)."""
        total, out, open_ = np.zeros(len(self.used)), np.zeros(self.mean.shape[1:]), np.ones(len(self.used), bool)
        for k in range(self.s.modes):
            open_ &= k < self.used
            weight = np.where(open_, self.weight[k], 0.0)
            out, total = out + weight * self.mean[k], total + weight
            open_ &= total <= self.s.share
        return np.divide(out, total, out=np.zeros_like(out), where=total > 0)

    def saved(self) -> tuple:
        return (self.seen, *self.shape, self.used.tobytes(), self.all.tobytes())

    @classmethod
    def restored(cls, settings: Mixture, seen: int, pixels: int, channels: int, used: bytes, modes: bytes) -> Band:
        band = cls(settings, pixels, channels)
        band.seen, band.used = seen, np.frombuffer(used, np.int64).copy()
        band.all = np.frombuffer(modes, float).reshape(band.all.shape).copy()
        return band


def banded(frames: DataFrame, band: int = 0) -> DataFrame:
    """(stream, frame, y, rows, cols, data): frames cut into bands of `band` rows, from row y on; 0 is one band."""
    if band < 0:
        raise ValueError("a band has at least one row")
    frames = frames.where("stream IS NOT NULL AND frame IS NOT NULL AND size(data) > 0 AND rows > 0 AND cols > 0")
    height = F.col("rows") if not band else F.lit(band)
    cut = frames.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, height)))
    cut = cut.withColumn("_n", F.least(height, F.col("rows") - F.col("_y")).cast("int"))
    area = F.col("rows") * F.col("cols")
    part = lambda ch: F.slice("data", (ch * area + F.col("_y") * F.col("cols") + 1).cast("int"), (F.col("_n") * F.col("cols")).cast("int"))
    # in two steps: inside a lambda, a name that the same select also gives out would mean the new column
    cut = cut.withColumn("_part", F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size("data") / area).cast("int") - 1), part)))
    return cut.select(F.col("stream").cast("long"), F.col("frame").cast("long"), F.col("_y").alias("y"), F.col("_n").alias("rows"), F.col("cols").cast("int"), F.col("_part").alias("data"))


def _taken(band: Band | None, settings: Mixture, rows: int, cols: int, data) -> tuple[Band, np.ndarray]:
    frame = np.asarray(data, float).reshape(-1, rows * cols)
    if band is None or band.shape != frame.shape[::-1]:  # another size is another scene
        band = Band(settings, frame.shape[1], frame.shape[0])
    return band, band.apply(frame)


def foreground(frames: DataFrame, settings: Mixture = Mixture(), band: int = 0) -> DataFrame:
    """The masks (stream, frame, y, rows, cols, data) of a table of frames: 0 is background, 255 foreground.

    Bands are sorted by frame where they are and read as they come; a task holds one band's mixtures and one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, state = None, None, None
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if (r.stream, r.y) != now:
                    now, last, state = (r.stream, r.y), None, None
                if last is not None and r.frame <= last:
                    continue
                last = r.frame
                state, mask = _taken(state, settings, r.rows, r.cols, r.data)
                out.append((r.stream, r.frame, r.y, r.rows, r.cols, mask))
            yield pd.DataFrame(out, columns=["stream", "frame", "y", "rows", "cols", "data"])

    cut = banded(frames, band)
    return cut.repartition("stream", "y").sortWithinPartitions("stream", "y", "frame", "data").mapInPandas(run, _OUT)


def foreground_stream(frames: DataFrame, settings: Mixture = Mixture(), band: int = 0, idle_ms: int = 0) -> DataFrame:
    """The same of a stream of frames. The mixtures of a band are state, which a restart takes from the checkpoint.

    A band without frames for idle_ms, if that is over 0, gives one row more, frame -1, whose data is its background, and
    is forgotten; a frame that comes later begins anew. A task holds a band's share of one micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        columns = ["stream", "frame", "y", "rows", "cols", "data"]
        if state.hasTimedOut:
            held = Band.restored(settings, *state.get[1:])
            state.remove()
            data = held.background()
            yield pd.DataFrame([(key[0], -1, key[1], 1, held.shape[0], data.ravel())], columns=columns)
            return
        last, held = None, None
        if state.exists:
            last, held = state.get[0], Band.restored(settings, *state.get[1:])
        rows = pd.concat(list(batches))
        rows = rows.assign(_tie=[tuple(d) for d in rows["data"]]).sort_values(["frame", "_tie"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if last is not None and r.frame <= last:
                continue
            last = r.frame
            held, mask = _taken(held, settings, r.rows, r.cols, r.data)
            out.append((r.stream, r.frame, r.y, r.rows, r.cols, mask))
        state.update((int(last), *held.saved()))
        if idle_ms > 0:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    return banded(frames, band).groupBy("stream", "y").applyInPandasWithState(run, _OUT, _STATE, "append", "ProcessingTimeTimeout" if idle_ms > 0 else "NoTimeout")
