"""Robust estimates over sets of point pairs, as relations: hypotheses are rows, scored by joins with a set's pairs.

1. Subsets are drawn from a private multiply-with-carry stream, the same for all sets of one size, so each size draws its
   subsets once. A round takes some more draws; sets that need no more leave.
2. Each drawn subset is joined with its pairs and fitted; fits of a batch are solved side by side.
3. Hypotheses meet the pairs of their set, dealt out in parts of bounded size, and an aggregate counts what lies within the
   threshold. A window over a set's draws tells which of them count, as the number of draws needed falls with each
   better one.
4. Refits are sums over the pairs that agree: moments for the linear solutions, the terms of the normal equations for each
   round of refinement.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.tables import settled

#: Fixed value: the stream's factor; it begins with all bits set.
_FACTOR = 4164903690
#: Pairs of a set that one task scores together.
PART = 65_536
#: Draws after which a round of scoring ends; the last step repeats.
ROUNDS = (32, 256, 2048)
#: Draws in a row that may be degenerate before a set is given up.
DEGENERATE = 4096
_TINY = 2.2250738585072014e-308


def subsets(n: int, members: int, distinct: bool) -> Iterator[list[int]]:
    """Subsets of 0 .. n-1 in the order of the stream, a member drawn anew while it is already there; with distinct, each
    set of members comes once."""
    state, seen, left = (1 << 64) - 1, set(), math.comb(n, members)
    while not distinct or len(seen) < left:
        out: list[int] = []
        while len(out) < members:
            state = (state & 0xFFFFFFFF) * _FACTOR + (state >> 32)
            if (k := (state & 0xFFFFFFFF) % n) not in out:
                out.append(k)
        if distinct:
            if frozenset(out) in seen:
                continue
            seen.add(frozenset(out))
        yield out


def solved(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Solutions of many systems a x = b at once, by elimination with the largest pivot; NaN where none is over `least`."""
    a, b = a.astype(float), b.astype(float)
    n, all_rows, bad = a.shape[1], np.arange(len(a)), np.zeros(len(a), bool)
    for k in range(n):
        best = k + np.abs(a[:, k:, k]).argmax(axis=1)
        for m in (a, b):
            m[all_rows, k], m[all_rows, best] = m[all_rows, best].copy(), m[all_rows, k].copy()
        bad |= ~(np.abs(a[:, k, k]) > least)
        pivot = np.where(bad, 1.0, a[:, k, k])
        factor = a[:, k + 1 :, k] / pivot[:, None]
        a[:, k + 1 :] -= factor[:, :, None] * a[:, None, k]
        b[:, k + 1 :] -= factor[:, :, None] * b[:, None, k]
    for k in range(n - 1, -1, -1):
        b[:, k] = (b[:, k] - np.einsum("ij,ijk->ik", a[:, k, k + 1 :], b[:, k + 1 :])) / np.where(bad, 1.0, a[:, k, k])[:, None]
    b[bad] = np.nan
    return b


def affine_fits(p: np.ndarray) -> np.ndarray:
    """Maps through three pairs each; p is (sets, 3, (x, y, u, v))."""
    return solved(np.concatenate([p[:, :, :2], np.ones((*p.shape[:2], 1))], axis=2), p[:, :, 2:]).transpose(0, 2, 1).reshape(-1, 6)


def _scale(mean: np.ndarray, distance: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.where(distance > _TINY, math.sqrt(2) * n / np.where(distance > _TINY, distance, 1), 1.0)
    t, back = np.zeros((len(s), 3, 3)), np.zeros((len(s), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = s
    back[:, 0, 0] = back[:, 1, 1] = 1 / s
    t[:, :2, 2], back[:, :2, 2] = -s[:, None] * mean, mean
    t[:, 2, 2] = back[:, 2, 2] = 1
    return t, back


def _from_moments(moments: np.ndarray, source: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Homographies of least algebraic error; moments is (sets, 4, 3, 3): the sums of w p p' for w = 1, u, v, u2 + v2."""
    s, u, v, w = moments.transpose(1, 0, 2, 3)
    zero = np.zeros_like(s)
    normal = np.block([[s, zero, -u], [zero, s, -v], [-u, -v, w]])
    h = back @ np.linalg.eigh(normal)[1][:, :, 0].reshape(-1, 3, 3) @ source
    last = h[:, 2:, 2:]
    return (h / np.where(np.abs(last) > 1e-15, last, 1.0)).reshape(-1, 9)


def homography_fits(p: np.ndarray) -> np.ndarray:
    """Homographies through four pairs each, by the normalised linear solution."""
    n = np.full(len(p), float(p.shape[1]))
    mean = p.mean(axis=1)
    away = p - mean[:, None]
    source, _ = _scale(mean[:, :2], np.hypot(away[:, :, 0], away[:, :, 1]).sum(axis=1), n)
    target, back = _scale(mean[:, 2:], np.hypot(away[:, :, 2], away[:, :, 3]).sum(axis=1), n)
    q = np.concatenate([away[:, :, :2] * source[:, None, :1, 0], np.ones((*p.shape[:2], 1))], axis=2)
    uv = away[:, :, 2:] * target[:, None, :1, 0]
    weights = np.stack([np.ones(p.shape[:2]), uv[:, :, 0], uv[:, :, 1], (uv**2).sum(axis=2)], axis=1)
    return _from_moments(np.einsum("swk,ski,skj->swij", weights, q, q), source, back)


def _sound(p: np.ndarray) -> np.ndarray:
    """Whether no three of four source points lie on a line."""
    ok = np.ones(len(p), bool)
    for a, b, c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        d, e = p[:, b, :2] - p[:, a, :2], p[:, c, :2] - p[:, a, :2]
        ok &= np.abs(d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]) > np.finfo(float).eps
    return ok


class Kind:
    """What differs between the models."""

    def __init__(self, members: int, fits: Callable[[np.ndarray], np.ndarray], error: Callable[[Column], Column], skips: bool):
        self.members, self.fits, self.error, self.skips = members, fits, error, skips


def _m(model: Column, k: int) -> Column:
    return F.get(model, F.lit(k))


def _affine_error(m: Column) -> Column:
    x, y = F.col("x"), F.col("y")
    return F.hypot(_m(m, 0) * x + _m(m, 1) * y + _m(m, 2) - F.col("u"), _m(m, 3) * x + _m(m, 4) * y + _m(m, 5) - F.col("v"))


def _homography_error(m: Column) -> Column:
    x, y = F.col("x"), F.col("y")
    w = _m(m, 6) * x + _m(m, 7) * y + _m(m, 8)
    safe = F.when(F.abs(w) < 1e-15, F.lit(1.0)).otherwise(w)
    e = F.hypot((_m(m, 0) * x + _m(m, 1) * y + _m(m, 2)) / safe - F.col("u"), (_m(m, 3) * x + _m(m, 4) * y + _m(m, 5)) / safe - F.col("v"))
    return F.when(F.abs(w) < 1e-15, F.lit(float("inf"))).otherwise(e)


#: Degenerate subsets of an affine map use up a draw; those of a homography are skipped.
AFFINE = Kind(3, affine_fits, _affine_error, False)
HOMOGRAPHY = Kind(4, homography_fits, _homography_error, True)


def indexed(pairs: DataFrame, narrow: bool = False) -> DataFrame:
    """(set_id, idx, n, x, y, u, v): pairs numbered from 0 in the order of pos; with narrow, as 32-bit floats hold them."""
    whole = Window.partitionBy("set_id")
    cast = (lambda c: F.col(c).cast("float").cast("double").alias(c)) if narrow else (lambda c: F.col(c).cast("double").alias(c))
    return settled(pairs.select("set_id", F.row_number().over(whole.orderBy("pos")).cast("long").alias("idx"), F.count(F.lit(1)).over(whole).alias("n"), *map(cast, "xyuv")).withColumn("idx", F.col("idx") - 1))


def _drawn(sizes: DataFrame, kind: Kind, low: int, high: int) -> DataFrame:
    """(n, draw, k, idx): members k of the draws low .. high-1 for each size n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                found = [list(range(n))] if n == kind.members and kind.skips else list(islice(subsets(n, kind.members, not kind.skips), high))
                rows = np.array(found[low:], np.int64).reshape(-1, kind.members)
                d, k = np.indices(rows.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.size, n)), pa.array(d.ravel() + low), pa.array(k.ravel()), pa.array(rows.ravel())], ["n", "draw", "k", "idx"])

    return sizes.mapInArrow(run, "n long, draw long, k long, idx long")


def _fitted(chosen: DataFrame, pairs: DataFrame, kind: Kind) -> DataFrame:
    """(set_id, draw, model) for chosen members (set_id, draw, k, idx); the model is null where a subset is degenerate."""
    members = chosen.join(pairs.drop("n"), ["set_id", "idx"]).groupBy("set_id", "draw").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "u", "v"))).alias("p"))
    flat = members.select("set_id", "draw", F.flatten(F.transform("p", lambda t: F.array(t["x"], t["y"], t["u"], t["v"]))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, kind.members, 4)
            models = kind.fits(p) if len(p) else np.zeros((0, 1))
            good = np.isfinite(models).all(axis=1) & (_sound(p) if kind.skips else True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m if ok else None for m, ok in zip(models.tolist(), good.tolist(), strict=True)], pa.list_(pa.float64()))], ["set_id", "draw", "model"])

    return flat.mapInArrow(run, f"set_id {flat.schema['set_id'].dataType.simpleString()}, draw long, model array<double>")


def _met(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each model (set_id, n, model, ...) with every pair of its set, parts of the set apart from each other."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART)))
    return models.withColumn("_part", parts).join(pairs.drop("n").withColumn("_part", F.floor(F.col("idx") / PART)), ["set_id", "_part"]).drop("_part")


def _needed(best: Column, n: Column, members: int, rounds: int, confidence: float) -> Column:
    """Draws needed once `best` of n pairs agree; never more than rounds."""
    missed = 1 - F.pow(best / n, F.lit(float(members)))
    top = max(1 - confidence, _TINY)
    if top >= 1 - 1e-10:
        few = F.lit(1)
    else:
        few = F.when(missed <= _TINY, 1).otherwise(F.greatest(F.lit(1), F.round(F.lit(math.log(top)) / F.log(F.greatest(missed, F.lit(_TINY))))))
    return F.when(best > 0, F.least(F.lit(rounds).cast("double"), few.cast("double"))).otherwise(F.lit(float(rounds)))


def ransac(pairs: DataFrame, kind: Kind, threshold: float, rounds: int, confidence: float) -> DataFrame:
    """(set_id, n, model) of the first hypothesis that most pairs agree with; pairs as indexed() gives them."""
    sets = pairs.where(f"idx = 0 AND n >= {kind.members}").select("set_id", "n")
    state = settled(sets.select("set_id", "n", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("best"), F.lit(None).cast("array<double>").alias("model"), F.lit(0).cast("long").alias("since"), F.lit(False).alias("done")))
    low, step = 0, 0
    while state.where("NOT done").limit(1).count():
        high = ROUNDS[step] if step < len(ROUNDS) else low + ROUNDS[-1]
        open_sets = state.where("NOT done")
        draws = _drawn(open_sets.select("n").distinct(), kind, low, high)
        fits = settled(_fitted(open_sets.select("set_id", "n").join(draws, "n").drop("n"), pairs, kind))
        agree = F.sum((kind.error(F.col("model")) < threshold).cast("long")).alias("count")
        counts = _met(fits.where("model IS NOT NULL").join(open_sets.select("set_id", "n"), "set_id"), pairs).groupBy("set_id", "draw").agg(agree)
        order = Window.partitionBy("set_id").orderBy("draw")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        seen = fits.join(counts, ["set_id", "draw"], "left").join(open_sets.select("set_id", "n", "used", F.col("best").alias("held")), "set_id")
        costs = F.when(F.lit(kind.skips) & F.col("model").isNull(), 0).otherwise(1)
        seen = seen.withColumns({"count": F.coalesce("count", F.lit(0)), "cost": costs}).withColumns({"spent": F.col("used") + F.coalesce(F.sum("cost").over(before), F.lit(0)), "top": F.greatest("held", F.coalesce(F.max("count").over(before), F.lit(0)))})
        seen = seen.withColumn("in", F.col("spent") < _needed(F.col("top"), F.col("n"), kind.members, rounds, confidence))
        found = seen.groupBy("set_id").agg(
            F.max(F.when(F.col("in"), F.struct(F.col("count").alias("count"), (-F.col("draw")).alias("at"), "model"))).alias("won"), F.sum("cost").alias("cost"), F.min("in").alias("all_in"),
            F.count(F.lit(1)).alias("drawn"), F.max(F.when(F.col("cost") > 0, F.col("draw"))).alias("last"),
        )
        joined = state.join(found, "set_id", "left")
        better = F.coalesce(F.col("won.count") > F.col("best"), F.lit(False))
        since = F.when(F.col("last").isNull(), F.col("since") + F.lit(high - low)).otherwise(F.lit(high - 1) - F.col("last"))
        over = F.col("done") | F.col("drawn").isNull() | (F.coalesce("drawn", F.lit(0)) < high - low) | ~F.coalesce("all_in", F.lit(True)) | (since >= DEGENERATE)
        state = settled(
            joined.select(
                "set_id", "n", (F.col("used") + F.coalesce("cost", F.lit(0))).alias("used"), F.when(better, F.col("won.count")).otherwise(F.col("best")).alias("best"),
                F.when(better, F.col("won.model")).otherwise(F.col("model")).alias("model"), F.when(F.col("done"), F.col("since")).otherwise(since).cast("long").alias("since"), over.alias("done"),
            )
        )
        low, step = high, step + 1
    return state.where("model IS NOT NULL").select("set_id", "n", "model")


def lmeds(pairs: DataFrame, kind: Kind) -> DataFrame:
    """(set_id, n, model, median) of the first hypothesis, of all subsets in the order of their members, whose median
    error is least. All subsets are looked at: for sets of dozens of pairs, not of millions."""
    subsets_of = pairs.where(f"idx = 0 AND n >= {kind.members}").select("set_id", "n")
    for k in range(kind.members):
        least = F.lit(0).cast("long") if k == 0 else F.col(f"i{k - 1}") + 1
        subsets_of = subsets_of.withColumn(f"i{k}", F.explode(F.sequence(least, F.col("n") - (kind.members - k))))
    draw = F.lit(0).cast("decimal(38,0)")
    for k in range(kind.members):
        draw = draw * F.col("n") + F.col(f"i{k}")
    listed = subsets_of.select("set_id", draw.cast("long").alias("draw"), F.posexplode(F.array(*[f"i{k}" for k in range(kind.members)])).alias("k", "idx"))
    fits = settled(_fitted(listed.withColumn("k", F.col("k").cast("long")), pairs, kind).where("model IS NOT NULL"))
    sizes = pairs.where("idx = 0").select("set_id", "n")
    errors = _met(fits.join(sizes, "set_id"), pairs).groupBy("set_id", "n", "draw").agg(F.array_sort(F.collect_list(kind.error(F.col("model")))).alias("e"))
    medians = errors.select("set_id", "n", "draw", F.get("e", F.floor(F.col("n") / 2).cast("int")).alias("median"))
    best = medians.where("NOT isnan(median)").groupBy("set_id", "n").agg(F.min(F.struct("median", "draw")).alias("b")).select("set_id", "n", "b.median", "b.draw")
    return settled(best.join(fits, ["set_id", "draw"]).select("set_id", "n", "model", "median"))


def marked(pairs: DataFrame, models: DataFrame, kind: Kind, threshold: Column | float) -> DataFrame:
    """pairs with `inlier`: whether the set's model brings them under the threshold; false where a set has none."""
    met = _met(models, pairs).select("set_id", "idx", (kind.error(F.col("model")) < threshold).alias("_in"))
    return pairs.join(met, ["set_id", "idx"], "left").withColumn("inlier", F.coalesce("_in", F.lit(False))).drop("_in")


def _per_set(rows: DataFrame, run: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """(set_id, model) from rows of numbers, one per set: run gets the columns of a batch and gives a row of numbers each."""
    names = rows.columns[1:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = run({c: b.column(k + 1).to_numpy(zero_copy_only=False) for k, c in enumerate(names)})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r if np.isfinite(r).all() else None for r in out], pa.list_(pa.float64()))], ["set_id", "model"])

    return rows.mapInArrow(scan, f"set_id {rows.schema['set_id'].dataType.simpleString()}, model array<double>")


def affine_refit(pairs: DataFrame) -> DataFrame:
    """(set_id, model): the maps of least squares over all rows of a set, from nine sums."""
    p, q = {"x": F.col("x"), "y": F.col("y"), "1": F.lit(1.0)}, {"u": F.col("u"), "v": F.col("v")}
    terms = [F.sum(p[a] * p[b]).alias(a + b) for a, b in ("xx", "xy", "yy", "x1", "y1", "11")] + [F.sum(p[a] * q[b]).alias(a + b) for a in p for b in q]

    def run(s: dict[str, np.ndarray]) -> np.ndarray:
        a = np.array([[s["xx"], s["xy"], s["x1"]], [s["xy"], s["yy"], s["y1"]], [s["x1"], s["y1"], s["11"]]]).transpose(2, 0, 1)
        b = np.array([[s["xu"], s["xv"]], [s["yu"], s["yv"]], [s["1u"], s["1v"]]]).transpose(2, 0, 1)
        return solved(a, b).transpose(0, 2, 1).reshape(-1, 6)

    return _per_set(pairs.groupBy("set_id").agg(*terms), run)


def homography_linear(pairs: DataFrame) -> DataFrame:
    """(set_id, model): the normalised linear solution over all rows of a set of at least four, from sums."""
    means = pairs.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyuv"]).where("n >= 4")
    away = pairs.drop("n").join(means, "set_id").withColumns({f"d{c}": F.col(c) - F.col(f"m{c}") for c in "xyuv"})
    spread = away.groupBy("set_id").agg(F.sum(F.hypot("dx", "dy")).alias("ds"), F.sum(F.hypot("du", "dv")).alias("dt"))
    scaled = away.join(spread, "set_id").withColumns({f"s{k}": F.when(F.col(f"d{k}") > _TINY, math.sqrt(2.0) * F.col("n") / F.col(f"d{k}")).otherwise(1.0) for k in "st"})
    p = [F.col("dx") * F.col("ss"), F.col("dy") * F.col("ss"), F.lit(1.0)]
    u, v = F.col("du") * F.col("st"), F.col("dv") * F.col("st")
    weights = [F.lit(1.0), u, v, u * u + v * v]
    terms = [F.sum(w * p[i] * p[j]).alias(f"t{k}{i}{j}") for k, w in enumerate(weights) for i in range(3) for j in range(i, 3)]
    sums = scaled.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "mx", "my", "mu", "mv", "ds", "dt")], *terms)

    def run(s: dict[str, np.ndarray]) -> np.ndarray:
        n = s["n"].astype(float)
        source, _ = _scale(np.stack([s["mx"], s["my"]], axis=1), s["ds"], n)
        _, back = _scale(np.stack([s["mu"], s["mv"]], axis=1), s["dt"], n)
        moments = np.array([[[s[f"t{k}{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)] for k in range(4)]).transpose(3, 0, 1, 2)
        return _from_moments(moments, source, back) if len(n) else np.zeros((0, 9))

    return _per_set(sums, run)


#: Dampings tried side by side, each ten times the one before; how often more are tried; rounds of refinement at most.
_TRIES, _BLOCKS, _REFINEMENTS = 16, 5, 200


def refined(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, model): homographies moved to the least sum of squared distances over the pairs of their set.

    Each round sums the normal equations of all sets that still move, and then the errors of the candidates that a
    damped step gives for rising dampings; the first that is better is taken. A set rests when none is, or when a step
    no longer changes the model.
    """
    sizes = pairs.groupBy("set_id").agg((F.max("idx") + 1).alias("n"))
    state = models.where(F.abs(_m(F.col("model"), 8)) >= 1e-15).join(sizes, "set_id")
    state = settled(state.select("set_id", "n", F.slice(F.transform("model", lambda v: v / F.element_at("model", 9)), 1, 8).alias("h"), F.lit(1e-8).alias("damping"), F.lit(0).alias("block"), F.lit(False).alias("rest")))
    for _ in range(_REFINEMENTS):
        moving = state.where("NOT rest")
        if not moving.limit(1).count():
            break
        h, x, y = F.col("h"), F.col("x"), F.col("y")
        w = _m(h, 6) * x + _m(h, 7) * y + 1
        place = _met(moving, pairs).withColumns({"w": w, "a": (_m(h, 0) * x + _m(h, 1) * y + _m(h, 2)) / w, "b": (_m(h, 3) * x + _m(h, 4) * y + _m(h, 5)) / w})
        place = place.withColumns({"q0": x / F.col("w"), "q1": y / F.col("w"), "q2": 1 / F.col("w"), "ru": F.col("a") - F.col("u"), "rv": F.col("b") - F.col("v")})
        q, a, b, ru, rv = [F.col(f"q{k}") for k in range(3)], F.col("a"), F.col("b"), F.col("ru"), F.col("rv")
        terms = [F.sum(q[i] * q[j]).alias(f"qq{i}{j}") for i in range(3) for j in range(i, 3)]
        terms += [F.sum(-f * q[i] * q[j]).alias(f"{n}{i}{j}") for n, f in (("a", a), ("b", b)) for i in range(3) for j in range(2)]
        terms += [F.sum((a * a + b * b) * q[i] * q[j]).alias(f"ab{i}{j}") for i in range(2) for j in range(i, 2)]
        terms += [F.sum(q[i] * r).alias(f"g{n}{i}") for n, r in (("u", ru), ("v", rv)) for i in range(3)] + [F.sum(-(a * ru + b * rv) * q[i]).alias(f"gh{i}") for i in range(2)]
        sums = place.groupBy("set_id").agg(F.sum(ru * ru + rv * rv).alias("error"), F.min(F.abs("w")).alias("least"), *terms)

        def steps(s: dict[str, np.ndarray]) -> np.ndarray:
            k, normal = len(s["error"]), np.zeros((len(s["error"]), 8, 8))
            for i in range(3):
                for j in range(3):
                    normal[:, i, j] = normal[:, 3 + i, 3 + j] = s[f"qq{min(i, j)}{max(i, j)}"]
                for j in range(2):
                    normal[:, i, 6 + j] = normal[:, 6 + j, i] = s[f"a{i}{j}"]
                    normal[:, 3 + i, 6 + j] = normal[:, 6 + j, 3 + i] = s[f"b{i}{j}"]
            for i in range(2):
                for j in range(2):
                    normal[:, 6 + i, 6 + j] = s[f"ab{min(i, j)}{max(i, j)}"]
            gradient = np.stack([s[c] for c in ("gu0", "gu1", "gu2", "gv0", "gv1", "gv2", "gh0", "gh1")], axis=1)
            h = np.stack([np.asarray(v, float) for v in s["h"]]) if k else np.zeros((0, 8))
            out = []
            for t in range(_TRIES):
                damping = s["damping"] * 10.0**t
                step = solved(normal + damping[:, None, None] * np.eye(8), gradient[:, :, None], 1e-18)[:, :, 0]
                out.append(np.where(np.isfinite(step), h - step, 1e308))
            return np.concatenate(out, axis=1)

        tried = settled(_per_set(sums.join(moving.select("set_id", "h", "damping"), "set_id").where("least >= 1e-15"), steps).withColumnRenamed("model", "tries"))
        listed = tried.join(moving.select("set_id", "n"), "set_id").select("set_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(_TRIES - 1)), lambda t: F.slice("tries", t * 8 + 1, 8))).alias("t", "g"))
        g = F.col("g")
        gw = _m(g, 6) * x + _m(g, 7) * y + 1
        du, dv = (_m(g, 0) * x + _m(g, 1) * y + _m(g, 2)) / F.nullif(gw, F.lit(0.0)) - F.col("u"), (_m(g, 3) * x + _m(g, 4) * y + _m(g, 5)) / F.nullif(gw, F.lit(0.0)) - F.col("v")
        errors = _met(listed, pairs).groupBy("set_id", "t").agg(F.sum(du * du + dv * dv).alias("e"))
        taken = errors.join(sums.select("set_id", "error"), "set_id").where("e < error").groupBy("set_id").agg(F.min("t").alias("t"))
        moved = state.join(tried, "set_id", "left").join(taken, "set_id", "left").withColumn("new", F.slice("tries", F.coalesce("t", F.lit(0)) * 8 + 1, 8))
        still = F.coalesce(F.aggregate(F.arrays_zip("new", "h"), F.lit(True), lambda s, z: s & (F.abs(z["new"] - z["h"]) <= 1e-11 * F.greatest(F.lit(1e-3), F.abs(z["h"])))), F.lit(True))
        took = F.col("t").isNotNull()
        state = settled(
            moved.select(
                "set_id", "n", F.when(took & ~F.col("rest"), F.col("new")).otherwise(F.col("h")).alias("h"),
                F.when(took, F.greatest(F.lit(1e-50), F.col("damping") * F.pow(F.lit(10.0), F.col("t").cast("double")) * 0.3)).otherwise(F.col("damping") * 10.0**_TRIES).alias("damping"),
                F.when(took, 0).otherwise(F.col("block") + 1).alias("block"), (F.col("rest") | F.col("tries").isNull() | still | (~took & (F.col("block") + 1 >= _BLOCKS))).alias("rest"),
            )
        )
    done = state.select("set_id", F.concat("h", F.array(F.lit(1.0))).alias("moved"))
    return models.join(done, "set_id", "left").select("set_id", F.coalesce("moved", "model").alias("model"))


def affine(pairs: DataFrame, method: str = "ransac", threshold: float = 3.0, rounds: int = 2000, confidence: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(set_id, model) and the indexed pairs with `inlier`: affine maps from (x, y) to (u, v) of each set.

    Methods: "ransac", "lmeds", and "all", which fits all pairs. Inliers are those of the hypothesis that won; the map is
    the least-squares fit over them. Sets of fewer than three pairs, without a sound hypothesis or with fewer than three
    inliers have no map.
    """
    known = indexed(pairs)
    if method == "all":
        return affine_refit(known.where("n >= 3")), known.withColumn("inlier", F.col("n") >= 3)
    if method not in ("ransac", "lmeds"):
        raise ValueError(f"no method {method!r}")
    models = ransac(known, AFFINE, threshold, rounds, confidence) if method == "ransac" else lmeds(known, AFFINE)
    flagged = settled(marked(known, models, AFFINE, threshold))
    agreed = flagged.where("inlier")
    enough = agreed.groupBy("set_id").count().where("count >= 3").select("set_id")
    return affine_refit(agreed.join(enough, "set_id", "left_semi")), flagged


def homography(pairs: DataFrame, method: str = "all", threshold: float = 3.0, rounds: int = 2000, confidence: float = 0.99, refine: bool = True) -> tuple[DataFrame, DataFrame]:
    """(set_id, model) and the indexed pairs with `inlier`: homographies from (x, y) to (u, v) of each set.

    Methods: "all", "ransac", "rho" (as "ransac") and "lmeds". Coordinates are taken as 32-bit floats. The model is the
    linear solution over the inliers, moved to the least reprojection error; without refine it stays. For "lmeds" it is
    fitted to what lies within the scale that the median tells, and for "all" the inliers are those of the result. Sets of
    fewer than four pairs have no model.
    """
    known = indexed(pairs, narrow=True)
    polish = (lambda m, p: refined(settled(m), p)) if refine else (lambda m, p: m)
    if method == "all":
        models = settled(polish(homography_linear(known), known.where("n >= 4")))
        sized = models.where("model IS NOT NULL").join(known.where("idx = 0").select("set_id", "n"), "set_id")
        return models, marked(known, sized, HOMOGRAPHY, threshold)
    if method in ("ransac", "rho"):
        flagged = settled(marked(known, ransac(known, HOMOGRAPHY, threshold, rounds, confidence), HOMOGRAPHY, threshold))
        agreed = flagged.where("inlier").drop("inlier")
        return polish(homography_linear(agreed), agreed), flagged
    if method != "lmeds":
        raise ValueError(f"no method {method!r}")
    best = lmeds(known, HOMOGRAPHY)
    bound = F.least(F.lit(threshold), 3 * 1.4826 * (1 + 5 / F.greatest(F.col("n") - 4, F.lit(1))) * F.col("median"))
    near = settled(_met(best, known).where(HOMOGRAPHY.error(F.col("model")) < bound).select(known.columns))
    models = best.select("set_id", "model").join(homography_linear(near).withColumnRenamed("model", "linear"), "set_id", "left").select("set_id", F.coalesce("linear", "model").alias("model"))
    return polish(models, near), marked(known, best.drop("median"), HOMOGRAPHY, threshold)
