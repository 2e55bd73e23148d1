"""Aggregates of planes: one row per plane or image, found inside the row that holds the plane."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import planes as P
from gridloom.operators.common import COLS, D, ROWS, changed, paired

NORM_INF, NORM_L1, NORM_L2, NORM_L2SQR, NORM_HAMMING, NORM_HAMMING2, NORM_MINMAX = 1, 2, 4, 5, 6, 7, 32
SUM, AVG, MAX, MIN, SUM2 = range(5)
_INF = float("inf")


def _selected(planes: DataFrame, mask: DataFrame | None) -> tuple[DataFrame, Column]:
    if mask is None:
        return planes, D()
    both = planes.join(mask.select("img", F.col("data").alias("_m")), "img")
    return both, F.transform(F.filter(F.arrays_zip("data", "_m"), lambda t: t["_m"] != 0), lambda t: t["data"])


def mean(planes: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(img, c, mean); 0 where nothing is selected."""
    rows, values = _selected(planes, mask)
    n = F.size(values)
    return rows.select("img", "c", F.when(n > 0, P.total(values) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0)).alias("mean"))


def mean_std_dev(planes: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(img, c, mean, std_dev) with the population's standard deviation; 0 where nothing is selected."""
    rows, values = _selected(planes, mask)
    n = lambda d: F.greatest(F.size(d), F.lit(1))
    both = P.let(values, lambda d: P.let(P.total(d) / n(d), lambda m: F.struct(m.alias("mean"), F.sqrt(P.total(d, lambda v: (v - m) * (v - m)) / n(d)).alias("std_dev"))))
    return rows.select("img", "c", both.alias("_s")).select("img", "c", "_s.mean", "_s.std_dev")


def min_max_loc(planes: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(img, c, min, min_y, min_x, max, max_y, max_x): the first of ties in row-major order, NaN left out; 0 at (-1, -1) if nothing remains."""
    if mask is not None:
        planes = planes.join(mask.select("img", F.col("data").alias("_m")), "img")
    else:
        planes = planes.withColumn("_m", F.transform(D(), lambda _: F.lit(1.0)))
    cells = F.filter(F.transform(F.arrays_zip("data", "_m"), lambda t, i: F.struct(t["data"].alias("v"), i.alias("i"), t["_m"].alias("m"))), lambda t: (t["m"] != 0) & ~F.isnan(t["v"]))
    rows = planes.withColumn("_lo", F.array_min(F.transform(cells, lambda t: F.struct(t["v"].alias("v"), t["i"].alias("i"))))).withColumn("_hi", F.array_min(F.transform(cells, lambda t: F.struct((-t["v"]).alias("v"), t["i"].alias("i")))))
    y = lambda i: F.coalesce(F.floor(i / COLS()).cast("int"), F.lit(-1))
    x = lambda i: F.coalesce(F.pmod(i, COLS()), F.lit(-1))
    return rows.select(
        "img", "c", F.coalesce(F.col("_lo.v"), F.lit(0.0)).alias("min"), y(F.col("_lo.i")).alias("min_y"), x(F.col("_lo.i")).alias("min_x"),
        F.coalesce(-F.col("_hi.v"), F.lit(0.0)).alias("max"), y(F.col("_hi.i")).alias("max_y"), x(F.col("_hi.i")).alias("max_x"),
    )


def trace(planes: DataFrame) -> DataFrame:
    """(img, c, trace) along the shorter side."""
    diagonal = P.let(D(), lambda d: F.transform(F.sequence(F.lit(0), F.least(ROWS(), COLS()) - 1), lambda k: F.get(d, k * COLS() + k)))
    return planes.select("img", "c", P.total(diagonal).alias("trace"))


def reduce(planes: DataFrame, axis: int, kind: int, depth: int = N.F64) -> DataFrame:
    """axis 0 leaves one row, axis 1 one column."""
    n, across = (COLS(), ROWS()) if axis == 0 else (ROWS(), COLS())

    def line(d: Column, k: Column) -> Column:
        values = F.transform(F.sequence(F.lit(0), across - 1), lambda j: F.get(d, j * COLS() + k) if axis == 0 else F.get(d, k * COLS() + j))
        if kind == SUM:
            return P.total(values)
        if kind == SUM2:
            return P.total(values, lambda v: v * v)
        if kind == AVG:
            return N.saturate(P.total(values) / across, depth, "numeric")
        sound = F.filter(values, lambda v: ~F.isnan(v))
        return F.coalesce(F.array_max(sound) if kind == MAX else F.array_min(sound), F.lit(float("nan")))

    return changed(planes, P.let(D(), lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda k: line(d, k))), 1 if axis == 0 else ROWS(), COLS() if axis == 0 else 1)


def _norm(values: Column, kind: int) -> Column:
    if kind == NORM_INF:
        return F.coalesce(F.array_max(F.transform(values, F.abs)), F.lit(0.0))
    if kind == NORM_L1:
        return P.total(values, F.abs)
    if kind == NORM_L2:
        return F.sqrt(P.total(values, lambda v: v * v))
    if kind == NORM_L2SQR:
        return P.total(values, lambda v: v * v)
    if kind == NORM_HAMMING:
        return P.total(values, lambda v: F.bit_count(v.cast("long")).cast("double"))
    pairs = lambda v: F.bit_count(v.cast("long").bitwiseOR(F.shiftright(v.cast("long"), 1)).bitwiseAND(F.lit(0x5555)))
    return P.total(values, lambda v: pairs(v).cast("double"))


def norm(planes: DataFrame, kind: int = NORM_L2, mask: DataFrame | None = None) -> DataFrame:
    """(img, norm) over all channels."""
    rows, values = _selected(planes, mask)
    return rows.groupBy("img").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", values.alias("v")))), lambda p: p["v"])).alias("_v")).select("img", _norm(F.col("_v"), kind).alias("norm"))


def norm_diff(a: DataFrame, b: DataFrame, kind: int = NORM_L2, relative: bool = False) -> DataFrame:
    """(img, norm) of a - b, or of that relative to the norm of b; Hamming distances count differing bits."""
    both = paired(a, b)
    if kind in (NORM_HAMMING, NORM_HAMMING2):
        return norm(changed(both, F.zip_with(D(), "data2", lambda x, y: x.cast("long").bitwiseXOR(y.cast("long")).cast("double"))), kind)
    out = norm(changed(both, F.zip_with(D(), "data2", lambda x, y: x - y)), kind)
    if not relative:
        return out
    base = norm(b, kind).withColumnRenamed("norm", "_b")
    return out.join(base, "img").select("img", (F.col("norm") / (F.col("_b") + 2.220446049250313e-16)).alias("norm"))


def normalize(planes: DataFrame, alpha: float = 1.0, beta: float = 0.0, kind: int = NORM_L2, depth: int = N.F64) -> DataFrame:
    """Single-channel planes scaled to a norm of alpha, or to the range of alpha and beta; a constant plane becomes alpha."""
    if kind == NORM_MINMAX:
        low, high = min(alpha, beta), max(alpha, beta)

        def spread(v: Column, e: Column) -> Column:
            span = e["hi"] - e["lo"]
            return N.saturate(F.when(span == 0, F.lit(float(alpha))).otherwise((v - e["lo"]) * (high - low) / F.when(span == 0, F.lit(1.0)).otherwise(span) + low), depth, "numeric")

        ends = lambda d: F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi"))
        return changed(planes, P.let(D(), lambda d: P.let(ends(d), lambda e: F.transform(d, lambda v: spread(v, e)))))
    scaled = lambda v, n: N.saturate(F.when(n == 0, F.lit(0.0)).otherwise(v * alpha / F.when(n == 0, F.lit(1.0)).otherwise(n)), depth, "numeric")
    return changed(planes, P.let(D(), lambda d: P.let(_norm(d, kind), lambda n: F.transform(d, lambda v: scaled(v, n)))))


def integral(planes: DataFrame, squared: bool = False) -> DataFrame:
    """Planes of one row and column more: sums of all values above and to the left, or of their squares."""
    rows = planes.withColumn("_s", F.transform(D(), lambda v: v * v)) if squared else planes.withColumn("_s", D())
    return changed(rows, P.running(F.col("_s"), ROWS(), COLS()), ROWS() + 1, COLS() + 1)


_ORDERS = [(p, q) for n in range(4) for p, q in ((n - k, k) for k in range(n + 1))]


def moments(planes: DataFrame, binary: bool = False) -> DataFrame:
    """(img, c, m00 .. m03, mu20 .. mu03, nu20 .. nu03): raw, central and normalised moments to the third order."""
    cells = F.transform(D(), lambda v, i: F.struct(F.when(v != 0, 1.0).otherwise(0.0).alias("v") if binary else v.alias("v"), F.floor(i / COLS()).cast("double").alias("y"), F.pmod(i, COLS()).cast("double").alias("x")))
    rows = planes.withColumn("_c", cells)

    def power(t: Column, p: int) -> Column:
        out = F.lit(1.0)
        for _ in range(p):
            out = out * t
        return out

    raw = lambda p, q: F.aggregate("_c", F.lit(0.0), lambda a, t: a + t["v"] * power(t["x"], p) * power(t["y"], q))
    rows = rows.select("img", "c", *[raw(p, q).alias(f"m{p}{q}") for p, q in _ORDERS])
    m = lambda k: F.col(f"m{k}")
    flat = m("00") == 0
    inv = F.when(flat, F.lit(0.0)).otherwise(1.0 / F.when(flat, F.lit(1.0)).otherwise(m("00")))
    rows = rows.withColumns({"_x": m("10") * inv, "_y": m("01") * inv})
    x, y = F.col("_x"), F.col("_y")
    mu20, mu11, mu02 = m("20") - m("10") * x, m("11") - m("10") * y, m("02") - m("01") * y
    rows = rows.withColumns({"mu20": mu20, "mu11": mu11, "mu02": mu02})
    u = F.col
    rows = rows.withColumns({
        "mu30": m("30") - x * (3.0 * u("mu20") + x * m("10")), "mu21": m("21") - x * (2.0 * u("mu11") + x * m("01")) - y * u("mu20"),
        "mu12": m("12") - y * (2.0 * u("mu11") + y * m("10")) - x * u("mu02"), "mu03": m("03") - y * (3.0 * u("mu02") + y * m("01")),
    })
    s2, s3 = inv * inv, inv * inv * F.sqrt(F.abs(inv))
    out = [(u(f"mu{k}") * (s2 if int(k[0]) + int(k[1]) == 2 else s3)).alias(f"nu{k}") for k in ("20", "11", "02", "30", "21", "12", "03")]
    return rows.select("img", "c", *[f"m{p}{q}" for p, q in _ORDERS], *[f"mu{k}" for k in ("20", "11", "02", "30", "21", "12", "03")], *out)


def hu_moments(found: DataFrame) -> DataFrame:
    """(img, c, hu1 .. hu7) of moments()."""
    n = lambda k: F.col(f"nu{k}")
    t0, t1 = n("30") + n("12"), n("21") + n("03")
    q0, q1 = t0 * t0, t1 * t1
    n4, s, d = 4 * n("11"), n("20") + n("02"), n("20") - n("02")
    a, b = n("30") - 3 * n("12"), 3 * n("21") - n("03")
    hu = [s, d * d + n4 * n("11"), a * a + b * b, q0 + q1, a * t0 * (q0 - 3 * q1) + b * t1 * (3 * q0 - q1), d * (q0 - q1) + n4 * t0 * t1, b * t0 * (q0 - 3 * q1) - a * t1 * (3 * q0 - q1)]
    return found.select("img", "c", *[h.alias(f"hu{k}") for k, h in enumerate(hu, 1)])


def match_shapes(a: DataFrame, b: DataFrame, method: int) -> DataFrame:
    """(img, c, distance) of Hu moments of equal img and c; moments of 0 take no part."""
    both = a.join(b.select("img", "c", *[F.col(f"hu{k}").alias(f"_hu{k}") for k in range(1, 8)]), ["img", "c"])
    total = F.lit(0.0)
    for k in range(1, 8):
        x, y = F.col(f"hu{k}"), F.col(f"_hu{k}")
        sound = (F.abs(x) > 0) & (F.abs(y) > 0)
        level = lambda v: F.signum(v) * F.log10(F.when(v == 0, F.lit(1.0)).otherwise(F.abs(v)))
        p, q = level(x), level(y)
        one = lambda v: F.when(v == 0, F.lit(1.0)).otherwise(v)
        term = {1: F.abs(1 / one(q) - 1 / one(p)), 2: F.abs(q - p), 3: F.abs((p - q) / one(p))}[method]
        total = total + F.when(sound, term).otherwise(F.lit(0.0))
    return both.select("img", "c", total.alias("distance"))


def calc_hist(planes: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """(img, c, bin, n) for every bin of the half-open range, with those that are empty."""
    place = F.transform(F.filter(D(), lambda v: (v >= low) & (v < high)), lambda v: F.floor((v - low) * bins / (high - low)).cast("int"))
    rows = planes.select("img", "c", place.alias("_b"))
    counts = P.let(F.col("_b"), lambda place: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(place, lambda b: b == k))))
    return rows.select("img", "c", F.posexplode(counts).alias("bin", "n"))


def compare_hist(a: DataFrame, b: DataFrame, method: int) -> DataFrame:
    """(img, c, distance): 0 correlation, 1 chi-square, 2 intersection, 3 Bhattacharyya."""
    both = a.join(b.select("img", "c", "bin", F.col("n").alias("m")), ["img", "c", "bin"])
    x, y = F.col("n").cast("double"), F.col("m").cast("double")
    s = both.groupBy("img", "c").agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.sum(F.when(F.abs(x) > 1e-12, (x - y) * (x - y) / F.when(x == 0, F.lit(1.0)).otherwise(x)).otherwise(0.0)).alias("chi"), F.sum(F.least(x, y)).alias("low"), F.sum(F.sqrt(x * y)).alias("root"),
    )
    c = F.col
    vx, vy = c("sxx") - c("sx") * c("sx") / c("k"), c("syy") - c("sy") * c("sy") / c("k")
    bad = (vx * vy) <= 0
    corr = F.when(bad, F.lit(1.0)).otherwise((c("sxy") - c("sx") * c("sy") / c("k")) / F.sqrt(F.when(bad, F.lit(1.0)).otherwise(vx * vy)))
    mass = c("sx") * c("sy")
    bhat = F.when(mass == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - c("root") / F.sqrt(F.when(mass == 0, F.lit(1.0)).otherwise(mass)))))
    return s.select("img", "c", [corr, c("chi"), c("low"), bhat][method].alias("distance"))


def calc_back_project(planes: DataFrame, histogram: Sequence[float], low: float, high: float, scale: float = 1.0, depth: int = N.U8) -> DataFrame:
    """Channel 0 with each value replaced by its bin's entry times scale; 0 outside of the range."""
    n, entries = len(histogram), F.array(*[F.lit(float(h)) for h in histogram])
    return changed(planes.where("c = 0"), F.transform(D(), lambda v: F.when((v >= low) & (v < high), N.saturate(F.get(entries, F.floor((v - low) * n / (high - low)).cast("int")) * scale, depth, "numeric")).otherwise(F.lit(0.0))))


def equalize_hist(planes: DataFrame) -> DataFrame:
    """8-bit planes with an even distribution; a constant plane stays."""
    from gridloom.operators.kernels import equalized

    return equalized(planes)


def total(planes: DataFrame) -> DataFrame:
    """(img, c, sum)."""
    return planes.select("img", "c", P.total(D()).alias("sum"))
