"""Registered queries of descriptors and exposures and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import planes as P
from gridloom.operators import alignment as A
from gridloom.operators import circles as R
from gridloom.operators import exposures as E
from gridloom.operators import matching as H
from gridloom.operators import neighbourhood as W
from gridloom.plans.fixtures import COLOR, EIGHT, binary, color, eight, pixels, pixels_sql, real, taps_sql
from gridloom.streaming import background as B

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# descriptors: the signs of an embedding's 64 values
_WORDS = "SELECT vec_id AS k, CAST(sum(CASE WHEN e > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END) AS HUGEINT) AS w FROM (SELECT vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings WHERE len(embedding) = 64) GROUP BY vec_id"
_APART = f"SELECT q.k AS query, t.k AS train, CAST(bit_count(xor(q.w, t.w)) AS INTEGER) AS distance FROM ({_WORDS}) q CROSS JOIN ({_WORDS}) t"
_NEAREST = f"SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, train) AS INTEGER) AS rank FROM ({_APART})"


def _descriptors(spark, sf_dir: str) -> DataFrame:
    return H.signed(real(spark, sf_dir))


QUERIES["knn_match"] = lambda spark, d: H.knn_match(_descriptors(spark, d), _descriptors(spark, d), 4)
SQL["knn_match"] = f"SELECT query, train, distance, rank FROM ({_NEAREST}) WHERE rank <= 4"
QUERIES["radius_match"] = lambda spark, d: H.radius_match(_descriptors(spark, d), _descriptors(spark, d), 20)
SQL["radius_match"] = f"SELECT * FROM ({_APART}) WHERE distance <= 20"


def _nearest_other(spark, sf_dir: str) -> DataFrame:
    """Even images are matched against odd ones."""
    both = _descriptors(spark, sf_dir)
    return H.match(both.where("key % 2 = 0"), both.where("key % 2 = 1"), True)


_HALVES = f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, train) AS there, row_number() OVER (PARTITION BY train ORDER BY distance, query) AS back FROM ({_APART}) WHERE query % 2 = 0 AND train % 2 = 1"
QUERIES["match_cross_check"] = _nearest_other
SQL["match_cross_check"] = f"SELECT query, train, distance FROM ({_HALVES}) WHERE there = 1 AND back = 1"

# exposures: three colour images are a scene, each four times as long as the one before
_SECONDS = "power(4, img % 3) / 16.0"


def _shots(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    planes = color(spark, sf_dir)
    return planes, planes.select("img", F.floor(F.col("img") / 3).alias("scene"), F.expr(_SECONDS).alias("seconds")).distinct()


QUERIES["merge_debevec"] = lambda spark, d: pixels(E.merge_debevec(*_shots(spark, d)))
_TRUST = f"SELECT img, y, x, avg(CASE WHEN v < 128 THEN v + 1 ELSE 256 - v END) AS w FROM ({COLOR}) GROUP BY img, y, x"
SQL["merge_debevec"] = pixels_sql(f"SELECT p.img // 3 AS img, c, p.y, p.x, exp(sum(w * (ln(greatest(1, v)) - ln(power(4, p.img % 3) / 16.0))) / sum(w)) AS v FROM ({COLOR}) p JOIN ({_TRUST}) t ON t.img = p.img AND t.y = p.y AND t.x = p.x GROUP BY p.img // 3, c, p.y, p.x")

_BINOMIAL = W._offsets(W._outer(W._FIVE, W._FIVE))


def _down(px: str, n: int) -> str:
    return f"SELECT img, c, y // 2 AS y, x // 2 AS x, v / 256 AS v FROM ({taps_sql(px, _BINOMIAL, P.REFLECT_101, rows=n, cols=n)}) WHERE y % 2 = 0 AND x % 2 = 0"


def _up(px: str, n: int) -> str:
    spread = f"SELECT g.img, g.c, g.y, g.x, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT img, c, j AS y, i AS x FROM {px} CROSS JOIN range(0, {2 * n}) a(j) CROSS JOIN range(0, {2 * n}) b(i)) g LEFT JOIN {px} s ON s.img = g.img AND s.c = g.c AND 2 * s.y = g.y AND 2 * s.x = g.x"
    return f"SELECT img, c, y, x, v / 64 AS v FROM ({taps_sql(spread, _BINOMIAL, P.REFLECT_101, rows=2 * n, cols=2 * n)})"


def _fusion_sql() -> str:
    """The pyramid of 8, 4, 2 and 1 pixels a side, step by step."""
    cross = taps_sql("SELECT img, 0 AS c, y, x, v FROM gray", [(0, 0, -4.0), (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)], P.REFLECT_101)
    steps = [
        ("i8", f"SELECT img, c, y, x, v / 255 AS v FROM ({COLOR})"),
        ("gray", "SELECT img, y, x, sum(v * CASE c WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END) AS v, sqrt(3 * var_pop(v)) AS s, exp(-sum((v - 0.5) * (v - 0.5)) / 0.08) AS m FROM i8 GROUP BY img, y, x"),
        ("worth", f"SELECT e.img, e.y, e.x, abs(e.v) * s * m + 1e-12 AS v FROM ({cross}) e JOIN gray g ON g.img = e.img AND g.y = e.y AND g.x = e.x"),
        ("w8", "SELECT img, 0 AS c, y, x, v / sum(v) OVER (PARTITION BY img // 3, y, x) AS v FROM worth"),
    ]
    for n in (8, 4, 2):
        steps += [(f"i{n // 2}", _down(f"(SELECT * FROM i{n})", n)), (f"w{n // 2}", _down(f"(SELECT * FROM w{n})", n))]
        steps.append((f"d{n}", f"SELECT i.img, i.c, i.y, i.x, i.v - u.v AS v FROM i{n} i JOIN ({_up(f'(SELECT * FROM i{n // 2})', n // 2)}) u ON u.img = i.img AND u.c = i.c AND u.y = i.y AND u.x = i.x"))
    steps.append(("d1", "SELECT * FROM i1"))
    for n in (8, 4, 2, 1):
        steps.append((f"b{n}", f"SELECT d.img // 3 AS img, d.c, d.y, d.x, sum(d.v * w.v) AS v FROM d{n} d JOIN w{n} w ON w.img = d.img AND w.y = d.y AND w.x = d.x GROUP BY d.img // 3, d.c, d.y, d.x"))
    steps.append(("o1", "SELECT * FROM b1"))
    for n in (2, 4, 8):
        steps.append((f"o{n}", f"SELECT b.img, b.c, b.y, b.x, b.v + u.v AS v FROM b{n} b JOIN ({_up(f'(SELECT * FROM o{n // 2})', n // 2)}) u ON u.img = b.img AND u.c = b.c AND u.y = b.y AND u.x = b.x"))
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps) + " " + pixels_sql("SELECT * FROM o8")


QUERIES["merge_mertens"] = lambda spark, d: pixels(E.merge_mertens(*_shots(spark, d)))
SQL["merge_mertens"] = _fusion_sql()
#: By least squares over sums of all pixels; tested against the whole system of equations.
QUERIES["calibrate_debevec"] = lambda spark, d: E.calibrate_debevec(*_shots(spark, d)).select("c", "level", F.round("response", 6).alias("response"))

# circles: edges are the pixels over 127
_DP, _FAR, _OVER, _LEAST, _MOST = 1.0, 2.5, 3, 1, 4


def _circles_sql() -> str:
    slope = lambda down: [(i - 1, j - 1, float((a * b) if down else (b * a))) for i, a in enumerate((-1, 0, 1) if down else (1, 2, 1)) for j, b in enumerate((1, 2, 1) if down else (-1, 0, 1))]
    cell = lambda p, d: f"CAST(floor({p} / {_DP} + 0.5 + r * {d} / (sqrt(dx * dx + dy * dy) * {_DP})) AS INTEGER)"
    at = lambda dy, dx: f"coalesce((SELECT n.votes FROM votes n WHERE n.img = v.img AND n.cy = v.cy + {dy} AND n.cx = v.cx + {dx}), 0)"
    steps = [
        ("edge", f"SELECT e.img, e.y, e.x, a.v AS dx, b.v AS dy FROM ({EIGHT}) e JOIN ({taps_sql(EIGHT, slope(False), P.REFLECT_101)}) a ON a.img = e.img AND a.y = e.y AND a.x = e.x JOIN ({taps_sql(EIGHT, slope(True), P.REFLECT_101)}) b ON b.img = e.img AND b.y = e.y AND b.x = e.x WHERE e.v > 127 AND (a.v <> 0 OR b.v <> 0)"),
        ("cast_", f"SELECT img, {cell('y', 'dy')} AS cy, {cell('x', 'dx')} AS cx FROM edge CROSS JOIN (SELECT s * k AS r FROM range({_LEAST}, {_MOST + 1}) a(k) CROSS JOIN (VALUES (-1), (1)) b(s))"),
        ("votes", "SELECT img, cy, cx, count(*) AS votes FROM cast_ WHERE cy BETWEEN 0 AND 7 AND cx BETWEEN 0 AND 7 GROUP BY img, cy, cx"),
        ("peak", f"SELECT img, votes, (cy + 0.5) * {_DP} AS y, (cx + 0.5) * {_DP} AS x, row_number() OVER (PARTITION BY img ORDER BY votes DESC, cy, cx) AS place FROM votes v WHERE votes > {_OVER} AND votes > {at(0, -1)} AND votes > {at(-1, 0)} AND votes >= {at(0, 1)} AND votes >= {at(1, 0)}"),
        # one peak after the other, with the places of those chosen so far
        ("choice", f"SELECT img, CAST(0 AS BIGINT) AS place, CAST([] AS DOUBLE[]) AS ys, CAST([] AS DOUBLE[]) AS xs FROM peak GROUP BY img UNION ALL SELECT g.img, p.place, CASE WHEN ok THEN list_append(ys, CAST(p.y AS DOUBLE)) ELSE ys END, CASE WHEN ok THEN list_append(xs, CAST(p.x AS DOUBLE)) ELSE xs END FROM choice g JOIN (SELECT * FROM peak) p ON p.img = g.img AND p.place = g.place + 1, LATERAL (SELECT len(list_filter(range(1, len(g.ys) + 1), lambda k: (g.ys[k] - p.y) * (g.ys[k] - p.y) + (g.xs[k] - p.x) * (g.xs[k] - p.x) < {_FAR * _FAR})) = 0 AS ok)"),
        ("chosen", "SELECT img, unnest(ys) AS y, unnest(xs) AS x FROM (SELECT img, arg_max(ys, place) AS ys, arg_max(xs, place) AS xs FROM choice GROUP BY img)"),
        ("ring", "SELECT h.img, h.y, h.x, CAST(floor(sqrt((e.y - h.y) * (e.y - h.y) + (e.x - h.x) * (e.x - h.x)) + 0.5) AS INTEGER) AS radius, count(*) AS support FROM chosen h JOIN edge e ON e.img = h.img GROUP BY ALL"),
        ("best", f"SELECT *, row_number() OVER (PARTITION BY img, y, x ORDER BY support / radius DESC, radius) AS place FROM ring WHERE radius BETWEEN {_LEAST} AND {_MOST}"),
    ]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in steps) + " SELECT b.img, CAST(0 AS INTEGER) AS c, b.x, b.y, b.radius, p.votes, b.support FROM best b JOIN peak p ON p.img = b.img AND p.y = b.y AND p.x = b.x WHERE b.place = 1"


QUERIES["hough_circles"] = lambda spark, d: R.hough_circles(eight(spark, d), _DP, _FAR, 100.0, _OVER, _LEAST, _MOST, binary(spark, d))
SQL["hough_circles"] = _circles_sql()


def _foreground(spark, sf_dir: str) -> DataFrame:
    """Every fourth image is of one stream; masks of bands of three rows."""
    frames = eight(spark, sf_dir).select(F.pmod("img", F.lit(4)).alias("stream"), F.floor(F.col("img") / 4).alias("frame"), "rows", "cols", "data")
    masks = B.foreground(frames, band=3).select("stream", "frame", "y", "cols", F.posexplode("data").alias("_i", "mask"))
    return masks.select("stream", "frame", (F.col("y") + F.floor(F.col("_i") / F.col("cols"))).cast("int").alias("y"), F.pmod("_i", "cols").alias("x"), "mask")


#: A recursion with mixtures per pixel; tested against a loop over pixels.
QUERIES["foreground"] = _foreground


# alignment: five images are a scene, of which the third is the pivot
def _align_sql() -> str:
    steps = [("px", EIGHT), ("five", "SELECT img, img // 5 AS scene, arg_min(p, k) AS pivot FROM (SELECT a.img, b.img AS p, abs(row_number() OVER (PARTITION BY a.img ORDER BY b.img) - 1 - count(*) OVER (PARTITION BY a.img) // 2) AS k FROM (SELECT DISTINCT img FROM px) a JOIN (SELECT DISTINCT img FROM px) b ON a.img // 5 = b.img // 5) GROUP BY img"), ("s8", "SELECT img, 0 AS dx, 0 AS dy FROM five")]
    last = "s8"
    for step in (4, 2, 1):
        n, code = 8 // step, f"c{step}"
        steps.append((f"m{step}", f"SELECT img, list_sort(list(v))[count(*) // 2] + 1 AS m FROM px WHERE y % {step} = 0 AND x % {step} = 0 GROUP BY img"))
        steps.append((code, f"SELECT img, y // {step} AS y, x // {step} AS x, CASE WHEN v > m THEN 1 ELSE 0 END AS bit FROM px JOIN m{step} USING (img) WHERE y % {step} = 0 AND x % {step} = 0 AND abs(v - m) > 4"))
        steps.append((f"t{step}", f"SELECT f.img, f.pivot, 2 * s.dx + i AS dx, 2 * s.dy + j AS dy, i, j FROM five f JOIN {last} s USING (img) CROSS JOIN range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(j)"))
        steps.append((f"e{step}", f"SELECT t.img, t.dx, t.dy, t.i, t.j, count(q.img) AS e FROM t{step} t LEFT JOIN {code} p ON p.img = t.pivot LEFT JOIN {code} q ON q.img = t.img AND q.y = p.y - t.dy AND q.x = p.x - t.dx AND q.bit <> p.bit GROUP BY ALL"))
        last = f"s{step}"
        pick = lambda k: f"CASE WHEN min(e) < {n * n} THEN arg_min({k}, (e, i, j)) ELSE max({k}) - 1 END AS {k}"
        steps.append((last, f"SELECT img, {pick('dx')}, {pick('dy')}, min(e) AS e FROM e{step} GROUP BY img"))
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps) + " SELECT f.img, f.scene, f.pivot, CAST(s.dx AS INTEGER) AS dx, CAST(s.dy AS INTEGER) AS dy, CAST(s.e AS INTEGER) AS differing FROM five f JOIN s1 s USING (img)"


def _fives(spark, sf_dir: str) -> DataFrame:
    planes = eight(spark, sf_dir)
    return A.shifts(planes, planes.select("img", F.floor(F.col("img") / 5).alias("scene")))


QUERIES["align_mtb"] = _fives
SQL["align_mtb"] = _align_sql()
