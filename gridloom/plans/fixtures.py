"""Planes made from the driver's tables, and the same pixels in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import planes as P
from gridloom.operators.common import changed
from gridloom.sources.images import from_arrays, to_pixels

SIDE = 8


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 planes of the embeddings' own values."""
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", SIDE, SIDE, "vec_id")


def eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as whole values of 0 .. 255."""
    return changed(real(spark, sf_dir), F.transform("data", lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((v + 0.55) * 230)))))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(eight(spark, sf_dir), F.transform("data", lambda v: F.when(v > 127, F.lit(255.0)).otherwise(F.lit(0.0))))


def shifted(planes: DataFrame, by: int = 1) -> DataFrame:
    """A second operand: image k is image k + by of the first."""
    return planes.withColumn("img", F.col("img") - by)


def color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three planes each: images 3k, 3k + 1, 3k + 2 as channels; incomplete ones are left out."""
    planes = eight(spark, sf_dir).withColumns({"c": F.pmod("img", F.lit(3)).cast("int"), "img": F.floor(F.col("img") / 3)})
    whole = planes.groupBy("img").agg(F.count(F.lit(1)).alias("_n")).where("_n = 3").select("img")
    return planes.join(whole, "img").select("img", "c", "rows", "cols", "data")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (set_id, pos, x, y): a user's events in order, their number and value."""
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("set_id"), pos.alias("pos"), pos.cast("double").alias("x"), F.col("value").alias("y"))


def pixels(planes: DataFrame) -> DataFrame:
    """What a query returns of planes: every pixel, values to six places."""
    return to_pixels(planes).select("img", "c", "y", "x", (F.round("v", 6) + F.lit(0.0)).alias("v"))


REAL = "SELECT vec_id AS img, 0 AS c, i // 8 AS y, i % 8 AS x, e AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings WHERE len(embedding) = 64)"
EIGHT = f"SELECT img, c, y, x, least(255.0, greatest(0.0, round_even((v + 0.55) * 230, 0))) AS v FROM ({REAL})"
BINARY = f"SELECT img, c, y, x, CASE WHEN v > 127 THEN 255.0 ELSE 0.0 END AS v FROM ({EIGHT})"
COLOR = f"SELECT img // 3 AS img, CAST(img % 3 AS INTEGER) AS c, y, x, v FROM ({EIGHT}) WHERE img // 3 IN (SELECT vec_id // 3 FROM embeddings WHERE len(embedding) = 64 GROUP BY 1 HAVING count(*) = 3)"
POLYGONS = "SELECT user_id AS set_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value AS y FROM events"


def shift_sql(px: str, by: int = 1) -> str:
    return f"SELECT img - {by} AS img, c, y, x, v FROM ({px})"


def pixels_sql(px: str) -> str:
    """The columns of pixels() from SQL that gives img, c, y, x and v."""
    return f"SELECT CAST(img AS BIGINT) AS img, CAST(c AS INTEGER) AS c, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(CAST(v AS DOUBLE), 6) + 0.0 AS v FROM ({px})"


def border_sql(p: str, n: int, border: int) -> str:
    """border_index in SQL; null where a constant border has no pixel."""
    kind = border & ~P.ISOLATED
    mod = lambda m: f"((({p}) % {m}) + {m}) % {m}"
    if kind == P.REPLICATE:
        return f"greatest(0, least({n - 1}, {p}))"
    if kind == P.WRAP:
        return mod(n)
    if kind == P.REFLECT:
        return f"CASE WHEN {mod(2 * n)} < {n} THEN {mod(2 * n)} ELSE {2 * n - 1} - {mod(2 * n)} END"
    if kind == P.REFLECT_101:
        return f"CASE WHEN {mod(2 * n - 2)} < {n} THEN {mod(2 * n - 2)} ELSE {2 * n - 2} - {mod(2 * n - 2)} END"
    return f"CASE WHEN ({p}) BETWEEN 0 AND {n - 1} THEN ({p}) END"


def around_sql(px: str, weights: list[tuple[int, int, float]], border: int, outside: float = 0.0, rows: int = SIDE, cols: int = SIDE) -> str:
    """(img, c, y, x, dy, dx, w, s): each pixel with each tap's weight and value."""
    listed = ", ".join(f"({dy}, {dx}, CAST({w!r} AS DOUBLE))" for dy, dx, w in weights)
    return f"""SELECT q.img, q.c, q.y, q.x, t.dy, t.dx, t.w, coalesce(s.v, CAST({outside} AS DOUBLE)) AS s FROM ({px}) q CROSS JOIN (VALUES {listed}) t(dy, dx, w)
    LEFT JOIN ({px}) s ON s.img = q.img AND s.c = q.c AND s.y = {border_sql("q.y + t.dy", rows, border)} AND s.x = {border_sql("q.x + t.dx", cols, border)}"""


def taps_sql(px: str, weights: list[tuple[int, int, float]], border: int, value: str = "sum(w * s)", rows: int = SIDE, cols: int = SIDE) -> str:
    return f"SELECT img, c, y, x, {value} AS v FROM ({around_sql(px, weights, border, 0.0, rows, cols)}) GROUP BY img, c, y, x"
