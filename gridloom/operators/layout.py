"""Layout, channels and projections: index arithmetic inside one row, or a regrouping of whole planes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import planes as P
from gridloom.operators.common import COLS, D, ROWS, changed


def transpose(planes: DataFrame) -> DataFrame:
    return changed(planes, P.gather(D(), COLS(), COLS(), ROWS(), lambda y, x: (x, y)), COLS(), ROWS())


def flip(planes: DataFrame, code: int) -> DataFrame:
    """code 0 turns rows about, a positive one columns, a negative one both."""
    return changed(planes, P.gather(D(), COLS(), ROWS(), COLS(), lambda y, x: (ROWS() - 1 - y if code <= 0 else y, COLS() - 1 - x if code != 0 else x)))


def rotate(planes: DataFrame, code: int) -> DataFrame:
    """0, 1, 2: 90 degrees clockwise, 180, 90 anticlockwise."""
    if code not in (0, 1, 2):
        raise ValueError(f"rotation code {code}")
    if code == 1:
        return flip(planes, -1)
    turned = (lambda y, x: (ROWS() - 1 - x, y)) if code == 0 else (lambda y, x: (x, COLS() - 1 - y))
    return changed(planes, P.gather(D(), COLS(), COLS(), ROWS(), turned), COLS(), ROWS())


def repeat(planes: DataFrame, down: int, across: int) -> DataFrame:
    return changed(planes, P.gather(D(), COLS(), ROWS() * down, COLS() * across, lambda y, x: (F.pmod(y, ROWS()), F.pmod(x, COLS()))), ROWS() * down, COLS() * across)


def _joined_rows(parts: list[DataFrame], across: bool) -> DataFrame:
    marked = [p.withColumn("_p", F.lit(k)) for k, p in enumerate(parts)]
    rows = marked[0]
    for m in marked[1:]:
        rows = rows.unionByName(m)
    listed = rows.groupBy("img", "c").agg(F.array_sort(F.collect_list(F.struct("_p", "rows", "cols", "data"))).alias("_l"))
    side = "rows" if across else "cols"
    same = F.forall("_l", lambda p: p[side] == F.col("_l")[0][side]) & (F.size("_l") == len(parts))
    fixed = F.when(same, F.col("_l")[0][side]).otherwise(F.raise_error(F.lit("parts do not fit together")))
    summed = F.aggregate("_l", F.lit(0), lambda a, p: a + p["cols" if across else "rows"])
    if across:
        data = F.flatten(F.transform(F.sequence(F.lit(0), fixed - 1), lambda y: F.flatten(F.transform("_l", lambda p: F.slice(p["data"], y * p["cols"] + 1, p["cols"])))))
    else:
        data = F.flatten(F.transform("_l", lambda p: p["data"]))
    return listed.select("img", "c", (fixed if across else summed).cast("int").alias("rows"), (summed if across else fixed).cast("int").alias("cols"), data.alias("data"))


def hconcat(parts: list[DataFrame]) -> DataFrame:
    """Images of equal height side by side, matched by img and c."""
    return _joined_rows(parts, True)


def vconcat(parts: list[DataFrame]) -> DataFrame:
    """Images of equal width one below the other."""
    return _joined_rows(parts, False)


def split(planes: DataFrame) -> DataFrame:
    """One single-channel image per channel: adds `plane`, and c becomes 0. No data moves."""
    return planes.select("img", F.col("c").alias("plane"), F.lit(0).alias("c"), "rows", "cols", "data")


def merge(parts: list[DataFrame]) -> DataFrame:
    """The channels of all parts as one image, in order; parts may have several channels."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_p", F.lit(k))
        out = p if out is None else out.unionByName(p)
    numbered = out.withColumn("c", (F.row_number().over(Window.partitionBy("img").orderBy("_p", "c")) - 1).cast("int"))
    return numbered.drop("_p")


def mix_channels(planes: DataFrame, previous: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Channels of `previous`, those that pairs (from, to) name replaced by channels of planes."""
    moves = F.create_map(*[F.lit(x) for pair in [(t, f) for f, t in pairs] for x in pair])
    wanted = previous.withColumn("_f", F.try_element_at(moves, F.col("c")))
    source = planes.select("img", F.col("c").alias("_f"), F.col("data").alias("_d"))
    out = wanted.join(source, ["img", "_f"], "left")
    missing = F.col("_f").isNotNull() & F.col("_d").isNull()
    return changed(out, F.when(missing, F.raise_error(F.lit("no such source channel"))).otherwise(F.coalesce("_d", "data")))


def copy_make_border(planes: DataFrame, top: int, bottom: int, left: int, right: int, border: int = P.CONSTANT, value: float = 0.0) -> DataFrame:
    rows, cols = ROWS() + (top + bottom), COLS() + (left + right)
    return changed(planes, P.gather(D(), COLS(), rows, cols, lambda y, x: (P.border_index(y - top, ROWS(), border), P.border_index(x - left, COLS(), border)), value), rows, cols)


def set_identity(planes: DataFrame, values: tuple[float, ...] = (1.0,)) -> DataFrame:
    """values on the diagonal, 0 elsewhere; one value serves all channels."""
    v = F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.least(F.col("c") + 1, F.lit(len(values))))
    return changed(planes, P.grid(ROWS(), COLS(), lambda y, x: F.when(y == x, v).otherwise(F.lit(0.0))))


def get_rect_sub_pix(planes: DataFrame, rows: int, cols: int, center: tuple[float, float], integer: bool = False) -> DataFrame:
    """A rows x cols patch around center (x, y), bilinear, 0 outside; integer results round ties away from zero."""

    def value(d, y, x):
        sx, sy = x + (center[0] - (cols - 1) / 2), y + (center[1] - (rows - 1) / 2)
        y0, x0 = F.floor(sy).cast("int"), F.floor(sx).cast("int")
        fy, fx = sy - y0, sx - x0
        v = lambda a, b: F.coalesce(P.at(d, COLS(), P.border_index(a, ROWS(), P.CONSTANT), P.border_index(b, COLS(), P.CONSTANT)), F.lit(0.0))
        mixed = v(y0, x0) * (1 - fy) * (1 - fx) + v(y0, x0 + 1) * (1 - fy) * fx + v(y0 + 1, x0) * fy * (1 - fx) + v(y0 + 1, x0 + 1) * fy * fx
        return F.signum(mixed) * F.floor(F.abs(mixed) + 0.5) if integer else mixed

    return changed(planes, P.grid_over(D(), rows, cols, value), rows, cols)


def extract_channel(planes: DataFrame, channel: int) -> DataFrame:
    """One channel of each image, as channel 0."""
    return planes.where(F.col("c") == channel).withColumn("c", F.lit(0)).select("img", "c", "rows", "cols", "data")


def insert_channel(planes: DataFrame, plane: DataFrame, channel: int) -> DataFrame:
    """Images with one channel replaced by the image's plane of `plane`; both sides have the image."""
    new = plane.select("img", F.lit(channel).alias("c"), "rows", "cols", "data").join(planes.where(F.col("c") == channel).select("img"), "img", "left_semi")
    return planes.where(F.col("c") != channel).unionByName(new)
