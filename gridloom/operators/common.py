"""What the operators share: planes in, planes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.planes import Number, col


def D() -> Column:
    """The data of a plane. Columns are made when an operator is called: workers import these modules without a session."""
    return F.col("data")


def ROWS() -> Column:
    return F.col("rows")


def COLS() -> Column:
    return F.col("cols")



def changed(planes: DataFrame, data: Column, rows: Number | None = None, cols: Number | None = None) -> DataFrame:
    """The planes with new data, and a new size where given."""
    # in two steps: inside a lambda, a name that the same select also gives out would mean the new column
    ready = planes.withColumns({"__data": data, "__rows": (ROWS() if rows is None else col(rows)).cast("int"), "__cols": (COLS() if cols is None else col(cols)).cast("int")})
    return ready.select("img", "c", F.col("__rows").alias("rows"), F.col("__cols").alias("cols"), F.col("__data").alias("data"))


def paired(a: DataFrame, *others: DataFrame) -> DataFrame:
    """Planes of equal img and c side by side; the others' data are data2, data3 and so on. One join per operand, by image."""
    for k, b in enumerate(others, 2):
        a = a.join(b.select("img", "c", F.col("rows").alias("_r"), F.col("cols").alias("_c"), F.col("data").alias(f"data{k}")), ["img", "c"])
        same = (F.col("rows") == F.col("_r")) & (F.col("cols") == F.col("_c"))
        a = a.withColumn(f"data{k}", F.when(same, F.col(f"data{k}")).otherwise(F.raise_error(F.lit("operands differ in size")))).drop("_r", "_c")
    return a


def zipped(a: DataFrame, b: DataFrame, value, mask: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Planes of value(a, b) for each pair of values. Where the mask (one plane per image) is 0, the previous destination's
    values stay, or 0 without one."""
    both = paired(a, b)
    out = F.zip_with(D(), F.col("data2"), value)
    return masked(both.withColumn("out", out), mask, previous)


def masked(planes: DataFrame, mask: DataFrame | None, previous: DataFrame | None) -> DataFrame:
    out = F.col("out")
    if mask is not None:
        planes = planes.join(mask.select("img", F.col("data").alias("_m")), "img")
        if previous is not None:
            planes = planes.join(previous.select("img", "c", F.col("data").alias("_p")), ["img", "c"])
            out = F.transform(F.arrays_zip("out", "_m", "_p"), lambda t: F.when(t["_m"] != 0, t["out"]).otherwise(t["_p"]))
        else:
            out = F.zip_with("out", "_m", lambda v, m: F.when(m != 0, v).otherwise(F.lit(0.0)))
    return changed(planes, out)


def mapped(planes: DataFrame, value, mask: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Planes of value(v) for each value."""
    return masked(planes.withColumn("out", F.transform(D(), value)), mask, previous)
