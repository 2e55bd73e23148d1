"""Tables that are computed once, and sums over all rows before a row, without one task that sees them all."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint under spark.checkpoint.dir: computed once, its lineage cut, its partitions fixed.

    Where no folder is named, a session in one process gets a temporary one, which goes with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="gridloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def with_sum_before(df: DataFrame, order: str, amount: Column, name: str) -> DataFrame:
    """df, dealt out by ranges of `order`, with the sum of `amount` over all rows of lower order; order is unique.

    Each range is summed by one task, and the sums of whole ranges, one row per range, are added up on the driver.
    """
    spark = df.sparkSession
    parts = settled(df.withColumn(name, amount).repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before, total = [], 0
    for r, s in parts.groupBy("_range").agg(F.sum(name)).orderBy("_range").collect():
        before.append((r, total))
        total += s
    known = spark.createDataFrame(before or [(0, 0)], "_range int, _before long")
    own = F.coalesce(F.sum(name).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn(name, own).join(F.broadcast(known), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
