"""Images in and out: arrays, pixel tables, packed matrices and Spark's image source, all as planes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.numeric import F64

#: numpy type of each depth, native byte order.
DTYPES = ("u1", "i1", "u2", "i2", "i4", "f4", "f8")
PLANE = "img long, c int, rows int, cols int, data array<double>"
MAT = "img long, rows int, cols int, channels int, depth int, data binary"


def from_arrays(df: DataFrame, values: str, rows: int, cols: int, img: str | Column = "img") -> DataFrame:
    """One single-channel plane per row of df, from an array column of exactly rows * cols numbers; others are dropped."""
    img = F.col(img) if isinstance(img, str) else img
    return df.where(F.size(values) == rows * cols).select(img.cast("long").alias("img"), F.lit(0).alias("c"), F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.col(values).cast("array<double>").alias("data"))


def from_pixels(px: DataFrame) -> DataFrame:
    """Planes from a pixel table (img, y, x, c, v); every pixel of each plane's bounding rectangle must be there."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"].cast("double"))
    return px.groupBy("img", "c").agg((F.max("y") + 1).cast("int").alias("rows"), (F.max("x") + 1).cast("int").alias("cols"), line.alias("data")).select("img", "c", "rows", "cols", "data")


def to_pixels(planes: DataFrame) -> DataFrame:
    """The pixel table (img, c, y, x, v) of planes."""
    px = planes.select("img", "c", "cols", F.posexplode("data").alias("_i", "v"))
    return px.select("img", "c", F.floor(F.col("_i") / F.col("cols")).cast("int").alias("y"), F.pmod("_i", "cols").alias("x"), "v")


def zeros(spark: SparkSession, images: int, rows: int, cols: int, channels: int = 1, value: float = 0.0) -> DataFrame:
    """Planes of `images` equal images that hold one value."""
    ids = spark.range(images).select(F.col("id").alias("img"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("c"))
    return ids.select("img", "c", F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.array_repeat(F.lit(float(value)), rows * cols).alias("data"))


def to_matrices(planes: DataFrame, depth: int = F64) -> DataFrame:
    """MAT rows (img, rows, cols, channels, depth, data): channels interleaved, values in the depth's own bytes."""
    whole = planes.groupBy("img").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.count(F.lit(1)).cast("int").alias("channels"), F.transform(F.array_sort(F.collect_list(F.struct("c", "data"))), lambda p: p["data"]).alias("data"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.stack([np.array(p) for p in d], axis=-1).astype(DTYPES[depth]).tobytes() for d in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([depth] * b.num_rows, pa.int32()), pa.array(packed, pa.binary())], ["img", "rows", "cols", "channels", "depth", "data"])

    return whole.mapInArrow(pack, MAT)


def from_matrices(mats: DataFrame) -> DataFrame:
    """Planes of MAT rows; a payload whose length does not fit its header raises."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for img, rows, cols, channels, depth, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                values = np.frombuffer(data, DTYPES[depth]).reshape(rows * cols, channels).astype(np.float64)
                n = channels
                yield pa.RecordBatch.from_arrays([pa.array([img] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([rows] * n, pa.int32()), pa.array([cols] * n, pa.int32()), pa.array(list(values.T), pa.list_(pa.float64()))], ["img", "c", "rows", "cols", "data"])

    return mats.select("img", "rows", "cols", "channels", "depth", "data").mapInArrow(unpack, PLANE)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Planes of the 8-bit images that Spark's image source reads from a path; img is a hash of the file's path."""
    rows = spark.read.format("image").load(path).select("image.*")
    mats = rows.select(F.xxhash64("origin").alias("img"), F.col("height").alias("rows"), F.col("width").alias("cols"), F.col("nChannels").alias("channels"), F.lit(0).alias("depth"), "data")
    return from_matrices(mats)


def roi(planes: DataFrame, y: int, x: int, rows: int, cols: int) -> DataFrame:
    """The part of each plane that begins at (y, x); parts that leave the plane are an error."""
    fits = (F.col("rows") >= y + rows) & (F.col("cols") >= x + cols)
    part = F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + rows - 1)), lambda r: F.slice("data", r * F.col("cols") + x + 1, F.lit(cols))))
    ready = planes.withColumn("_d", F.when(fits, part).otherwise(F.raise_error(F.lit("the rectangle leaves the image"))))
    return ready.select("img", "c", F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.col("_d").alias("data"))


def encode_bmp(planes: DataFrame) -> DataFrame:
    """(img, content): 8-bit images of one or three channels (blue, green, red) as BMP files, which read_images() reads."""
    whole = planes.groupBy("img").agg(F.first("rows").alias("rows"), F.first("cols").alias("cols"), F.transform(F.array_sort(F.collect_list(F.struct("c", "data"))), lambda p: p["data"]).alias("data"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for rows, cols, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                pixels = np.stack([np.array(d).reshape(rows, cols) for d in (data * 3 if len(data) == 1 else data[:3])], axis=-1).astype(np.uint8)
                lines = np.zeros((rows, -(-3 * cols // 4) * 4), np.uint8)
                lines[:, : 3 * cols] = pixels[::-1].reshape(rows, -1)  # from the lowest row up, each filled to four bytes
                head = struct.pack("<2sIHHI", b"BM", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, cols, rows, 1, 24, 0, lines.size, 2835, 2835, 0, 0)
                files.append(head + lines.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["img", "content"])

    return whole.mapInArrow(pack, "img long, content binary")
