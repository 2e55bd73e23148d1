"""Helpers that several corpus operators share: tables in the shared folder, Arrow batches, units of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that reach Python hold at most so many bytes or rows, so that a batch of long texts stays small.
BATCH_BYTES = "4m"
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; set on the session because the limit is read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where none is named, a session in one process gets a temporary one, which goes with it; a cluster must name its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a table that materialise() wrote and that no later plan reads."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def lean(scan: Callable) -> Callable:
    """scan, for mapInArrow, but the worker gives freed memory back to the system after each task; idle workers stay small."""

    @wraps(scan)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes (None for null) of a string column, without making Python strings."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each pair."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.asarray(starts, np.int64) - ends + lengths, lengths) + np.arange(total, dtype=np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node that each reaches, by minimum labels and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (before == label).all():
            break
    return label


def joined(rows: DataFrame, known: DataFrame, keys: list[str], count: str, by: Column, literal: bool = False) -> DataFrame:
    """rows, inner-joined with `known`, a written table with one row per key and, in `count`, the key's number of rows.

    A key with more rows than half a partition's share is dealt over as many salts as it has shares; `by` decides which
    row gets which. There are at most twice as many such keys as partitions, so their list can be broadcast, and no task
    gets much more than its share, whatever the keys. The column `count` isn't in the result. Where most rows have no
    key in `known`, `literal` puts the list, of one long key, into the plan, and only rows of known keys go through a join.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = (known.agg(F.sum(count)).first()[0] or 0) / (2 * parts)
    salts = F.ceil(F.col(count) / F.lit(max(share, 1.0))).cast("int")
    heavy = known.where(F.col(count) > max(share, 1.0)).select(*keys, salts.alias("_salts"))  # at most 2 * parts rows
    if literal:
        salted = dict(heavy.collect())
        salts_of = F.map_from_arrays(F.lit(list(salted)).cast("array<bigint>"), F.lit(list(salted.values())).cast("array<int>"))
        found = salts_of[F.col(keys[0])]  # looks through the list, so only for its own keys
        dealt = rows.withColumn("_salts", F.when(F.col(keys[0]).isin(list(salted)), found) if salted else found)
    else:
        dealt = rows.join(F.broadcast(heavy), keys, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(3), by), F.col("_salts"))).cast("int")).drop("_salts")
    each = F.when(F.col(count) > max(share, 1.0), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(known.withColumn("_salt", F.explode(each)).drop(count), [*keys, "_salt"]).drop("_salt")


def numbered(rows: DataFrame, group: str, order: list[Column], pos: str) -> DataFrame:
    """The written table `rows` with, in `pos`, each row's place (from 0) in its group by `order`; group is a long, not null.

    Rows are dealt out by ranges of group and order, so a group of any size is spread over as many tasks as it fills.
    Tasks number what they get as it streams by; only the first group of a task may have begun before, and what came
    before it is known from one row per task. The result is a written table, for discard().
    """
    spark = rows.sparkSession
    small_batches(spark)
    place = rows.columns.index(group)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(place).to_numpy()
            first = int(g[0]) if first is None else first
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            sizes = np.diff(np.append(starts, len(g)))
            local = np.arange(len(g)) - np.repeat(starts, sizes)
            if last is not None and g[0] == last:
                local[: sizes[0]] += held
            last, held = int(g[-1]), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local), pa.array(g == first)], [*b.schema.names, pos, "_first"])

    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), group, *order).sortWithinPartitions(group, *order).withColumn("_task", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    local = materialise(dealt.mapInArrow(lean(scan), f"{schema}, `{pos}` long, _first boolean"))
    ends = local.groupBy("_task").agg(F.min(group).alias("a"), F.max(group).alias("b"), F.max_by(F.col(pos), F.struct(group, pos)).alias("n")).orderBy("_task").collect()  # one row per task
    before, last, held = [], None, 0
    for task, a, b, n in ends:
        offset = held if a == last else 0
        before.append((task, offset))
        last, held = b, n + 1 + (offset if a == b else 0)
    known = spark.createDataFrame(before or [(0, 0)], "_task int, _before long")
    out = local.join(F.broadcast(known), "_task").withColumn(pos, F.col(pos) + F.when(F.col("_first"), F.col("_before")).otherwise(0)).drop("_task", "_first", "_before")
    out._gridloom_path = local._gridloom_path
    return out


def in_units(keyed: DataFrame, keys: list[str], spread: str, members: int) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that at least two rows have, dealt into units of about 2 * members rows at most.

    A key with many rows is cut into chunks by the column `spread`; each pair of chunks is one unit (unit_a <= unit_b),
    so any two rows of a key meet in some unit, and no task holds a whole hot key, neither here nor in a unit. Adds
    chunk, unit_a and unit_b. The second result is the table of counts, for discard() once the units are used.
    """
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    counts = materialise(counts.withColumn("_c", F.ceil(F.col("_n") / F.lit(members)).cast("int")))
    dealt = joined(keyed, counts, keys, "_n", F.col(spread))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), F.col(spread)), F.col("_c")).cast("int"))
    dealt = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return dealt.withColumns({"unit_a": F.least("chunk", "_x"), "unit_b": F.greatest("chunk", "_x")}).drop("_c", "_x"), counts


def text_key(text_col: str) -> Column:
    """A text's digest: half of its SHA-256. Null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256), 1, 32))


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs, with all its columns, for each group of texts: that of the smallest id, and of equal ids that of
    the smallest digest of its text; a null id comes last. groups has (key, root) for the texts that are grouped; any
    other text is a group of its own. Of rows that agree in id and text that of the smallest hash of all columns (maps
    aside) stays, so every run keeps the same."""
    whole = F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    keyed = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), whole.alias("whole"))
    own = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "whole")).alias("own")
    texts = keyed.groupBy("key").agg(own).select("key", "own.*").join(groups, "key", "left")
    chosen = F.min(F.struct("last", "id", "key", "whole")).alias("s")
    kept = texts.where("root IS NOT NULL").groupBy("root").agg(chosen).select("s.id", "s.key", "s.whole").unionByName(texts.where("root IS NULL").select("id", "key", "whole"))
    kept = materialise(kept)
    rows = docs.withColumns({"_key": text_key(text_col), "_id": F.col(id_col), "_whole": whole})
    same = (rows["_key"] == kept["key"]) & rows["_id"].eqNullSafe(kept["id"]) & (rows["_whole"] == kept["whole"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["_key", "_id"]).select(docs.columns)


def spread(seed: int, *columns: str) -> Column:
    """A hash of the columns as a number from 0 to 1; the rows with the smallest ones are a sample that any plan finds again."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1).cast("double") / float(2**63)


def smallest(rows: DataFrame, seed: int, column: str, most: int, of: int) -> DataFrame:
    """The `most` rows of the smallest spread among `of` rows of distinct values. Rows that are surely beyond go before
    the sort, so that what tasks send to it is about twice the sample, however many tasks there are."""
    u = spread(seed, column)
    return rows.where(u * of < 2.0 * most + 100).orderBy(u, column).limit(most)


def flat_lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as one array, and the number of values in each row."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def slices_by_cost(cost: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose summed cost is at most `most`, each with at least one index."""
    start, total = 0, 0.0
    for i, c in enumerate(cost.tolist()):
        if i > start and total + c > most:
            yield start, i
            start, total = i, 0.0
        total += c
    if start < len(cost):
        yield start, len(cost)
