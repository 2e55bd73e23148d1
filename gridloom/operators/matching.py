"""Matching of binary descriptors by Hamming distance: nearest ones, all within a radius, mutual nearest ones.

Descriptors are rows (key, words): an id and an array of 64-bit words, equally many in all rows. Rows with a null id, or
null or empty words, match nothing. Words are cut into m blocks of equal width. Two descriptors that differ by d bits
have a block that differs by at most d div m, so a search looks up each block with every way to flip 0, 1, 2 ... of its
bits: ring by ring, equi-joins on (block, value). A pair counts only in the first of its nearest blocks, hence in one
ring and once. After ring s what has not met differs by m * (s + 1) bits or more, which tells the queries that are done.
Copies are one descriptor until the end, and values of a block that very many descriptors share are dealt over salts.

Rings that are wide, or few descriptors, cost more than all pairs: these are scanned. Chunks of queries meet chunks of
train descriptors, each two in one task, which keeps the k nearest or those within the radius. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.tables import settled

#: Rings that a width of block goes through, 0 being one; wider ones meet most of all pairs.
RINGS = {32: 1, 16: 1, 8: 0}
#: Up to so many distinct descriptors all pairs are scanned at once. More go through rings, and scan for what is left.
SCANNED = 1 << 18
#: The most descriptors in a chunk of train, and distances that a task holds at once.
CHUNK, HELD = 1 << 16, 1 << 22
#: Pairs that a task scans while the look-ups meet one.
FASTER = 50
#: Descriptors of a block's value that one task joins. More are dealt over salts.
CELL = 50_000
#: The most values of blocks that are dealt over salts; their list goes to all tasks.
SALTED = 1 << 20
#: Parts of the copies of a query.
COPIES = 64


def signed(planes: DataFrame, level: float = 0.0) -> DataFrame:
    """Descriptors of planes: a bit for each value, set if it is above the level; the last word is filled with zeros."""
    data = F.col("data")
    bit = lambda v, i: F.when(v > level, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(data, w * 64 + 1, 64), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return planes.where(F.size(data) > 0).select(F.col("img").alias("key"), F.transform(F.sequence(F.lit(0), F.floor((F.size(data) - 1) / 64).cast("int")), word).alias("words"))


def _counts(a: str, b: str, size: int, width: int) -> Column:
    """Differing bits of every block of descriptors of `size` words; written out, so that it is compiled."""
    words = [F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))) for w in range(size)]
    return F.array(*[F.bit_count(F.call_function("shiftrightunsigned", x, F.lit(j * width)).bitwiseAND(F.lit((1 << width) - 1))) for x in words for j in range(64 // width)])


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _blocks(words: str, width: int) -> Column:
    """The value of every block."""
    part = lambda x, j: F.call_function("shiftrightunsigned", x, F.lit(j * width)).bitwiseAND(F.lit((1 << width) - 1))
    return F.flatten(F.transform(words, lambda x: F.array(*[part(x, j) for j in range(64 // width)])))


def _flips(width: int, ring: int) -> list[int]:
    return [sum(1 << i for i in bits) for bits in combinations(range(width), ring)]


def _rows(df: DataFrame) -> DataFrame:
    return df.select("key", "words").where(F.col("key").isNotNull() & (F.size("words") > 0) & ~F.exists("words", lambda w: w.isNull()))


def _size(queries: DataFrame, train: DataFrame) -> int:
    """Words of a descriptor; 0 if a side has none."""
    low, high, sides = queries.select(F.size("words").alias("n"), F.lit(0).alias("s")).union(train.select(F.size("words"), F.lit(1))).agg(F.min("n"), F.max("n"), F.count_distinct("s")).first()
    if low != high:
        raise ValueError("descriptors differ in length")
    return low if sides == 2 else 0


def _width(n: int) -> int:
    return 8 if n < 1 << 12 else 16 if n < 1 << 24 else 32


def _look_ups(n: int, size: int, width: int, rings: list[int]) -> float:
    """What a query looks up in these rings, and what it meets if values are dealt evenly."""
    return size * 64 // width * sum(comb(width, ring) for ring in rings) * (1 + n / 2**width)


class _Cells:
    """The blocks of distinct descriptors `t`, and what they are dealt over."""

    def __init__(self, train: DataFrame, n: int, size: int, width: int):
        self.width, self.size, self.blocks = width, size, size * 64 // width
        cells = settled(train.select("t", F.posexplode(_blocks("t", width)).alias("block", "value")))
        limit = max(CELL, n * self.blocks // SALTED + 1)
        # at most SALTED of them, since each has over n * blocks / SALTED rows
        self.heavy = F.broadcast(settled(cells.groupBy("block", "value").count().where(F.col("count") > limit).select("block", "value", F.ceil(F.col("count") / limit).cast("int").alias("salts"))))
        self.cells = cells.join(self.heavy, ["block", "value"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("t"), "salts"), F.lit(0)).cast("int")).drop("salts")

    def pairs(self, queries: DataFrame, rings: list[int]) -> DataFrame:
        """(q, t, distance) of all pairs whose nearest block differs by a number of bits that is in rings."""
        flips = F.array(*[F.lit(f).cast("long") for ring in rings for f in _flips(self.width, ring)])
        probes = queries.select("q", F.posexplode(_blocks("q", self.width)).alias("block", "_v")).select("q", "block", F.explode(flips).alias("_f"), "_v")
        probes = probes.select("q", "block", F.col("_v").bitwiseXOR(F.col("_f")).alias("value")).join(self.heavy, ["block", "value"], "left")
        probes = probes.select("q", "block", "value", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)).alias("salt"))
        met = probes.join(self.cells, ["block", "value", "salt"]).withColumn("_n", _counts("q", "t", self.size, self.width))
        first = F.array_position("_n", F.array_min("_n")) == F.col("block") + 1
        return met.where(first).select("q", "t", F.aggregate("_n", F.lit(0), lambda s, n: s + n).alias("distance"))


def _packed(df: DataFrame, words: str, order: list[str], n: int, most: int, chunk: str) -> tuple[DataFrame, int]:
    """(chunk, words): the words of `most` descriptors or about so many, one after the other, by `order` within a chunk; and the number of chunks."""
    parts = max(1, ceil(n / most))
    rows = df.select(F.pmod(F.xxhash64(words), F.lit(parts)).cast("int").alias(chunk), F.struct(*order, *[w for w in [words] if w not in order]).alias("_r"))
    return rows.groupBy(chunk).agg(F.flatten(F.transform(F.sort_array(F.collect_list("_r")), lambda r: r[words])).alias(words)), parts


def _scanned(queries: DataFrame, train: DataFrame, n: int, size: int, keep: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], order: list[str]) -> DataFrame:
    """(q, t, distance) of all pairs that keep(distances of some queries to a chunk of train) gives as places. A chunk of
    train is sorted by `order`. Every two chunks meet in one task."""
    many = queries.count()
    left, parts = _packed(queries, "q", ["q"], many, min(8192, max(128, many // 64)), "_a")
    right, others = _packed(train, "t", order, n, CHUNK, "_b")
    tasks = min(parts * others, 4096)
    left = settled(left).select("q", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("_b"), "_a")
    # by rows of _b and _a, so that chunks are dealt evenly, whatever the number of chunks on either side
    met = left.join(settled(right), "_b").repartition(tasks, "_a", "_b").select("q", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda w: pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * size, w.ravel())
        for batch in batches:
            for k in range(batch.num_rows):
                q, t = (batch.column(c)[k].values.to_numpy().reshape(-1, size) for c in (0, 1))
                step = max(1, HELD // len(t))
                for at in range(0, len(q), step):
                    some = q[at : at + step]
                    d = np.zeros((len(some), len(t)), np.int16 if size < 512 else np.int32)
                    for w in range(size):
                        # of signed words numpy would count the bits of the absolute value
                        d += np.bitwise_count((some[:, w, None] ^ t[None, :, w]).view(np.uint64))
                    i, j = keep(d)
                    for a in range(0, len(i), 1 << 16):
                        x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([lists(some[x]), lists(t[y]), pa.array(d[x, y].astype(np.int32))], ["q", "t", "distance"])

    return met.mapInArrow(run, "q array<long>, t array<long>, distance int")


def _nearest_places(k: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Places of the k least of each row, equal ones by place."""

    def keep(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.partition(d, k - 1, axis=1)[:, k - 1, None] if k < d.shape[1] else d.max(axis=1, keepdims=True)
        i, j = np.nonzero(d <= most)
        order = np.lexsort((j, d[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(d)))
        near = np.arange(len(i)) - first[i] < k
        return i[near], j[near]

    return keep


def _best(pairs: DataFrame, by: list[str], k: int, order: list[str]) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _members(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs of distinct queries q for every row of a query; copies are dealt over parts, so none is one hot group."""
    rows = queries.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(COPIES)))
    parts = rows.select(F.col("words").alias("q"), "_part").distinct().join(pairs, "q")
    return rows.select(F.col("words").alias("q"), "_part", F.col("key").alias("query")).join(parts, ["q", "_part"]).drop("q", "_part")


def knn_match(queries: DataFrame, train: DataFrame, k: int = 2, allowed: DataFrame | None = None) -> DataFrame:
    """The k nearest train descriptors of every query: (query, train, distance, rank), equal distances to the smaller key.

    Exact. Fewer rows where train has fewer. `allowed`, pairs (query, train), leaves only those to choose from. Keys are
    those of rows; repeated keys are rows of their own.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    queries, train = _rows(queries), _rows(train)
    if allowed is not None:
        pairs = allowed.select("query", "train").distinct().join(queries.select(F.col("key").alias("query"), F.col("words").alias("q")), "query").join(train.select(F.col("key").alias("train"), F.col("words").alias("t")), "train")
        return _best(pairs.select("query", "train", _distance("q", "t").alias("distance")), ["query"], k, ["distance", "train"])
    queries, train = settled(queries), settled(train)
    members = settled(_best(train.select(F.col("words").alias("t"), F.col("key").alias("train")), ["t"], k, ["train"]))
    firsts = members.where("rank = 1").select("t", "train")
    n, size = firsts.count(), _size(queries, train)
    left = settled(queries.select(F.col("words").alias("q")).distinct())
    if not size:
        return queries.select(F.col("key").alias("query"), F.col("key").alias("train"), F.lit(0).alias("distance"), F.lit(1).alias("rank")).where("false")
    out, need, width = None, min(k, n), _width(n)
    if n > SCANNED:
        cells, found = _Cells(firsts.select("t"), n, size, width), None
        for ring in range(RINGS[width] + 1):
            new = cells.pairs(left, [ring]).join(firsts, "t").select("q", "t", "train", "distance")
            new = new if found is None else new.union(found.join(left, "q", "left_semi"))
            found = settled(_best(new, ["q"], need, ["distance", "train"]).drop("rank"))
            far = F.max("distance") < cells.blocks * (ring + 1)
            done = settled(found.groupBy("q").agg(F.count(F.lit(1)).alias("_n"), far.alias("_far")).where((F.col("_n") == need) & F.col("_far")).select("q"))
            ready = found.join(done, "q", "left_semi")
            out = ready if out is None else out.union(ready)
            left = settled(left.join(done, "q", "left_anti"))
    if out is None or not left.isEmpty():
        # the k best of each chunk, by distance and then key, hold the k best of all
        rest = settled(_scanned(left, firsts, n, size, _nearest_places(need), ["train", "t"]).join(firsts, "t"))
        rest = _best(rest, ["q"], need, ["distance", "train"]).select("q", "t", "train", "distance")
        out = rest if out is None else out.union(rest)
    rows = out.select("q", "t", "distance").join(members.select("t", "train"), "t").drop("t")
    return _members(queries, _best(rows, ["q"], k, ["distance", "train"])).select("query", "train", "distance", "rank")


def radius_match(queries: DataFrame, train: DataFrame, radius: int) -> DataFrame:
    """All pairs that differ by at most `radius` bits: (query, train, distance). Exact: one join of blocks, or a scan where that meets most pairs."""
    if radius < 0:
        raise ValueError("a radius is at least 0")
    queries, train = settled(_rows(queries)), settled(_rows(train))
    firsts = settled(train.select(F.col("words").alias("t")).distinct())
    n, size = firsts.count(), _size(queries, train)
    if not size:
        return queries.select(F.col("key").alias("query"), F.col("key").alias("train"), F.lit(0).alias("distance")).where("false")
    width = _width(n)
    while width > 8 and radius // (size * 64 // width) > RINGS[width]:
        width //= 2
    probed = queries.select(F.col("words").alias("q")).distinct()
    rings = list(range(min(width, radius // (size * 64 // width)) + 1))
    if _look_ups(n, size, width, rings) * FASTER < n:
        pairs = _Cells(firsts, n, size, width).pairs(probed, rings).where(F.col("distance") <= radius)
    else:
        pairs = _scanned(settled(probed), firsts, n, size, lambda d: np.nonzero(d <= radius), ["t"])
    pairs = settled(pairs)
    met = _members(queries, pairs)
    other = train.select(F.col("words").alias("t"), F.col("key").alias("train"))
    return met.join(other, "t").select("query", "train", "distance")


def match(queries: DataFrame, train: DataFrame, cross_check: bool = False) -> DataFrame:
    """The nearest train descriptor of every query: (query, train, distance). With cross_check only where the query is
    the nearest of it too, ties to the smaller key on both sides."""
    best = knn_match(queries, train, 1).drop("rank")
    if not cross_check:
        return best
    back = knn_match(train, queries, 1).select(F.col("query").alias("train"), F.col("train").alias("query"))
    return best.join(back, ["query", "train"], "left_semi")
