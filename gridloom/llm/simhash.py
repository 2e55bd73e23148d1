"""SimHash near-duplicates: fingerprints of word shingles, linked through sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, discard, first_of_each, flat_lists, in_units, joined, lean, local_roots, materialise, ranges, slices_by_cost, small_batches, table, text_key
from gridloom.llm.components import components

RADIUS = 4
#: A shard tree has about so many nodes on average, and never much more than MOST_NODES; larger shards are split.
SHARD_NODES, MOST_NODES = 256, 1024
_SLICE = 1 << 16


def fingerprint(text: bytes | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 bytes: A-Z lowered, words between ASCII white space, shingles hashed by XXH64."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - words_per_shingle + 1)
    first, last = starts[:n].tolist(), ends[min(len(words), words_per_shingle) - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        hashed = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + _SLICE], last[at : at + _SLICE], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).view(np.uint64).reshape(-1, 8)
        # sums of 255 rows of 0/1 bytes fit the bytes of 64-bit lanes
        lanes = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        counts += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed 64-bit integer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(scan), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class BkForest:
    """One BK-tree for each group of fingerprints, all built and searched together, level by level, in numpy.

    A child hangs below its parent under the integer Hamming distance between them; a search of radius r that stands
    at distance d from a node follows only the children under d - r .. d + r. A fingerprint is a number of 64 bits, or
    a row of several.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps, self.bits = fps, 64 * (fps.shape[1] if fps.ndim > 1 else 1)
        order = np.argsort(group, kind="stable")
        heads = order[np.flatnonzero(np.diff(group[order], prepend=-1))] if len(order) else order
        self.root_of = dict(zip(group[heads].tolist(), heads.tolist(), strict=True))
        top = np.full(int(group.max()) + 1 if len(group) else 0, -1)
        top[group[heads]] = heads
        self.roots = top
        items = np.setdiff1d(order, heads)
        nodes, keys, children = top[group[items]], [], []
        while len(items):
            key = nodes * (self.bits + 1) + distance(fps[items], fps[nodes])
            found, at, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(items[at])
            rest = np.ones(len(items), bool)
            rest[at] = False
            nodes, items = items[at][which][rest], items[rest]
        keys, children = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, children))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of the query, index of the node) within the radius; each query searches its group's tree."""
        return self.within(queries, group, np.full(len(queries), radius))[:2]

    def within(self, queries: np.ndarray, group: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As search(), with a radius for each query; also the distances."""
        q = np.arange(len(queries))
        node = self.roots[group] if len(self.roots) else np.full(len(q), -1)
        q, node = q[node >= 0], node[node >= 0]
        hits_q, hits_n, hits_d = [], [], []
        while len(q):
            d, r = distance(queries[q], self.fps[node]), radius[q]
            near = d <= r
            hits_q.append(q[near])
            hits_n.append(node[near])
            hits_d.append(d[near])
            low = np.searchsorted(self.keys, node * (self.bits + 1) + np.maximum(d - r, 0))
            fan = np.searchsorted(self.keys, node * (self.bits + 1) + np.minimum(d + r, self.bits), "right") - low
            q, node = np.repeat(q, fan), self.children[ranges(low, fan)]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(hits_q), join(hits_n), join(hits_d)


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star of each group of linked fingerprints of a unit: the tree of chunk a, searched by chunk b."""
    for b in batches:
        fps, n = flat_lists(b, "fps")
        chunks, _ = flat_lists(b, "chunks")
        fps = fps.view(np.uint64)
        one = np.repeat(b.column("unit_a").to_numpy() == b.column("unit_b").to_numpy(), n)
        in_tree, asks = one | (chunks == np.repeat(b.column("unit_a").to_numpy(), n)), one | (chunks == np.repeat(b.column("unit_b").to_numpy(), n))
        ends = np.concatenate(([0], np.cumsum(n)))
        for i, j in slices_by_cost(n.astype(float) ** 2, 2e6):
            lo, hi = ends[i], ends[j]
            part, group = fps[lo:hi], np.repeat(np.arange(j - i), n[i:j])
            tree, ask = np.flatnonzero(in_tree[lo:hi]), np.flatnonzero(asks[lo:hi])
            q, node = BkForest(part[tree], group[tree]).search(part[ask], group[ask], RADIUS)
            root = local_roots(hi - lo, ask[q], tree[node])
            linked = np.flatnonzero(root != np.arange(hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(part[linked].view(np.int64)), pa.array(part[root[linked]].view(np.int64))], ["u", "v"])


def shard_keys(n: int) -> list[list[tuple[int, int]]]:
    """For n fingerprints the shard keys, each a list of (shift, width) of bits: two fingerprints within RADIUS agree in
    one key at least.

    The 64 bits are cut into RADIUS + j blocks; RADIUS differing bits leave j blocks untouched, whichever they are, and
    every j blocks make a key. Of a key's bits so many are used that a shard has SHARD_NODES of n random fingerprints.
    """
    wanted = max(0, (max(1, n) // SHARD_NODES).bit_length() - 1)
    if not wanted:
        return [[]]
    for j in range(1, 9):
        ends = [64 * k // (RADIUS + j) for k in range(RADIUS + j + 1)]
        if j * (64 // (RADIUS + j)) >= wanted or j == 8:
            break
    keys = []
    for blocks in combinations(range(RADIUS + j), j):
        left, parts = wanted, []
        for k in blocks:
            width = min(left, ends[k + 1] - ends[k])
            parts.append((ends[k], width))
            left -= width
        keys.append(parts)
    return keys


def _keyed(fps: DataFrame, n: int) -> DataFrame:
    """(fp, block, key): every fingerprint under each of its shard keys."""
    keys = []
    for k, parts in enumerate(shard_keys(n)):
        value = F.lit(0).cast("long")
        for shift, width in parts:
            value = F.shiftleft(value, width) + F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.struct(F.lit(k).alias("block"), value.alias("key")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("_k")).select("fp", "_k.block", "_k.key")


def links(fps: DataFrame, n: int) -> DataFrame:
    """Links (u, v) that connect every two of n distinct fingerprints (column fp) within the radius; not all such pairs."""
    units, counts = in_units(_keyed(fps, n), ["block", "key"], "fp", MOST_NODES)
    units = units.groupBy("block", "key", "unit_a", "unit_b").agg(F.collect_list("fp").alias("fps"), F.collect_list("chunk").alias("chunks"))
    found = materialise(units.mapInArrow(lean(_shard_links), "u long, v long").distinct())
    discard(counts)
    return found


def _rooted(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (id, fp): (fp, n, root), the root being one fingerprint of each component, and (root, members, component_id)."""
    fps = materialise(marked.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = links(fps, fps.count())
    root = components(found)
    rooted = materialise(fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = materialise(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("component_id")))
    for done in (fps, found, root):
        discard(done)
    return rooted, least


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Texts that are null, empty or white space have fingerprint 0 and link as any other. Rows that repeat an id or a
    text are returned as often as they come; a null id is returned but is no component's smallest id unless it stands
    alone, when the component is null. An empty table gives an empty result. Other columns are not read.
    Copies share a fingerprint and are linked through it once, never pair by pair.
    """
    marked = materialise(fingerprints(docs, id_col, text_col))
    rooted, least = _rooted(marked)
    named = materialise(joined(rooted, least, ["root"], "members", F.col("fp")).select("fp", "n", "component_id"))
    out = joined(marked, named, ["fp"], "n", F.col("id"))
    for done in (rooted, least):
        discard(done)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their components: those of the smallest id.

    Different texts under one id are rows of their own, and rows with a null id are compared as all are; they stand for
    a component only if it has no other. Of rows that agree in id and text one stays.
    """
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    marked = materialise(fingerprints(texts, "key", "text"))
    rooted, least = _rooted(marked)
    groups = joined(marked, rooted, ["fp"], "n", F.col("id")).select(F.col("id").alias("key"), "root")
    discard(least)
    return first_of_each(docs, groups, id_col, text_col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
