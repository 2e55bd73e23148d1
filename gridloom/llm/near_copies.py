"""Near copies: texts whose sets of word shingles are alike, proposed by seeded SimHash fingerprints and verified exactly.

1. Distinct texts get 32 fingerprints of 64 bits over their distinct shingles, each with the smallest of its seeded
   hashes. Texts share a cell if for one of the first 8 the smallest hash and one of eight bytes are equal, so texts
   that share no shingle don't meet, however many there are. At a Jaccard similarity of 0.8 a seed brings two long texts
   together in 74 of 100 cases, one of the 8 in over 99.99. Short texts also meet under their smallest shingle hashes,
   of which two texts as alike as asked always share one, because majorities over few shingles vary more.
2. Cells with one member go before anything but cell and number has been shuffled. A cell of over MEMBERS texts is dealt
   into chunks of about so many, each with the cell's few pivots, so that no task holds a whole hot cell.
3. A chunk is a shard: its different fingerprints of 2,048 bits make a BK-tree, whose children hang by integer Hamming
   distance, and its members search it. Pairs within RADIUS, with numbers of shingles that allow the similarity, are
   candidates, in the first cell that they share.
4. Candidates are verified on their shingles, as bytes, and become links only if the similarity is reached.
5. A chunk with very many candidates proposes one for each member first, the first, a pivot if one is near. Once what
   these link is known, cells that are in one group are done. In the others each member of a group but the largest meets
   all members that are still apart, in units of bounded size, where the candidates of their BK-trees are compared by
   their shingle hashes. A unit gives no pairs but those that connect its groups, fewer than its members, so texts that
   are alike, but less than asked, make no rows. Only of texts with more than HELD shingles first the nearest of a unit
   are verified, in the end all that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.anchors import mixed
from gridloom.llm.common import as_bytes, discard, first_of_each, joined, lean, materialise, ranges, slices_by_cost, spread
from gridloom.llm.components import components
from gridloom.llm.repeats import distinct_texts, drop
from gridloom.llm.simhash import BkForest

WORDS = 5
#: The least Jaccard similarity of a link, as numerator and denominator.
SIMILARITY = (4, 5)
FINGERPRINTS = 32
#: So many of them make cells.
SEEDS = 8
#: Of 2,048 bits; a pair at 0.8 differs in about 310, standard deviation 16. Of texts with up to FEW shingles in 384 at most.
RADIUS, WIDE, FEW = 392, 472, 16
#: Texts with up to so many shingles also enter the cells of their smallest shingle hashes.
SHORT = 80
#: A cell with more candidates per member proposes in steps.
DENSE = 2
#: Texts of one cell that are compared in one unit; larger cells are dealt over several.
MEMBERS = 4096
#: About so many members of a large cell, those of the smallest hashes, are in all of its chunks.
PIVOTS = 8
#: Texts with up to so many shingles are compared by all their hashes in the units of what no links connect: 8 KB a member.
HELD = 1024
_SLICE = 1 << 12
_SEEDS = np.arange(1, FINGERPRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: A cell's last seven bits are its place among the cells of a text; those of smallest shingles have the place after.
_PLACES = 8 * SEEDS
_PLACE = np.uint64(127)
#: A sketch: the fingerprints, and of the seeds' smallest hashes the upper 32 bits.
_SKETCH = 8 * FINGERPRINTS + 4 * SEEDS


def shingles(text: bytes | None, words: int = WORDS) -> set[bytes]:
    """Distinct runs of so many words, A-Z lowered, words between ASCII white space; of a shorter text all its words."""
    w = (text or b"").lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def alike(a: set[bytes], b: set[bytes], similarity: tuple[int, int] = SIMILARITY) -> bool:
    """Whether the Jaccard similarity is reached; texts without words are alike."""
    both = len(a & b)
    return similarity[1] * both >= similarity[0] * (len(a) + len(b) - both)


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FINGERPRINTS fingerprints of a set of shingle hashes: in each bit, what most of the seeded hashes have.

    Also the upper 32 bits of the smallest hash of each of the first SEEDS seeds.
    """
    counts, least = np.zeros(64 * FINGERPRINTS, np.int64), np.full(SEEDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _SLICE):
        seeded = mixed(hashes[at : at + _SLICE, None] ^ _SEEDS)
        least = np.minimum(least, seeded[:, :SEEDS].min(axis=0))
        bits = np.unpackbits(seeded.view(np.uint8), axis=1).view(np.uint64)
        lanes = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        counts += lanes.view(np.uint8).reshape(-1, 64 * FINGERPRINTS).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64), (least >> np.uint64(32)).astype(np.uint32)


def cells(hashes: np.ndarray, prints: np.ndarray, least: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The cells of a text with these sorted shingle hashes, fingerprints and smallest seeded hashes."""
    places = np.arange(_PLACES, dtype=np.uint64)
    blocks = prints[:SEEDS].view(np.uint8).astype(np.uint64)
    own = mixed(np.repeat(least.astype(np.uint64), 8) << np.uint64(8) | blocks) & ~_PLACE | places
    if len(hashes) <= SHORT:
        needed = -(-len(hashes) * similarity[0] // similarity[1])
        short = np.unique(hashes[: len(hashes) - needed + 1] & ~_PLACE) | np.uint64(_PLACES)
        own = np.concatenate([own, short])
    return own.view(np.int64)


def _with_cells(words: int, similarity: tuple[int, int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sketches, own = [], [], []
            for text in as_bytes(b.column(1)):
                # mixed() of distinct digests is distinct
                h = np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, words)], np.uint64))
                prints, least = fingerprints(h)
                counts.append(len(h))
                sketches.append(prints.tobytes() + least.tobytes())
                own.append(cells(h, prints, least, similarity))
            flat = pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "sketch", "cells"])

    return scan


def _numbers(column: pa.Array) -> np.ndarray:
    """A column's values; sketches as rows of bytes, lists as arrays."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), _SKETCH)
    if pa.types.is_list(column.type):
        out, flat, ends = np.empty(len(column), object), column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
        for k, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)):
            out[k] = flat[a:z]
        return out
    return column.to_numpy(zero_copy_only=False)


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come sorted by unit, the first column, cut so that no unit is in two parts."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        columns = [_numbers(c) for c in b.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if held and (cut or columns[0][0] != held[-1][0][-1]):
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns], strict=True)]
            held = []
        elif cut:
            yield [c[:cut] for c in columns]
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _near(
    unit: np.ndarray, cell: np.ndarray, n: np.ndarray, sketch: np.ndarray, similarity: tuple[int, int], apart=None, side: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates i < j of one unit, if its cell is the first that they share, and in how many bits they differ; a bounded number at a time.

    Each unit has a BK-tree of its different fingerprints, which its members search. Of all pairs of a unit, or of those
    for which apart(i, j) holds. Members on side 1 are in the tree alone, those on side 2 search alone, others do both.
    """
    prints = np.ascontiguousarray(sketch[:, : 8 * FINGERPRINTS]).view(np.uint64)
    blocks, least = sketch[:, : 8 * SEEDS].reshape(-1, SEEDS, 8), np.ascontiguousarray(sketch[:, 8 * FINGERPRINTS :]).view(np.uint32)
    place = (cell.view(np.uint64) & _PLACE).astype(np.int64)
    _, group, size = np.unique(unit, return_inverse=True, return_counts=True)
    side = np.zeros(len(unit), np.int64) if side is None else side
    rows, asks = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    # members of equal fingerprints are one node
    whole = np.column_stack([group[rows].astype(np.uint64), prints[rows]]).view(np.dtype((np.void, 8 * FINGERPRINTS + 8)))[:, 0]
    _, head, kind = np.unique(whole, return_index=True, return_inverse=True)
    tree = BkForest(prints[rows[head]], group[rows[head]])
    rows, many = rows[np.argsort(kind, kind="stable")], np.bincount(kind, minlength=len(head))
    begin = np.cumsum(many) - many
    # one of up to FEW shingles may be as alike as asked to one of a quarter more
    radius = np.where(n <= FEW, WIDE, RADIUS)
    reach = np.where(similarity[0] * n <= similarity[1] * FEW, WIDE, RADIUS)
    for lo, hi in slices_by_cost(size[group[asks]], 1 << 18):
        own = asks[lo:hi]
        q, node, bits = tree.within(prints[own], group[own], reach[own])
        q, bits, other = np.repeat(own[q], many[node]), np.repeat(bits, many[node]), rows[ranges(begin[node], many[node])]
        i, j = np.minimum(q, other), np.maximum(q, other)
        hit = (other < q) | (side[q] == 2)
        hit &= (similarity[1] * np.minimum(n[i], n[j]) >= similarity[0] * np.maximum(n[i], n[j])) & (bits <= np.maximum(radius[i], radius[j]))
        i, j, bits = i[hit], j[hit], bits[hit]
        for at in range(0, max(1, len(i)), 1 << 15):
            x, y, d = i[at : at + (1 << 15)], j[at : at + (1 << 15)], bits[at : at + (1 << 15)]
            if apart is not None:
                hit = apart(x, y)
                x, y, d = x[hit], y[hit], d[hit]
            meet = ((blocks[x] == blocks[y]) & (least[x] == least[y])[:, :, None]).reshape(len(x), _PLACES)
            first = np.where(meet.any(axis=1), meet.argmax(axis=1), _PLACES) == place[x]
            yield x[first], y[first], d[first]


def _pairs(ids: np.ndarray, i: np.ndarray, j: np.ndarray, *first: pa.Array) -> pa.RecordBatch:
    """Rows (u, v), u the larger number; after the columns `first`, if there are any."""
    u, v = np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])
    return pa.RecordBatch.from_arrays([*first, pa.array(u), pa.array(v)], [*["cell"][: len(first)], "u", "v"])


def _proposals(similarity: tuple[int, int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates (u, v); for dense chunks one of each member. Members of dense and of dealt cells as rows with their cell."""
        for unit, cell, ids, listed, dealt, n, sketch in _whole_units(batches):
            start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            size = np.diff(start, append=len(unit))
            parted = np.logical_or.reduceat(dealt, start)
            whole = (size <= 2 * DENSE + 1) & ~parted
            small = np.repeat(whole, size)
            for i, j, _ in _near(unit[small], cell[small], n[small], sketch[small], similarity):
                yield _pairs(ids[small], i, j, pa.nulls(len(i), pa.int64()))
            for a, m, listing in zip(start[~whole].tolist(), size[~whole].tolist(), parted[~whole].tolist(), strict=True):
                part = slice(a, a + m)
                own = ids[part]
                low, kept, found = np.full(m, m), [], 0
                for i, j, _ in _near(unit[part], cell[part], n[part], sketch[part], similarity):
                    np.minimum.at(low, j, i)
                    found += len(i)
                    if found <= DENSE * m:
                        kept.append((i, j))
                if found > DENSE * m:
                    j = np.flatnonzero(low < m)
                    kept = [(low[j], j)]
                for i, j in kept:
                    yield _pairs(own, i, j, pa.nulls(len(i), pa.int64()))
                if found > DENSE * m or listing:
                    here = listed[part]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[part][here]), pa.array(own[here]), pa.nulls(int(here.sum()), pa.int64())], ["cell", "u", "v"])

    return scan


def _held(words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingle hashes of texts with up to HELD of them, none of longer ones."""
        for b in batches:
            own = [np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, words)], np.uint64) for text in as_bytes(b.column(1))]
            own = [np.unique(h) if len(h) <= HELD else h[:0] for h in own]
            flat = pa.array((np.concatenate(own) if own else np.zeros(0, np.uint64)).view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], ["id", "hashes"])

    return scan


def _common(hashes: np.ndarray):
    """A function of i and j, which says how many hashes each two of these lists have in common."""
    size = np.array(list(map(len, hashes)), np.int64)
    values, codes = np.unique(np.concatenate(hashes), return_inverse=True)
    begin, marked = np.cumsum(size) - size, np.zeros(len(values), bool)

    def count(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if len(np.unique(i)) > len(np.unique(j)):
            i, j = j, i
        order, out = np.argsort(i, kind="stable"), np.zeros(len(i), np.int64)
        starts = np.flatnonzero(np.diff(i[order], prepend=-1))
        for a, z in pairwise([*starts.tolist(), len(i)]):
            one, at = i[order[a]], order[a:z]
            mine = codes[begin[one] : begin[one] + size[one]]
            marked[mine] = True
            for lo, hi in slices_by_cost(size[j[at]], 1 << 20):
                others = j[at[lo:hi]]
                sums = np.concatenate(([0], np.cumsum(marked[codes[ranges(begin[others], size[others])]])))
                ends = np.cumsum(size[others])
                out[at[lo:hi]] = sums[ends] - sums[ends - size[others]]
            marked[mine] = False
        return out

    return count


def _apart(similarity: tuple[int, int], first: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of units whose ends no links connect yet.

        Pairs with up to HELD shingles each are compared here at first, and of those that are alike so many are given as
        connect what they connect. Of the others those of each member with the nearest in a unit at first, all then.
        """
        for unit, cell, ids, chunk, crossing, root, n, sketch, hashes in _whole_units(batches):
            start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            lowest = np.repeat(np.minimum.reduceat(chunk, start), np.diff(start, append=len(unit)))
            side = np.where(crossing, np.where(chunk == lowest, 1, 2), 0)
            _, label = np.unique(root, return_inverse=True)
            held, common = n <= HELD, _common(hashes) if first else None

            def apart(i, j, chunk=chunk, crossing=crossing, label=label, held=held):
                return (label[i] != label[j]) & ((chunk[i] != chunk[j]) == crossing[i]) & (first | ~(held[i] & held[j]))

            best, other = np.full(len(cell), 64 * FINGERPRINTS + 1), np.full(len(cell), -1)
            for i, j, bits in _near(unit, cell, n, sketch, similarity, apart, side):
                if not first:
                    yield _pairs(ids, i, j)
                    continue
                both = held[i] & held[j]
                x, y = i[both], j[both]
                shared = common(x, y)
                good = similarity[1] * shared >= similarity[0] * (n[x] + n[y] - shared)
                linked = []
                for a, b in zip(x[good].tolist(), y[good].tolist(), strict=True):
                    if label[a] != label[b]:
                        label[label == label[b]] = label[a]
                        linked.append((a, b))
                if linked:
                    yield _pairs(ids, *np.array(linked).T)
                i, j, bits = i[~both], j[~both], bits[~both]
                for one, two in ((i, j), (j, i)):
                    order = np.lexsort((bits, one))
                    one, two, d = one[order], two[order], bits[order]
                    head = np.append(True, one[1:] != one[:-1])[: len(one)]
                    one, two, d = one[head], two[head], d[head]
                    nearer = d < best[one]
                    best[one[nearer]], other[one[nearer]] = d[nearer], two[nearer]
            at = np.flatnonzero(other >= 0)
            yield _pairs(ids, at, other[at])

    return scan


def _verified(words: int, similarity: tuple[int, int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for b in batches:
            good = []
            for one, other in zip(as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True):
                if other != last:
                    last, known = other, shingles(other, words)
                good.append(alike(shingles(one, words), known, similarity))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in b.columns[:2]], ["u", "v"])

    return scan


def _chunks(marked: DataFrame, members: int) -> tuple[DataFrame, DataFrame]:
    """(unit, cell, id, listed, dealt) of cells that two texts share, and the table of counts, for discard() later.

    A cell of more than `members` is dealt over chunks; its pivots are in all of them, but listed in one only.
    """
    rows = marked.select(F.explode("cells").alias("cell"), "id")
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    counts = materialise(counts.withColumns({"c": F.ceil(F.col("_n") / F.lit(members)).cast("int"), "n": F.col("_n")}))
    met = joined(rows, counts, ["cell"], "_n", F.col("id"), literal=True)
    own = F.pmod(F.xxhash64("cell", "id"), F.col("c")).cast("int")
    met = met.withColumns({"own": own, "pivot": (F.col("c") > 1) & (spread(5, "cell", "id") * F.col("n") < PIVOTS)})
    met = met.withColumn("chunk", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array("own"))))
    unit = F.when(F.col("c") == 1, F.col("cell")).otherwise(F.xxhash64("cell", "chunk"))
    return met.select(unit.alias("unit"), "cell", "id", (F.col("chunk") == F.col("own")).alias("listed"), (F.col("c") > 1).alias("dealt"), "pivot"), counts


def _open_units(dense: DataFrame, root: DataFrame, members: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unit, cell, id, chunk, crossing, root) of cells with members that no links connect, and two tables for discard().

    Members of a cell's largest group, and all others, are dealt into chunks; any two chunks but two of the largest group
    are a unit. A cell with `members` or fewer is one unit.
    """
    rooted = dense.join(root.withColumnRenamed("node", "id"), "id", "left")
    rooted = materialise(rooted.select("cell", "id", F.coalesce("root", "id").alias("root")))
    sizes = rooted.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("cell").agg(F.sum("m").alias("_n"), F.max(F.struct("m", "root")).alias("top")).where("_n > top.m")
    others = F.ceil((F.col("_n") - F.col("top.m")) / F.lit(members))
    largest = F.ceil(F.col("top.m") / F.lit(members))
    one = F.col("_n") <= members
    sizes = sizes.select("cell", "_n", F.col("top.root").alias("top"), F.when(one, 1).otherwise(others).cast("int").alias("b"), F.when(one, 0).otherwise(largest).cast("int").alias("a"))
    sizes = materialise(sizes)
    met = joined(rooted, sizes, ["cell"], "_n", F.col("id"))
    inside = (F.col("root") == F.col("top")) & (F.col("a") > 0)
    chunk = F.when(inside, F.col("b") + F.pmod(F.xxhash64("cell", "id"), F.col("a"))).otherwise(F.pmod(F.xxhash64("cell", "id"), F.col("b")))
    met = met.withColumn("chunk", chunk.cast("int"))
    met = met.withColumn("y", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("b")).otherwise(F.col("a") + F.col("b")) - 1)))
    unit = F.xxhash64("cell", F.least("chunk", "y"), F.greatest("chunk", "y"))
    return met.select(unit.alias("unit"), "cell", "id", "chunk", (F.col("chunk") != F.col("y")).alias("crossing"), "root"), rooted, sizes


def groups(
    docs: DataFrame, text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, members: int = MEMBERS
) -> DataFrame:
    """(key, root) of the distinct texts that have a near copy: their digest, and one of their group. Null counts as empty.

    The cells and radii are made for a similarity of 0.8 or more; less is refused, as links would be lost.
    """
    if similarity[0] * SIMILARITY[1] < SIMILARITY[0] * similarity[1]:
        raise ValueError("near copies are found from a similarity of 0.8 on")
    spark = docs.sparkSession
    texts = distinct_texts(docs, text_col)
    scan = lean(_with_cells(words, similarity))
    marked = texts.select("key", "text").mapInArrow(scan, "key binary, n long, sketch binary, cells array<long>")
    marked = materialise(marked.withColumn("id", F.monotonically_increasing_id()))
    sketches = marked.select("id", "n", "sketch")

    units, counts = _chunks(marked, members)
    # pivots come first; their ids needn't be the smallest
    met = units.join(sketches, "id").repartition("unit").sortWithinPartitions("unit", F.desc("pivot"), "id")
    met = met.select("unit", "cell", "id", "listed", "dealt", "n", "sketch")
    found = materialise(met.mapInArrow(lean(_proposals(similarity)), "cell long, u long, v long"))

    def verified(pairs: DataFrame) -> DataFrame:
        name = marked.select("id", "key")
        named = pairs.join(name.toDF("u", "a"), "u").join(name.toDF("v", "b"), "v")
        both = named.join(texts.select(F.col("key").alias("a"), F.col("text").alias("s")), "a")
        both = both.join(texts.select(F.col("key").alias("b"), F.col("text").alias("t")), "b")
        return materialise(both.select("u", "v", "s", "t").mapInArrow(lean(_verified(words, similarity)), "u long, v long"))

    tried = materialise(found.where("cell IS NULL").select("u", "v").distinct())
    links = verified(tried)
    root = components(links)
    used = [counts, tried, links, root]
    dense = found.where("cell IS NOT NULL").select("cell", F.col("u").alias("id"))
    if not dense.isEmpty():
        named = dense.select("id").distinct().join(marked.select("id", "key"), "id").join(texts.select("key", "text"), "key")
        hashes = materialise(named.select("id", "text").mapInArrow(lean(_held(words)), "id long, hashes array<long>"))
        used.append(hashes)
        for first in (True, False):
            if not first:
                long = dense.join(marked.where(F.col("n") > HELD).select("id"), "id", "left_semi").select("cell").distinct()
                dense = dense.join(long, "cell", "left_semi")
                if dense.isEmpty():
                    break
            units, *tables = _open_units(dense, root, members)
            met = units.join(sketches, "id").join(hashes, "id").repartition("unit").sortWithinPartitions("unit", "id")
            met = met.select("unit", "cell", "id", "chunk", "crossing", "root", "n", "sketch", "hashes")
            more = met.mapInArrow(lean(_apart(similarity, first)), "u long, v long").distinct()
            more = materialise(more.join(tried, ["u", "v"], "left_anti"))
            further = verified(more)
            tried, links = tried.unionByName(more), links.unionByName(further)
            root = components(links)
            used += [*tables, more, further, root]
    member = root.select(F.col("node").alias("id"), "root").unionByName(root.select(F.col("root").alias("id"), "root").distinct()).distinct()
    out = materialise(marked.select("id", "key").join(member, "id").select("key", "root"))
    drop(texts)
    for done in (marked, found, *used):
        discard(done)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their groups of near copies: those of the smallest id.

    Different texts under one id are rows of their own, and rows with a null id are compared as all are; they stand for
    a group only if it has no other. Of rows that agree in id and text one stays.
    """
    return first_of_each(docs, groups(docs, text_col, words, similarity), id_col, text_col)
