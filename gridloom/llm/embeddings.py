"""Embedding near-duplicates: lattice hashing in E8 with probed neighbour cells, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gridloom.llm.common import discard, flat_lists, in_units, joined, lean, local_roots, materialise, small_batches, table
from gridloom.llm.components import components

COSINE = 0.93
#: Tables of two E8 blocks each; a vector enters the cell of its lattice point and those of the nearest other points.
#: At these values a pair of cosine 0.93 in 64 dimensions shares a cell with probability over 0.99, one of cosine 0 in
#: about one case in a thousand.
TABLES, BLOCKS, SCALE, PROBES, SEED = 8, 2, 4.0, 3, 8
#: Cells with more rows are split; a unit holds about twice as many rows at most.
CELL_ROWS = 256


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The closest integer point with an even sum: round, and where the sum is odd, move the worst coordinate."""
    point = np.rint(x)
    error = x - point
    worst = np.abs(error).argmax(axis=-1)[..., None]
    odd = (point.sum(axis=-1, keepdims=True) % 2) != 0
    step = np.where(np.take_along_axis(error, worst, -1) >= 0, 1.0, -1.0)
    np.put_along_axis(point, worst, np.take_along_axis(point, worst, -1) + np.where(odd, step, 0), -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The closest point of E8, the union of D8 and of D8 moved by one half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=-1, keepdims=True) <= ((x - b) ** 2).sum(axis=-1, keepdims=True)
    return np.where(nearer, a, b)


def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            out.append([a if k == i else b if k == j else 0.0 for k in range(8)])
    out += [list(signs) for signs in product((0.5, -0.5), repeat=8) if sum(s < 0 for s in signs) % 2 == 0]
    return np.array(out)


class LatticeHash:
    """Cells of unit vectors of one dimension: for each table the home cell and the probed ones, as 32-bit hashes."""

    def __init__(self, dim: int):
        rng = np.random.default_rng([SEED, dim])
        width = 8 * BLOCKS
        self.projections = []
        for _ in range(TABLES):
            q = np.linalg.qr(rng.standard_normal((max(dim, width), width)))[0][:dim]
            self.projections.append(q * SCALE * np.sqrt(max(dim, width) / 64))
        self.mix = rng.integers(1, 2**62, (TABLES, width), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.moves = shortest_e8()

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, TABLES * (1 + PROBES)) hashes. Cells of different tables may share one; those who meet there are verified as all are."""
        n, out = len(unit), []
        for projection, mix in zip(self.projections, self.mix, strict=True):
            y = (unit @ projection).reshape(n, BLOCKS, 8)
            home = nearest_e8(y)
            gain = ((y - home) @ self.moves.T).reshape(n, -1)  # the larger, the nearer the neighbour
            order = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
            points = np.repeat(home[:, None], 1 + PROBES, axis=1)
            for k in range(PROBES):
                points[np.arange(n), k + 1, order[:, k] // 240] += self.moves[order[:, k] % 240]
            h = ((2 * points).reshape(n, 1 + PROBES, -1).astype(np.int64).astype(np.uint64) * mix).sum(axis=-1)
            out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32).view(np.int32))
        return np.concatenate(out, axis=1)


def _vectors(values: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors; scaled by their largest component first, so that no square overflows or vanishes."""
    x = values.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _with_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, LatticeHash] = {}
    for b in batches:
        values, n = flat_lists(b, "embedding")
        ends, cells = np.concatenate(([0], np.cumsum(n))), [None] * len(n)
        for dim in np.unique(n).tolist():
            rows = np.flatnonzero(n == dim)
            x = np.concatenate([values[ends[r] : ends[r + 1]] for r in rows])
            for r, c in zip(rows.tolist(), known.setdefault(dim, LatticeHash(dim)).cells(_vectors(x, dim)), strict=True):
                cells[r] = c
        flat = pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int32))
        width = TABLES * (1 + PROBES)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * width), flat)], [*b.schema.names, "cells"])


def _first_meeting(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """For pairs of rows of sorted cells: whether `cell` is the first that both have, so that no pair counts twice."""
    before = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] < cell)
    return ~before.any(axis=(1, 2))


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member with links first met in its unit: their number, copies counted, and a member linked to all of them."""
    for b in batches:
        members = b.column(b.schema.get_field_index("members"))
        n, rows = np.diff(members.offsets.to_numpy()), members.flatten()
        field = {rows.type.field(k).name: c for k, c in enumerate(rows.flatten())}
        no, weight, chunk = (field[x].to_numpy() for x in ("no", "weight", "chunk"))
        values = field["embedding"].flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(np.diff(field["embedding"].offsets.to_numpy()))))
        cells = field["cells"].flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.int32)
        ends, out = np.concatenate(([0], np.cumsum(n))), []
        for k, (cell, ua, ub) in enumerate(zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("cell", "unit_a", "unit_b")), strict=True)):
            lo, hi = ends[k], ends[k + 1]
            own = chunk[lo:hi]
            left, right = (np.arange(hi - lo),) * 2 if ua == ub else (np.flatnonzero(own == ua), np.flatnonzero(own == ub))
            x = _vectors(values[at[lo] : at[hi]], int((at[hi] - at[lo]) // max(1, hi - lo)))
            i, j = np.nonzero(x[left] @ x[right].T >= COSINE)
            i, j = left[i], right[j]
            if ua == ub:
                i, j = i[i < j], j[i < j]
            first = np.zeros(len(i), bool)
            for s in range(0, len(i), 4096):
                first[s : s + 4096] = _first_meeting(cells[lo + i[s : s + 4096]], cells[lo + j[s : s + 4096]], cell)
            i, j = i[first], j[first]
            if not len(i):
                continue
            w = weight[lo:hi]
            count = np.bincount(i, w[j], hi - lo) + np.bincount(j, w[i], hi - lo)
            root = local_roots(hi - lo, i, j)
            hit = np.flatnonzero(count > 0)
            out.append((no[lo + hit], count[hit].astype(np.int64), no[lo + root[hit]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["no", "links", "root"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; rows with equal labels and a cosine of COSINE or more are linked.

    Equal vectors of a label form one class that is hashed and compared once; its copies are links of each other and
    count as links of every class it is linked to. A row links with nothing, and is its own component, if its label or
    vector is null, the vector is empty or zero, or a component is null, NaN or infinite. A row with a null id links
    with nothing either; its component is null and it is not kept. Repeated ids are rows of their own. Vectors of
    different lengths are not compared. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    if isinstance(rows.schema["embedding"].dataType, ArrayType) and rows.schema["embedding"].dataType.elementType != DoubleType():
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    classes = rows.where(sound).groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = classes.withColumns({"no": F.monotonically_increasing_id(), "dim": F.size("embedding")})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    classes = materialise(classes.mapInArrow(lean(_with_cells), f"{kinds}, cells array<int>"))
    # only numbers and cells are dealt into units; vectors go to the members of units, not to every cell
    keyed = classes.select("label", "dim", "no", F.explode(F.array_distinct("cells")).alias("cell"))
    units, sizes = in_units(keyed, ["label", "dim", "cell"], "no", CELL_ROWS)
    units = units.join(classes.select("no", "weight", "embedding", "cells"), "no").groupBy("label", "dim", "cell", "unit_a", "unit_b")
    units = units.agg(F.collect_list(F.struct("no", "weight", "chunk", "embedding", "cells")).alias("members"))
    met = materialise(units.select("cell", "unit_a", "unit_b", "members").mapInArrow(lean(_unit_links), "no long, links long, root long"))
    counts = met.groupBy("no").agg(F.sum("links").alias("links"))
    roots = components(met.where("no <> root").select(F.col("no").alias("u"), F.col("root").alias("v")).distinct())
    linked = classes.select("no", "rep", "label", "embedding", "weight").join(counts, "no", "left").join(roots.withColumnRenamed("node", "no"), "no", "left")
    linked = materialise(linked.withColumn("root", F.coalesce("root", "no")))
    least = materialise(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = joined(linked, least, ["root"], "members", F.col("no"))
    named = materialise(named.select("label", "embedding", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    for done in (classes, sizes, met, roots, linked, least):
        discard(done)
    good = joined(rows.where(sound), named, ["label", "embedding"], "weight", F.col("id")).select("id", "n_links", "component_id")
    odd = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return good.unionByName(odd).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_embeddings": op8_embeddings}
SQL = {
    "op8_embeddings": """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (SELECT r, vec_id, label, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT r, r FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
component AS (SELECT reach.a, min(e.vec_id) AS c FROM reach JOIN e ON e.r = reach.b GROUP BY reach.a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, coalesce(vec_id = c, false) AS kept
FROM e LEFT JOIN n ON n.a = e.r LEFT JOIN component ON component.a = e.r
"""
}
