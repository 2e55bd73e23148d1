"""Windows of items that occur more than once in a corpus: the steps that word and byte deduplication share.

1. Distinct texts, with their number of copies, go into a table bucketed by their digest; copies are not looked at again.
2. Every text's anchors (see anchors.py) are counted; an anchor that occurs once leads to no repeated window.
3. Runs of windows under a repeated anchor are brought together by the anchor's hash, and a resolver finds equal windows.
4. Windows whose anchor has very many runs are taken through 2 and 3 again with longer anchors. Where even the longest
   has very many, equal runs are one kind, the windows of each kind are their own anchors, and two of each are resolved
   for all. So no task gets more than HOT_RUNS runs of one anchor, and every repeat is settled by the resolver.
5. What the repeated windows cover is cut out of each distinct text, and the result goes to all its copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.anchors import anchors
from gridloom.llm.common import as_bytes, discard, joined, lean, materialise, ranges, shared_folder, small_batches, text_key

#: Windows under an anchor with more runs than this, about 20 MB of them in a task, get longer anchors.
HOT_RUNS = 50_000
#: Rows that a resolver gets at a time hold at most about so many bytes, if no single anchor has more.
BLOCK_BYTES = 2 << 20


@dataclass(frozen=True)
class Kind:
    """How a text is cut into items. items gives integers, equal for equal items; cut gives the bytes of items i .. j-1.

    grams are the lengths of the anchors, one for each level.
    """

    window: int
    grams: tuple[int, ...]
    parse: Callable[[bytes], tuple[np.ndarray, object]]
    cut: Callable[[object, int, int], bytes]


@dataclass
class Runs:
    """Runs of one resolver block, sorted by anchor: windows k of run r start at item first[r] + k of text keys[r].

    Of equal runs of one anchor there are two, however many texts hold them.
    """

    group: np.ndarray  # number of the anchor
    offset: np.ndarray  # items from the first window's start to the anchor
    windows: np.ndarray
    segments: list[bytes]  # the items that the windows cover


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, text, copies), one row per distinct text, as a table bucketed by key, so that later joins move no text."""
    spark = docs.sparkSession
    rows = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = rows.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name, parts = f"gridloom_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.bucketBy(parts, "key").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out._gridloom_path, out._gridloom_table = f"{shared_folder(spark)}/{name}", name
    return out


def drop(texts: DataFrame) -> None:
    """Remove a table that distinct_texts() made and that no later plan reads."""
    texts.sparkSession.sql(f"DROP TABLE IF EXISTS {texts._gridloom_table}")
    discard(texts)


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def runs_at(kind: Kind, items: np.ndarray, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of the runs of the level after those whose hot anchors are given: windows
    first .. last lie under hot anchors on all earlier levels, and under the anchor at place on this one."""
    h, place, first, last = anchors(items, kind.window, kind.grams[len(hot)])
    if not hot:
        return h, place, first, last
    under = np.ones(max(0, len(items) - kind.window + 1), bool)
    for gram, known in zip(kind.grams, hot, strict=False):
        g, _, a, z = anchors(items, kind.window, gram)
        here, mark = np.isin(g, known), np.zeros(len(under), bool)
        mark[ranges(a[here], z[here] - a[here] + 1)] = True
        under &= mark
    owner = np.repeat(np.arange(len(h)), last - first + 1)  # of every window, as the runs follow each other
    at = np.flatnonzero(under)
    begins = (np.diff(at, prepend=-2) != 1) | (np.diff(owner[at], prepend=-1) != 0)
    start, end = at[begins], at[np.append(begins[1:], True)] if len(at) else at
    return h[owner[start]], place[owner[start]], start, end


def _rows(kind: Kind, b: pa.RecordBatch, hot_from: int) -> Iterator[tuple]:
    """(number of the row, items, handle, hot anchors by level) of each text."""
    hot = [c for c in b.columns[hot_from:]]
    for r, text in enumerate(as_bytes(b.column(1))):
        items, handle = kind.parse(text)
        yield r, items, handle, [c[r].values.to_numpy().view(np.uint64) for c in hot]


def _anchor_counts(kind: Kind):
    """(h, key, n): the anchors of each text. Columns: key, text, hot anchors of earlier levels."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts = [], []
            for _, items, _, hot in _rows(kind, b, 2):
                h, n = np.unique(runs_at(kind, items, hot)[0], return_counts=True)
                hashes.append(h)
                counts.append(n)
            if hashes:
                keys = b.column(0).take(pa.array(np.repeat(np.arange(len(hashes)), [*map(len, hashes)])))
                yield _batch({"h": (np.concatenate(hashes).view(np.int64), pa.int64()), "key": (keys, pa.binary()), "n": (np.concatenate(counts).astype(np.int64), pa.int64())})

    return scan


_RUN = "h long, key binary, first long, n int, offset int, segment binary"


def _runs(kind: Kind):
    """The runs under a text's wanted anchors. Columns: key, text, wanted anchors, hot anchors of earlier levels."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, items, handle, hot in _rows(kind, b, 3):
                h, place, first, last = runs_at(kind, items, hot)
                got = np.flatnonzero(np.isin(h, b.column(2)[r].values.to_numpy().view(np.uint64)))
                for k in range(0, len(got), 4096):
                    part = got[k : k + 4096]
                    a, z = first[part], last[part]
                    cut = [kind.cut(handle, i, j + kind.window) for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                    yield _batch({"h": (h[part].view(np.int64), pa.int64()), "key": ([b.column(0)[r].as_py()] * len(part), pa.binary()), "first": (a, pa.int64()), "n": ((z - a + 1).astype(np.int32), pa.int32()), "offset": ((place[part] - a).astype(np.int32), pa.int32()), "segment": (cut, pa.binary())})

    return scan


def _digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def _hot_runs(kind: Kind):
    """(s, key, first, n): runs that are hot on the last level too, by the digest of what they hold. Columns: key, text, hot anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, items, handle, hot in _rows(kind, b, 2):
                h, _, first, last = runs_at(kind, items, hot[:-1])
                got = np.isin(h, hot[-1])
                first, last = first[got], last[got]
                s = [_digest(kind.cut(handle, a, z + kind.window)) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
                yield _batch({"s": (s, pa.binary()), "key": ([b.column(0)[r].as_py()] * len(s), pa.binary()), "first": (first, pa.int64()), "n": ((last - first + 1).astype(np.int64), pa.int64())})

    return scan


def _windows(kind: Kind):
    """(w, s, at, key, first): the windows of runs, by their digest. Columns: key, text, places array<struct<first, n, s>>."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, places in zip(b.column(0), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                handle = kind.parse(text)[1]
                for p in places:
                    first, n = p["first"], p["n"]
                    w = [_digest(kind.cut(handle, i, i + kind.window)) for i in range(first, first + n)]
                    yield _batch({"w": (w, pa.binary()), "s": ([p["s"]] * n, pa.binary()), "at": (np.arange(n), pa.int64()), "key": ([key.as_py()] * n, pa.binary()), "first": (np.arange(first, first + n), pa.int64())})

    return scan


def _merged(kind: Kind):
    """(s, c, spans) of rows (s, c, places of repeated windows in the run): spans of items, those that touch as one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places in b.column(2):
                at = np.sort(places.values.to_numpy())
                begins = np.diff(at, prepend=-1 - kind.window) > kind.window
                out.append([{"a": a, "z": z + kind.window} for a, z in zip(at[begins].tolist(), at[np.append(begins[1:], True)].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))], ["s", "c", "spans"])

    return scan


def _cuts(kind: Kind):
    """Windows as runs of their own, keyed by their digest. Columns: key, text, places array<struct<first, w>>."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, places in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                handle = kind.parse(text)[1]
                for k in range(0, len(places), 4096):
                    part = places[k : k + 4096]
                    w, n = [p["w"] for p in part], len(part)
                    yield _batch({"h": ([int.from_bytes(x[:8], "little", signed=True) for x in w], pa.int64()), "key": (w, pa.binary()), "first": ([0] * n, pa.int64()), "n": ([1] * n, pa.int32()), "offset": ([0] * n, pa.int32()), "segment": ([kind.cut(handle, p["first"], p["first"] + kind.window) for p in part], pa.binary())})

    return scan


def _resolved(kind: Kind, resolver: Callable[[Runs], np.ndarray]):
    """Spans (key, first, end) of items that repeated windows cover. Rows come sorted by anchor."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, segments = t["h"].to_numpy(), t["segment"].to_pylist()
        seen: dict[tuple[int, bytes], int] = {}
        alike = np.fromiter((seen.setdefault(x, len(seen)) for x in zip(h.tolist(), segments, strict=True)), np.int64, len(h))
        order, size = np.argsort(alike, kind="stable"), np.bincount(alike)
        begin = np.cumsum(size) - size
        picked = np.sort(np.concatenate([order[begin], order[begin[size > 1] + 1]]))  # two of each kind
        group = np.cumsum(np.diff(h[picked], prepend=h[:1]) != 0)
        some = np.bincount(group)[group] > 1
        picked, group = picked[some], group[some]
        if not len(picked):
            return
        windows = t["n"].to_numpy()[picked].astype(np.int64)
        hit = resolver(Runs(np.unique(group, return_inverse=True)[1], t["offset"].to_numpy()[picked].astype(np.int64), windows, [segments[r] for r in picked.tolist()]))
        starts = np.cumsum(windows) - windows
        apart = starts + np.arange(len(starts))  # a gap after each run keeps the spans of two runs apart
        marks = np.zeros(len(hit) + len(starts) + 1, np.int8)
        marks[1 + ranges(apart, windows)] = hit
        opens, closes = np.flatnonzero(np.diff(marks) == 1), np.flatnonzero(np.diff(marks, append=0) == -1)
        owner = np.searchsorted(apart, opens, "right") - 1
        kinds = alike[picked[owner]]
        stands = order[begin[kinds]] == picked[owner]  # what one of a kind has, all of them have
        opens, closes, owner, kinds = opens[stands], closes[stands], owner[stands], kinds[stands]
        row, reach = order[ranges(begin[kinds], size[kinds])], size[kinds]
        if len(row):
            first = t["first"].to_numpy()[row]
            keys = t["key"].combine_chunks().take(pa.array(row))
            yield _batch({"key": (keys, pa.binary()), "first": (first + np.repeat(opens - apart[owner], reach), pa.int64()), "end": (first + np.repeat(closes - apart[owner], reach) - 1 + kind.window, pa.int64())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size > BLOCK_BYTES:
                t = pa.Table.from_batches(held)
                h = t["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield from settle(t.slice(0, cut))
                    rest = t.slice(cut).combine_chunks()
                    held, size = rest.to_batches(), rest.nbytes
        if held:
            yield from settle(pa.Table.from_batches(held))

    return scan


def repeated_spans(texts: DataFrame, kind: Kind, resolver: Callable[[Runs], np.ndarray], hot_runs: int = HOT_RUNS) -> list[DataFrame]:
    """Tables (key, first, end): items of distinct texts that are covered by windows which start at two places or more.

    Spans of a text may overlap. Copies of a text do not count as places here.
    """
    plain, source, hots, found, used = texts.select("key", "text"), texts.select("key", "text"), [], [], []

    def resolved(runs: DataFrame) -> DataFrame:
        return runs.repartition("h").sortWithinPartitions("h").mapInArrow(lean(_resolved(kind, resolver)), "key binary, first long, end long")

    for level in range(len(kind.grams)):
        counts = materialise(source.mapInArrow(lean(_anchor_counts(kind)), "h long, key binary, n long"))
        often = counts.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).where("n > 1")
        often = materialise(often.select("h", "texts", (F.col("n") > hot_runs).alias("hot")))
        wanted = materialise(joined(counts, often, ["h"], "texts", F.col("key")).groupBy("key", "hot").agg(F.collect_list("h").alias("wanted")))
        any_hot = not often.where("hot").isEmpty()
        for done in (counts, often):
            discard(done)
        used.append(wanted)
        named = source.join(wanted.where("NOT hot").select("key", "wanted"), "key").select("key", "text", "wanted", *hots)
        spans = materialise(resolved(named.mapInArrow(lean(_runs(kind)), _RUN)))
        found.append(spans)
        if not any_hot:
            break
        hots.append(f"hot{level}")
        source = source.join(wanted.where("hot").select("key", F.col("wanted").alias(hots[-1])), "key").select("key", "text", *hots)
    else:
        runs, place = source.mapInArrow(lean(_hot_runs(kind)), "s binary, key binary, first long, n long"), F.struct("key", "first", "n")
        kinds = materialise(runs.groupBy("s").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count(F.lit(1)).alias("c")))
        two = kinds.select("s", F.explode(F.array_distinct(F.array("p", "q"))).alias("p"))
        named = two.groupBy("p.key").agg(F.collect_list(F.struct("p.first", "p.n", "s")).alias("places"))
        windows = plain.join(named, "key").select("key", "text", "places").mapInArrow(lean(_windows(kind)), "w binary, s binary, at long, key binary, first long")
        windows = materialise(windows)
        place = F.struct("key", "first")
        twice = materialise(windows.groupBy("w").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b"))
        ends = twice.select("w", F.explode(F.array("a", "b")).alias("p")).groupBy("p.key").agg(F.collect_list(F.struct("p.first", "w")).alias("places"))
        cuts = plain.join(ends, "key").select("key", "text", "places").mapInArrow(lean(_cuts(kind)), _RUN)
        known = materialise(resolved(cuts).select(F.col("key").alias("w")).distinct().join(twice.select("w", "n"), "w"))
        hits = joined(windows, known, ["w"], "n", F.col("s")).groupBy("s").agg(F.collect_set("at").alias("at"))
        hits = kinds.select("s", "c").join(hits, "s").select("s", "c", "at").mapInArrow(lean(_merged(kind)), "s binary, c long, spans array<struct<a:long,z:long>>")
        hits = materialise(hits)
        spans = joined(runs, hits, ["s"], "c", F.xxhash64("key", "first")).select("key", "first", F.explode("spans").alias("x"))
        found.append(materialise(spans.select("key", (F.col("first") + F.col("x.a")).alias("first"), (F.col("first") + F.col("x.z")).alias("end"))))
        used += [kinds, windows, twice, known, hits]
    for done in used:
        discard(done)
    return found


def cover(n: int, spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of n items any of the spans (firsts, ends) covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, spans[0], 1)
    np.add.at(change, spans[1], -1)
    return np.cumsum(change[:n]) > 0


def _spans_of(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(firsts, ends) for each row of array<struct<first, end>>, None for a null."""
    flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    first, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return [(first[a:z], end[a:z]) if z > a else None for a, z in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def digested(docs: DataFrame, kind: Kind, resolver: Callable[[Runs], np.ndarray], measure: Callable[[bytes, int, tuple | None], tuple], columns: str, id_col: str, text_col: str, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(id, columns) of every row of docs: measure(text, copies, spans) of its text, as a table in the shared folder."""
    small_batches(docs.sparkSession)
    texts = distinct_texts(docs, text_col)
    repeated = repeated_spans(texts, kind, resolver, hot_runs)
    spans = reduce(DataFrame.unionByName, repeated).groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    kinds = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]
    names = [c.split()[0] for c in columns.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(*x) for x in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), _spans_of(b.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True))], ["key", "copies", *names])

    found = materialise(texts.join(spans, "key", "left").select("key", "text", "copies", "spans").mapInArrow(lean(scan), f"key binary, copies long, {columns}"))
    keyed = docs.select(F.col(id_col), text_key(text_col).alias("key"))
    out = materialise(joined(keyed, found, ["key"], "copies", F.col(id_col)).select(id_col, *names))
    drop(texts)
    for done in (found, *repeated):
        discard(done)
    return out
