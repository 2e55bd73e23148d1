"""Benchmark decontamination: windows of normalised test words in a hash set, scanned over training texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, discard, lean, materialise, ranges, small_batches, table

WORDS = 10
#: One broadcast set holds at most so many windows (about 100 bytes each); a larger benchmark is scanned in several passes,
#: each written to the shared folder before the next, so that a task holds one set.
SET_WINDOWS = 500_000
#: Digits, a-z and every byte of a non-ASCII character stay, A-Z are lowered, all else ends a word.
_NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class WindowSet:
    """Windows of benchmark items as word numbers: for each window length, sorted hashes, the words to verify, the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], words: int = WORDS):
        self.items = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set[int]]] = {}
        for k, (_, own) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
            length = min(words, len(ids))
            for i in range(len(ids) - length + 1 if ids else 0):
                found.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), set()).add(k)
        self.by_length = {}
        self.base = 0x9E3779B97F4A7C15
        for length, windows in found.items():
            rows = np.array(list(windows), np.uint64).reshape(-1, length)
            while len(np.unique(hashes := self._hash(rows.T))) < len(hashes):  # two windows with one hash: another base
                self.base = (self.base * 6364136223846793005 + 2) | 1
                self.by_length = {n: (np.sort(h := self._hash(r.T)), r[o := np.argsort(h)], [i[x] for x in o]) for n, (_, r, i) in self.by_length.items()}
            order = np.argsort(hashes)
            owners = [sorted(x) for x in windows.values()]
            self.by_length[length] = hashes[order], rows[order], [owners[x] for x in order]

    def _hash(self, columns) -> np.ndarray:
        h, base = np.zeros(1, np.uint64), np.uint64(self.base)
        for c in columns:
            h = (h + c) * base
        return h

    def scan(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """For each length: (length, first words of the occurrences, their window, items by window). 0 is no word of the set."""
        outside = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, (hashes, rows, owners) in self.by_length.items():
            at = np.flatnonzero(outside[length:] == outside[:-length]) if len(ids) >= length else np.zeros(0, np.int64)
            h = self._hash(ids[at + k] for k in range(length))
            which = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[which] == h
            at, which = at[same], which[same]
            exact = (ids[at[:, None] + np.arange(length)] == rows[which]).all(axis=1)
            yield length, at[exact], which[exact], owners


def _marked(known: WindowSet, texts: list[bytes | None], items: list[set[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, where they start among all words, which of those are hit; the items found are added to items."""
    own = [words_of(t) for t in texts]
    n = np.fromiter(map(len, own), np.int64, len(own))
    starts = np.concatenate(([0], np.cumsum(n + 1)))  # a 0 after each text, so that no window spans two
    ids = np.zeros(starts[-1], np.uint64)
    for k, text in enumerate(own):
        ids[starts[k] : starts[k] + n[k]] = np.fromiter(map(known.vocabulary.get, text, repeat(0)), np.uint64, len(text))
    covered = np.zeros(len(ids) + 1, np.int32)
    for length, at, which, owners in known.scan(ids):
        np.add.at(covered, at, 1)
        np.add.at(covered, at + length, -1)
        for doc, w in set(zip((np.searchsorted(starts, at, "right") - 1).tolist(), which.tolist(), strict=True)):
            items[doc].update(known.items[i] for i in owners[w] if known.items[i] is not None)
    return n, starts, np.cumsum(covered[:-1]) > 0


def _window_sets(bench: DataFrame, id_col: str, text_col: str, words: int) -> Iterator[WindowSet]:
    """The benchmark in sets of bounded size, at least one; rows are fetched one partition at a time and let go with their set."""
    held, windows = [], 0
    rows = bench.select(F.col(id_col).cast("string"), F.encode(F.col(text_col), "UTF-8"))
    for name, text in rows.toLocalIterator():
        held.append((name, own := words_of(bytes(text) if text is not None else None)))
        windows += max(1, len(own) - words + 1)
        if windows >= SET_WINDOWS:
            yield WindowSet(held, words)
            held, windows = [], 0
    yield WindowSet(held, words)


def _scanned(docs: DataFrame, sets: Iterator[WindowSet], scan_for: Callable[[Broadcast], Callable]) -> DataFrame:
    """docs through scan_for(set) of every set, one after another; what a scan gives has the columns of docs."""
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    # by place: names may clash, and tables between passes can't have that
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    schema, written, shared = rows.schema, None, None
    for one in sets:
        if shared is not None:
            following = materialise(rows)
            discard(written)
            shared.unpersist()
            rows = written = following
        shared = spark.sparkContext.broadcast(one)
        rows = rows.mapInArrow(lean(scan_for(shared)), schema)
    return rows.toDF(*names)


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", words: int = WORDS) -> DataFrame:
    """(id, text, n_words, n_hit, hit, items) for every row of docs, without a shuffle; see SET_WINDOWS.

    hit has one bit for each word of the text (most significant first): set if a benchmark window covers the word.
    items are the item ids, as strings, that have a window in the text. Null texts have no words; items that are null
    or without words match nothing; windows of items with a null id hit, but no item is named for them; repeated items
    count once; an empty benchmark or an empty table gives no hits.
    """
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))

    def scan_for(shared: Broadcast) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                items = [set(x or ()) for x in b.column(5).to_pylist()]
                n, starts, hit = _marked(shared.value, as_bytes(b.column(1)), items)
                bits, counts = [], []
                for k, before in enumerate(b.column(4).to_pylist()):
                    mine = hit[starts[k] : starts[k] + n[k]]
                    if before is not None:
                        mine = mine | np.unpackbits(np.frombuffer(before, np.uint8), count=int(n[k])).astype(bool)
                    counts.append(int(mine.sum()))
                    bits.append(np.packbits(mine).tobytes() if counts[-1] else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(counts, pa.int64()), pa.array(bits, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], b.schema.names)

        return scan

    return _scanned(out, _window_sets(bench, item_col, text_col, words), scan_for)


def without_spans(text: str | None, hit: bytes | None) -> str | None:
    """The text without its hit words; each run of hit words goes with what stands between them."""
    if not text or not hit:
        return text
    raw = text.encode()
    inside = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    first, last = edges[::2], edges[1::2]
    bits = np.unpackbits(np.frombuffer(hit, np.uint8), count=len(first))
    runs = np.flatnonzero(np.diff(np.concatenate(([0], bits.view(np.int8), [0]))))
    keep = np.ones(len(raw), bool)
    a, b = first[runs[::2]], last[runs[1::2] - 1]
    keep[ranges(a, b - a)] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode()


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", words: int = WORDS) -> DataFrame:
    """One row per row of docs: its words, its hit words, the benchmark items found in it, and whether it is contaminated."""
    found = hits(docs, bench, id_col, text_col, item_col, words)
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cleaned(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", words: int = WORDS) -> DataFrame:
    """(id, text) of every row, its hit spans removed; what is left of a text is not searched again."""
    cut = F.udf(without_spans, "string", useArrow=True)
    return hits(docs, bench, id_col, text_col, item_col, words).select(F.col("id").alias(id_col), cut("text", "hit").alias(text_col))


def uncontaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", words: int = WORDS) -> DataFrame:
    """The rows of docs, with all their columns, in whose texts no benchmark window occurs. Null texts stay."""
    place = docs.columns.index(text_col)

    def scan_for(shared: Broadcast) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, starts, hit = _marked(shared.value, as_bytes(b.column(place)), [set() for _ in range(b.num_rows)])
                before = np.concatenate(([0], np.cumsum(hit)))[starts]
                yield b.filter(pa.array(np.diff(before) == 0))

        return scan

    return _scanned(docs, _window_sets(bench, item_col, text_col, words), scan_for)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op2_decontaminate": op2_decontaminate}
SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
}
