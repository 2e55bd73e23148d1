"""Word deduplication by relative Lempel-Ziv parsing: texts factored against indexed reference blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.anchors import gram_hashes
from gridloom.llm.common import ranges, table
from gridloom.llm.repeats import HOT_RUNS, Kind, Runs, cover, digested

WORDS, GRAMS = 35, (8, 24)


def _parse(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    words, digest = text.split(), xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words)), words


KIND = Kind(WORDS, GRAMS, _parse, lambda words, i, j: b" ".join(words[i:j]))


class ReferenceBlock:
    """The word sequences of a block's runs, their windows of WORDS words sorted, so that the place with which any window
    has most words in common is one of its two neighbours."""

    def __init__(self, runs: Runs):
        numbers: dict[bytes, int] = {}
        words = [s.split(b" ") for s in runs.segments]
        self.ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        base, stop = np.cumsum(length) - length, np.cumsum(length)
        self.places = ranges(base, runs.windows)  # where each window begins
        owner = np.repeat(np.arange(len(words)), runs.windows)
        self.rest = stop[owner] - self.places
        self.numbered = np.append(self.ids, np.full(int(length.max(initial=0)), -1))
        entry = np.unique(gram_hashes(self.ids, WORDS)[self.places], return_inverse=True)[1]
        # windows of one entry are alike up to the anchor and beyond, so what follows the anchor sorts them
        after = [b" ".join(ws[o:]) + b" " for ws, o in zip(words, runs.offset.tolist(), strict=True)]
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=after.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[owner], entry))
        same = np.diff(entry[order]) == 0
        if (self.common(order[:-1][same], order[1:][same], WORDS) < WORDS).any():  # two windows with one hash
            entry = np.unique(self.numbered[self.places[:, None] + np.arange(WORDS)], axis=0, return_inverse=True)[1].ravel()
            order = np.lexsort((rank[owner], entry))
            same = np.diff(entry[order]) == 0
        self.before, self.behind = np.full(len(order), -1), np.full(len(order), -1)
        self.before[order[1:][same]], self.behind[order[:-1][same]] = order[:-1][same], order[1:][same]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many words, `most` at most, the runs have in common from the windows a and b on."""
        k = np.arange(most)
        n = np.minimum(np.minimum(self.rest[a], self.rest[b]), most)
        differs = self.numbered[self.places[a][:, None] + k] != self.numbered[self.places[b][:, None] + k]
        differs |= k >= n[:, None]
        return np.where(differs.any(axis=1), differs.argmax(axis=1), most)

    def longest(self, window: np.ndarray) -> np.ndarray:
        """Words of the longest factor that begins with each window: what it has in common with any other place."""
        most, best = int(self.rest[window].max(initial=0)), np.zeros(len(window), np.int64)
        for other in (self.before[window], self.behind[window]):
            there = np.flatnonzero(other >= 0)
            best[there] = np.maximum(best[there], self.common(window[there], other[there], most))
        return best

    def parse(self, runs: Runs) -> np.ndarray:
        """Windows that lie in factors of WORDS words or more. All runs are parsed side by side, greedily from the left.

        Where a factor ends, the next place looked up is the first window that crosses its end, so a repeat that
        straddles a factor boundary is found by its own factor. A place without a long factor is a literal.
        """
        ends = np.cumsum(runs.windows)
        hit, cursor = np.zeros(int(ends[-1]), bool), ends - runs.windows
        # the next window of each window's run that has another place in the index
        able = np.where((self.before >= 0) | (self.behind >= 0), np.arange(len(hit)), len(hit))
        able = np.minimum.accumulate(np.append(able, len(hit))[::-1])[::-1]
        live = np.arange(len(ends))
        while len(live):
            cursor[live] = able[cursor[live]]
            live = live[cursor[live] < ends[live]]
            if not len(live):
                break
            at = cursor[live]
            best = self.longest(at)
            long = best >= WORDS
            step = np.where(long, best - WORDS + 1, 1)
            hit[ranges(at[long], step[long])] = True
            cursor[live] = at + step
            live = live[cursor[live] < ends[live]]
        return hit


def equal_windows(runs: Runs) -> np.ndarray:
    """Which windows of the runs repeat: every run is factored against the block that holds all runs of its anchors."""
    return ReferenceBlock(runs).parse(runs)


def without_repeats(text: bytes, copies: int, spans: tuple | None) -> tuple[int, int, bytes]:
    """Words, removed words, and the others joined by single spaces."""
    words = text.split()
    n = len(words)
    if copies > 1 and n >= WORDS:
        return n, n, b""
    if spans is None:
        return n, 0, b" ".join(words)
    gone = cover(n, spans)
    return n, int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _measure(text: bytes, copies: int, spans: tuple | None) -> tuple[int, int, str]:
    n, removed, kept = without_repeats(text, copies, spans)
    return n, removed, hashlib.sha256(kept).hexdigest()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row.

    Words (runs of other than ASCII white space, unchanged) go if a window of WORDS of them starts at two places or
    more; copies of a text, and texts that differ in white space only, are places of their own. Null texts have no
    words; short texts lose nothing. Repeated rows count as copies. An empty table gives an empty result. Other columns
    are not read.
    """
    return digested(docs, KIND, equal_windows, _measure, "n_words long, n_removed long, kept_sha256 string", id_col, text_col, hot_runs)


def op6_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {"op6_relative_lz": op6_relative_lz}
SQL = {
    "op6_relative_lz": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN twice USING (g)),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(t, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
}
