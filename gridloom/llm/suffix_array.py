"""Byte deduplication: suffixes sorted bucket by bucket, long ties resolved by the ranks of a difference cover's sample."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import slices_by_cost, table
from gridloom.llm.repeats import HOT_RUNS, Kind, Runs, cover, digested

BYTES, GRAMS = 200, (32, 128)
#: A difference cover: every residue modulo PERIOD is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Suffixes of so many buckets are sorted at a time.
BUCKET_SUFFIXES = 1 << 18

KIND = Kind(BYTES, GRAMS, lambda text: (np.frombuffer(text, np.uint8), text), lambda text, i, j: text[i:j])


def _shifts() -> np.ndarray:
    """For residues a and b the least d for which a + d and b + d are both in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    both = np.array([[inside[a : a + PERIOD] & inside[b : b + PERIOD] for b in range(PERIOD)] for a in range(PERIOD)])
    assert both.any(axis=2).all()
    return both.argmax(axis=2)


_SHIFT = _shifts()
_PLACE = np.full(PERIOD, -1)
_PLACE[list(COVER)] = np.arange(len(COVER))


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks, from 0 and without gaps, of tuples compared key by key."""
    rank = np.unique(keys[0], return_inverse=True)[1]
    for k in keys[1:]:
        values, second = np.unique(k, return_inverse=True)
        rank = np.unique(rank * len(values) + second, return_inverse=True)[1]
    return rank


class SuffixSorter:
    """Compares and groups the suffixes of one block of text by their first BYTES bytes."""

    def __init__(self, text: bytes):
        part = np.frombuffer(text + bytes(BYTES + 3 * PERIOD), np.uint8).astype(np.uint64)
        for step in (1, 2, 4):  # the eight bytes at each place as one number
            part = (part[:-step] << np.uint64(8 * step)) | part[step:]
        self.eight = part
        n = -(-len(text) // PERIOD)
        at = (np.arange(n)[:, None] * PERIOD + np.array(COVER)).ravel()
        at = at[at < len(text)]
        words = [self.eight[at + 8 * k] for k in range(4)]
        words[3] = words[3] >> np.uint64(8 * (32 - PERIOD))
        self.short = _dense(*words)  # ranks of the PERIOD bytes at each place of the sample
        step = len(COVER)  # the sample is closed under moving by PERIOD: that is so many places in it
        double = self._paired(self.short, step)
        self.long = self._paired(double, 2 * step)  # of 4 * PERIOD bytes

    @staticmethod
    def _paired(rank: np.ndarray, step: int) -> np.ndarray:
        """Ranks of twice the length; what lies beyond the text counts as smaller than all."""
        behind = np.concatenate((rank[step:] + 1, np.zeros(min(step, len(rank)), rank.dtype)))
        return _dense(rank * (int(behind.max(initial=0)) + 1) + behind)

    def _sampled(self, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return rank[at // PERIOD * len(COVER) + _PLACE[at % PERIOD]]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Signs of the comparison of the suffixes at a and b over BYTES bytes.

        Ties beyond the first 32 bytes are resolved by ranks of the cover's sample, from the first shift at which both
        suffixes are in it: five periods, a sixth where it still fits, and the last 32 bytes again byte by byte.
        """
        sign, tied = np.zeros(len(a), np.int8), np.arange(len(a))

        def settle(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
            other = x != y
            sign[of[other]] = np.where(x[other] < y[other], -1, 1)
            return other

        for k in (0, 8, 16, 24):
            tied = tied[~settle(self.eight[a[tied] + k], self.eight[b[tied] + k], tied)]
        d = _SHIFT[a[tied] % PERIOD, b[tied] % PERIOD]
        for rank, step, most in ((self.long, 0, PERIOD), (self.short, 4 * PERIOD, PERIOD), (self.short, 5 * PERIOD, BYTES - 6 * PERIOD)):
            fits = np.flatnonzero(d < most)
            x, y = a[tied[fits]] + d[fits] + step, b[tied[fits]] + d[fits] + step
            keep = np.ones(len(tied), bool)
            keep[fits] = ~settle(self._sampled(rank, x), self._sampled(rank, y), tied[fits])
            tied, d = tied[keep], d[keep]
        for k in (BYTES - 32, BYTES - 24, BYTES - 16, BYTES - 8):
            tied = tied[~settle(self.eight[a[tied] + k], self.eight[b[tied] + k], tied)]
        return sign

    def repeated(self, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Which suffixes agree over BYTES bytes with another of their bucket. Quicksort in three parts, all ties at once."""
        hit = np.zeros(len(starts), bool)
        group, live = bucket, np.arange(len(starts))
        while len(live):
            order = np.argsort(group, kind="stable")
            group, live = group[order], live[order]
            first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            size = np.diff(np.append(first, len(group)))
            many = np.repeat(size > 1, size)
            pivot = np.repeat(live[first + size // 2], size)[many]
            number = np.repeat(np.arange(len(first)), size)[many]
            live = live[many]
            sign = self.compare(starts[live], starts[pivot])
            same = (sign == 0) & (live != pivot)
            hit[live[same]] = hit[pivot[same]] = True
            rest = sign != 0
            group, live = number[rest] * 2 + (sign[rest] > 0), live[rest]
        return hit


def equal_windows(runs: Runs) -> np.ndarray:
    """Which windows of the runs equal another: suffixes are sorted some buckets (anchor and its place in the window) at a time."""
    sorter = SuffixSorter(b"".join(runs.segments))
    length = np.fromiter(map(len, runs.segments), np.int64, len(runs.segments))
    base, ends = np.cumsum(length) - length, np.concatenate(([0], np.cumsum(runs.windows)))
    edges = np.flatnonzero(np.diff(runs.group, prepend=-1, append=-1))  # whole anchors stay together
    cost = ends[edges[1:]] - ends[edges[:-1]]
    out = []
    for i, j in slices_by_cost(cost, BUCKET_SUFFIXES):
        r = np.arange(edges[i], edges[j])
        owner = np.repeat(r, runs.windows[r])
        k = np.arange(len(owner)) - (ends[owner] - ends[edges[i]])
        out.append(sorter.repeated(base[owner] + k, runs.group[owner] * BYTES + runs.offset[owner] - k))
    return np.concatenate(out)


def without_repeats(text: bytes, copies: int, spans: tuple | None) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs and the rest of a text."""
    n = len(text)
    if copies > 1 and n >= BYTES:
        return n, n, 1, b""
    if spans is None:
        return n, 0, 0, text
    gone = cover(n, spans)
    return n, int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()


def _measure(text: bytes, copies: int, spans: tuple | None) -> tuple[int, int, int, str]:
    n, removed, runs, kept = without_repeats(text, copies, spans)
    return n, removed, runs, hashlib.sha256(kept).hexdigest()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Each byte that a BYTES-byte string covers which starts at two places or more goes, in all of those places; copies of
    a text are places of their own. Null texts count as empty; empty and short texts lose nothing. Repeated rows count
    as copies. An empty table gives an empty result. Other columns are not read.
    """
    return digested(docs, KIND, equal_windows, _measure, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col, hot_runs)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_array": op7_suffix_array}
SQL = {
    "op7_suffix_array": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT r, i, md5(substr(b, 2 * i - 1, 400)) AS g FROM (SELECT r, b, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM win SEMI JOIN twice USING (g)),
run AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY r, k),
gap AS (SELECT r, coalesce(lag(z) OVER w, 1) AS a, a AS z FROM span WINDOW w AS (PARTITION BY r ORDER BY a) UNION ALL SELECT r, max(z), NULL FROM span GROUP BY r),
kept AS (SELECT r, string_agg(substr(b, 2 * a - 1, 2 * (coalesce(z, n + 1) - a)), '' ORDER BY a) AS k FROM gap JOIN d USING (r) GROUP BY r),
removed AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(k, b))) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
}
