"""Line dedup: lines that many documents share stay in one of them.

1. Every long enough line becomes a 128-bit hash of its key; a document sends one row per key, with the numbers of its
   lines, not their text.
2. Rows are dealt out by ranges of hash, document and position, so a line that very many documents share is spread over as
   many tasks as it fills. A task gets its rows in that order and streams them: the first document of a hash is the one
   that keeps it; lines of later documents go as soon as enough documents have been seen.
3. Only the first and the last hash of a task can go on in another one. Rows of the first are passed on, of the last as
   much as tells its documents; what they come to is one row per cut hash. Rows beyond HELD are passed on likewise.
4. What goes comes back as one compressed bitmap of lines to keep per document, and is applied to the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, discard, joined, lean, materialise, small_batches, table

LEAST_CHARS, LEAST_DOCS = 20, 3
#: A task holds at most so many rows of one hash while too few documents have been seen; more are passed on.
HELD = 10_000
_SPACE = b" \t\n\v\f\r"


def key_of(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lowered."""
    return line.strip(_SPACE).lower()


def shared_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, digest, n_lines, h1, h2, lines) for each distinct key of at least least_chars characters in each row; lines are
    the numbers of its lines, from 0. id and digest name the row; rows that agree in both have one text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, hashes, at, counts = [], [], [], []
            for k, text in enumerate(as_bytes(b.column(2))):
                own = (text or b"").split(b"\n")
                counts.append(len(own))
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(own):
                    if len(line) >= least_chars and len(key := key_of(line)) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode()) >= least_chars):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                row += [k] * len(found)
                hashes += found.keys()
                at += found.values()
            if not row:
                continue
            take, h = pa.array(row, pa.int32()), np.frombuffer(b"".join(hashes), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.array(counts)[row]), pa.array(h[::2]), pa.array(h[1::2]), pa.array(at, pa.list_(pa.int32()))], ["id", "digest", "n_lines", "h1", "h2", "lines"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(scan), f"id {rows.schema['id'].dataType.simpleString()}, digest long, n_lines long, h1 long, h2 long, lines array<int>")


def _streamed(least_docs: int):
    """Scan of rows in order of h1, h2, id (falling) and position: rows that go, and rows left open at the task's ends."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at_start, ids, seen, held, out = None, True, [], None, [], []

        def settled(row: tuple) -> None:
            """One row of the present group, in order."""
            nonlocal seen, at_start
            if row[:2] == seen:  # a repeated row
                return
            seen = row[:2]
            if not ids or (ids[-1] != row[0] and len(ids) < least_docs):
                ids.append(row[0])
            if at_start:
                out.append((*row, True))
            elif row[0] == ids[0]:  # the first document keeps its lines, whatever follows
                return
            elif len(ids) < least_docs:
                held.append(row)
                if len(held) >= HELD:
                    at_start = True
                    out.extend(passed_on())
            else:
                out.extend((*r, False) for r in (*held, row))
                held.clear()

        def passed_on() -> list[tuple]:
            """The rows of the present group that are not yet decided on, and rows without lines that tell who has it."""
            rows = [(*r, True) for r in held] + [(i, 0, 0, *group, [], True) for i in ids]
            held.clear()
            return rows

        def packed(names: list[str], like: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], like.column(k).type) for k in range(6)] + [pa.array([r[6] for r in out], pa.bool_())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        b, names = None, []
        for b in batches:
            if not b.num_rows:
                continue
            names = [*b.schema.names, "open"]
            h1, h2 = b.column(3).to_numpy(), b.column(4).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
            ends = np.append(starts[1:], len(h1))
            # a hash that only one row of the batch has, and that neither ends, has only one document
            matter = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(h1)))
            rows = b.take(pa.array(np.concatenate([np.arange(s, e) for s, e in zip(starts[matter].tolist(), ends[matter].tolist(), strict=True)])))
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if row[3:5] != group:
                    at_start, group = group is None, row[3:5]
                    ids, seen, held = [], None, []
                settled(row)
            if out:
                yield packed(names, b)
        if group is not None and not at_start:
            out += passed_on()
        if out:
            yield packed(names, b)

    return scan


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, digest, n_lines, n_dropped, keep) for each row of docs that loses a line. keep is a compressed bitmap, one bit
    per line, most significant first, set if the line stays; id and digest (the text's xxhash64) name the row.

    A written table; equal rows come once. Documents are counted by distinct ids, null being one, the smallest.
    """
    spark = docs.sparkSession
    rows = materialise(shared_keys(docs, id_col, text_col, least_chars))
    order = [F.col("h1"), F.col("h2"), F.col("id").desc_nulls_last(), F.col("digest"), F.element_at("lines", 1)]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    found = materialise(dealt.mapInArrow(lean(_streamed(least_docs)), f"{schema}, open boolean"))
    left = found.where("open")
    counted = left.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("_n"))
    whole = counted.groupBy("h1", "h2").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("_n").alias("_n")).where(F.col("n") >= least_docs)
    whole = materialise(whole)
    more = joined(left, whole, ["h1", "h2"], "_n", F.xxhash64("id", "digest")).where(~F.col("id").eqNullSafe(F.col("first")) & (F.size("lines") > 0))
    gone = found.where("NOT open").select("id", "digest", "n_lines", "lines").unionByName(more.select("id", "digest", "n_lines", "lines"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, dropped = [], []
            for n, lines in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                mask = np.ones(n, bool)
                for part in lines:
                    mask[part] = False
                keep.append(zlib.compress(np.packbits(mask).tobytes(), 1))
                dropped.append(n - int(mask.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], ["id", "digest", "n_lines", "n_dropped", "keep"])

    per_row = gone.groupBy("id", "digest").agg(F.max("n_lines").alias("n_lines"), F.collect_list("lines").alias("lines"))
    out = materialise(per_row.mapInArrow(lean(bits), f"id {rows.schema['id'].dataType.simpleString()}, digest long, n_lines long, n_dropped long, keep binary"))
    for done in (rows, found, whole):
        discard(done)
    return out


def kept_lines(text: bytes | None, keep: bytes | None) -> bytes:
    lines = (text or b"").split(b"\n")
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
        lines = [x for x, stays in zip(lines, bits.tolist(), strict=True) if stays]
    return b"\n".join(lines)


def _marked(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int) -> DataFrame:
    """docs with `_keep`, null where nothing goes."""
    marks = keep_bitmaps(docs, id_col, text_col, least_chars, least_docs).select(F.col("id").alias("_id"), F.col("digest").alias("_text"), F.col("keep").alias("_keep"))
    rows = docs.withColumn("_digest", F.xxhash64(text_col))
    return rows.join(marks, rows[id_col].eqNullSafe(marks["_id"]) & (rows["_digest"] == marks["_text"]), "left").drop("_id", "_text", "_digest")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the lines gone from text_col that at least least_docs documents share, except in the document of the
    largest id. Keys are lines without ASCII white space at their ends, A-Z lowered; shorter ones than least_chars
    characters stay. A null text stays null. All lines of a key in the document that keeps it stay. Rows of one id are one
    document; a null id is a document like any other, but the smallest. Columns with other names stay as they are."""
    cut = F.udf(lambda text, keep: text if text is None or keep is None else kept_lines(text.encode(), keep).decode(), "string", useArrow=True)
    return _marked(docs, id_col, text_col, least_chars, least_docs).withColumn(text_col, cut(text_col, "_keep")).select(docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every row, as deduplicated() leaves it; null and empty texts have one line."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, dropped, digests = [], [], []
            for text, keep in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                n.append((text or b"").count(b"\n") + 1)
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n[-1]) if keep is not None else None
                dropped.append(0 if bits is None else n[-1] - int(bits.sum()))
                digests.append(hashlib.sha256(kept_lines(text, keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], ["id", "n_lines", "n_dropped", "kept_sha256"])

    rows = _marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", least_chars, least_docs)
    out = rows.mapInArrow(lean(scan), f"id {rows.schema['id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op13_lines": op13_lines}
SQL = {
    "op13_lines": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
shared AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM lines WHERE length(key) >= {LEAST_CHARS}) GROUP BY key HAVING count(*) >= {LEAST_DOCS}),
marked AS (SELECT r, i, line, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM lines LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked JOIN (SELECT r, doc_id FROM d) USING (r) GROUP BY r, doc_id
"""
}
