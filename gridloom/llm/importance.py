"""Resampling towards a target distribution: documents drawn without replacement by importance weights of hashed word runs.

1. Word runs are hashed into buckets. Each task counts its documents' buckets in one array; the sums are one row per bucket.
2. A bucket's gain, the logarithm of how much more frequent it is in the target, goes to all tasks as one array, and a
   document's weight is the sum over its features. A keyed Gumbel number on top makes the largest scores a weighted draw.
3. Scores are integers. Their histogram is summed from the top: first over at most BINS ranges of scores, then within each
   range, so no task and not the driver holds all scores. It gives the rank at which each score begins and the lowest
   score that is drawn.
4. Only documents of those scores are numbered by id within their score, which splits a score that many documents share.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, discard, joined, lean, materialise, numbered, small_batches, table
from gridloom.llm.decontaminate import words_of

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Ranges of scores whose counts are summed at the driver.
BINS = 4096


def buckets_of(text: bytes | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to `longest` consecutive words."""
    words = words_of(text)
    crcs = list(map(zlib.crc32, words))
    found = [np.fromiter(crcs, np.int64, len(words))]
    for k in range(1, longest):  # a run's CRC goes on from that of the run without its last word
        crcs = list(map(zlib.crc32, map(b" ".__add__, words[k:]), crcs))
        found.append(np.fromiter(crcs, np.int64, len(crcs)))
    return len(words), np.concatenate(found) % buckets


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; each task sends one row per bucket that it has met."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for text in as_bytes(b.column(0)):
                counts += np.bincount(buckets_of(text, longest, buckets)[1], minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    return texts.select(text_col).mapInArrow(lean(scan), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in docs; `buckets` numbers at the driver."""
    counts = []
    for texts in (docs, target):
        own = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(texts, text_col, longest, buckets).collect():
            own[bucket] = n
        counts.append(own)
    (s, t), total_s, total_t = counts, int(counts[0].sum()), int(counts[1].sum())
    share = (t + 1.0) * float(total_s + buckets) / ((s + 1.0) * float(total_t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in share.tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(gain)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            rows = [(n, len(found), int(gain[found].sum())) for n, found in map(buckets_of, as_bytes(b.column(1)), repeat(longest), repeat(len(gain)))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(scan), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def _starts(counts: DataFrame, most: int) -> tuple[DataFrame, int | None]:
    """From a written histogram (score, n): (score, n, start) of each score that begins before rank `most`, where start is
    the number of documents of higher scores; and the lowest such score, None if there is none."""
    spark = counts.sparkSession
    low, high = counts.agg(F.min("score"), F.max("score")).first()
    if most < 1 or low is None:
        return counts.select("score", "n", F.lit(0).cast("long").alias("start")).where("false"), None
    width = (high - low) // BINS + 1
    of = F.floor((F.col("score") - F.lit(low)) / F.lit(width)).cast("long")  # no bin holds more than `width` scores
    above, starts = 0, []
    for r in sorted(counts.groupBy(of.alias("bin")).agg(F.sum("n").alias("n")).collect(), reverse=True):  # BINS rows at most
        if above >= most:
            break
        starts.append((r.bin, above))
        above += r.n
    bins = F.broadcast(spark.createDataFrame(starts, "bin long, above long"))
    within = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("bin", of).join(bins, "bin").withColumn("start", F.col("above") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    begun = materialise(begun.where(F.col("start") < most).select("score", "n", "start"))
    return begun, begun.agg(F.min("score")).first()[0]


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; rank counts from 1 the rows drawn, others have null.

    Of the rows with at least `least_words` words the given percentage is drawn. Null and empty texts have no feature,
    weight 0 and are never drawn while least_words is over 0. A null id draws its number as an empty one and comes last
    among equal scores; rows that agree in score and id are drawn in the order of n_features, equal ones in any order.
    Repeated rows count as often as they occur. An empty target makes every gain depend on docs alone; an empty table
    gives no rows. Columns of docs other than id and text are never looked at.
    """
    spark = docs.sparkSession
    gain = gains(docs, target, text_col, longest, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = materialise(weighted(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + gumbel))
    able = scored.where(F.col("n_words") >= least_words)
    counts = materialise(able.groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    most = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    begun, cutoff = _starts(counts, most)
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(cutoff)) if cutoff is not None else F.lit(False)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    others = scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    if cutoff is None:
        return others
    ties = materialise(scored.where(drawn).withColumns({"_group": -F.col("score"), "_tie": F.monotonically_increasing_id()}))
    places = numbered(ties, "_group", [F.col("id").asc_nulls_last(), F.col("n_features"), F.col("_tie")], "place")
    ranked = joined(places, begun, ["score"], "n", F.col("_tie")).withColumn("rank", F.col("start") + F.col("place") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    for done in (counts, ties):
        discard(done)
    return ranked.select(*columns, "rank").unionByName(others)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB has no crc32: the table of its 256 remainders, and the fold over a string's UTF-8 bytes.
CRC_TABLE = "SELECT list(c ORDER BY n) AS k FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(n))"


def crc32_sql(text: str, remainders: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a string's UTF-8 bytes; remainders is the list of CRC_TABLE."""
    read = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST(('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS INTEGER), 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {read}), lambda a, x: xor(a >> 8, {remainders}[(xor(a, x) & 255) + 1])), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op11_importance": op11_importance}
SQL = {
    "op11_importance": f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM (SELECT {_WORDS} AS w FROM benchmark)),
named AS MATERIALIZED (SELECT w, {crc32_sql('w', 'k')} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN named USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN named USING (w) GROUP BY b),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE))) AS g FROM s LEFT JOIN t USING (b)),
weights AS (SELECT r, sum(g) AS weight FROM dw JOIN named USING (w) JOIN gain USING (b) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN weights USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n) AS rank, count(*) OVER () AS eligible FROM scored WHERE n >= {LEAST_WORDS})
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= {PERCENT} * eligible // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
}
